"""Token ids of a lower-casing word tokenizer, with words remembered.

The tokenizer drops white space and never joins across it, so a text's ids are
its words' ids in a row.  Each Python worker keeps ids of words (and of the
letter, digit and symbol runs inside them) in tables of bounded size and asks
the tokenizer library only for what is new.
"""

from __future__ import annotations

import re
import sys

import numpy as np

TABLE_BYTES = 128 << 20                 # a worker's remembered words, as estimated
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")   # white space to Python or the library, not to both
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
# The tokenizer file's own splitting pattern, for the letters of PLAIN.
RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokens:
    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.bytes_of = {i: i.to_bytes(4, "little") for i in self.tokenizer.get_vocab().values()}
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.held = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, run: str) -> bytes:
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(shown)])

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            ids = self.runs[run] = self._ids(run)
            self.held += 200 + 2 * len(run) + len(ids)
        return ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > TABLE_BYTES:         # grows by one bounded batch beyond this
            self.words.clear()
            self.runs.clear()
            self.held = 0
        split = [None if ODD_SPACE.search(t) else t.split() for t in texts]
        words = self.words
        fresh = {w for ws in split if ws for w in ws if w not in words}
        other = []
        for w in fresh:
            if not PLAIN(w):
                other.append(w)
            elif w.isalpha():       # one run, which needs no entry beside the word's
                low = w.lower()
                words[w] = words[low] if low in words else self._ids(low)
            else:
                words[w] = b"".join([self._run(r) for r in RUNS(w.lower())])
        words.update(zip(other, self._library(other)))
        self.held += 250 * len(fresh) + 4 * sum(map(len, fresh))
        return [self._library([t])[0] if ws is None else b"".join([words[w] for w in ws])
                for t, ws in zip(texts, split)]


def worker_tokens(tokenizer_json: str) -> WordTokens:
    """One table per Python worker and tokenizer, kept between tasks."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    held = sys.__dict__.setdefault("_word_token_tables", {})
    key = hash(tokenizer_json)
    if key not in held:
        held[key] = WordTokens(tokenizer_json)
    return held[key]
