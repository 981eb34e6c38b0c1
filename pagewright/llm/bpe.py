"""Byte-level BPE: a segment tree over byte positions drives the merges.

The tree's leaves are byte positions; a leaf holds the rank of the pair that
starts there (or "none"), an inner node the smallest rank below it, leftmost
first on ties.  One merge walks from the root to the leftmost smallest leaf,
joins two live neighbours and updates at most three leaves, so a match of n
bytes costs O(n log n) however long it is.  Short matches are merged many at a
time: one numpy tree per row of a matrix, all rows taking a merge per round.
"""

from __future__ import annotations

import hashlib
import re
import sys
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

NONE = (1 << 31) - 1
TABLE_BYTES = 160 << 20     # a worker's remembered encodings, as estimated
SHORT = 64                  # bytes up to which matches are merged by matrix
EDGE = re.compile(r"\s | \s| \Z")   # a space that touches other white space


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token, space, rank, per line."""
    import base64
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class PairRanks:
    """Rank of the token that two neighbouring tokens make, looked up by ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values(), default=0) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()] + [NONE], dtype=np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where no token fits; an id of -1 stands for no token."""
        out = np.full(len(left), NONE, dtype=np.int32)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        if len(both) and len(self.keys):
            key = left[both].astype(np.int64) * self.width + right[both]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[both[found]] = self.ranks[at[found]]
        return out


def merge_rows(words: list[bytes], byte_ids: np.ndarray, pair_rank: PairRanks) -> list[bytes]:
    """Ids (little-endian 32-bit) of many non-empty words at once.

    Row r of ``tree`` is the segment tree of word r.  Words that have no pair
    left leave the working set.
    """
    n, longest = len(words), max(map(len, words))
    size = 1 << max(0, longest - 1).bit_length()
    lengths = np.array([len(w) for w in words])
    ids = np.full((n, size + 1), -1, dtype=np.int32)
    ids[np.arange(size + 1) < lengths[:, None]] = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    end = np.minimum(np.arange(1, size + 2), size)[None, :].repeat(n, 0)
    prev = np.arange(-1, size)[None, :].repeat(n, 0)
    alive = ids >= 0
    tree = np.full((n, 2 * size), NONE, dtype=np.int32)
    tree[:, size:] = pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size)
    for level in range(size.bit_length() - 2, -1, -1):
        lo = 1 << level
        tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])
    row = np.arange(n)
    while True:
        row = row[tree[row, 1] < NONE]
        if not len(row):
            break
        token, i = tree[row, 1], np.ones(len(row), dtype=np.int64)
        for _ in range(size.bit_length() - 1):
            i *= 2
            i += tree[row, i] > tree[row, i + 1]        # left child on ties
        pos = i - size
        gone = end[row, pos]                            # the neighbour to swallow
        after = end[row, gone]
        before = prev[row, pos]
        ids[row, pos] = token
        end[row, pos] = after
        prev[row, after] = pos
        alive[row, gone] = False
        ids[row, gone] = -1
        left = np.where(before >= 0, ids[row, before], -1)
        rows3 = np.concatenate((row, row, row))
        leaf = np.concatenate((gone, pos, np.where(before >= 0, before, gone))) + size
        tree[rows3, leaf] = np.concatenate((
            np.full(len(row), NONE, dtype=np.int32), pair_rank(token, ids[row, after]),
            np.where(before >= 0, pair_rank(left, token), NONE)))
        for _ in range(size.bit_length() - 1):
            leaf >>= 1
            tree[rows3, leaf] = np.minimum(tree[rows3, 2 * leaf], tree[rows3, 2 * leaf + 1])
    flat = ids[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(1)) * 4
    starts = np.concatenate(([0], ends[:-1]))
    return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


class MergeTree:
    """Minimum pair rank over byte positions, leftmost on ties."""

    def __init__(self, leaves: list[int]):
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.low = [NONE] * self.size + leaves + [NONE] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            left, right = self.low[2 * i], self.low[2 * i + 1]
            self.low[i] = left if left <= right else right

    def put(self, pos: int, rank: int) -> None:
        low, i = self.low, pos + self.size
        low[i] = rank
        i >>= 1
        while i:
            left, right = low[2 * i], low[2 * i + 1]
            best = left if left <= right else right
            if low[i] == best:
                return
            low[i] = best
            i >>= 1

    def leftmost(self) -> int:
        """Position of the smallest rank; -1 when no pair can merge."""
        low, i = self.low, 1
        if low[1] == NONE:
            return -1
        while i < self.size:
            i *= 2
            if low[i] > low[i + 1]:
                i += 1
        return i - self.size


def merge_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the whole word if it is a token, else merge by merge."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))             # the part that starts here ends there
    prev = list(range(-1, n - 1))
    tree = MergeTree([ranks.get(word[i:i + 2], NONE) for i in range(n - 1)] + [NONE])
    while (i := tree.leftmost()) >= 0:
        j = end[i]                          # the part to swallow
        k = end[j]
        end[i] = k
        tree.put(j, NONE)
        if k < n:
            prev[k] = i
            tree.put(i, ranks.get(word[i:end[k]], NONE))
        else:
            tree.put(i, NONE)
        if (h := prev[i]) >= 0:
            tree.put(h, ranks.get(word[h:k], NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encoder and decoder of one vocabulary.

    Two tables of bounded size remember encodings between texts: of matches of
    the pattern, and of chunks between single spaces.  A chunk is cut only at a
    space with non-white characters on both sides, where every match of the
    pattern starts anew, so its matches do not depend on its neighbours.
    """

    def __init__(self, content: bytes, pattern: str):
        import regex
        self.ranks = parse_ranks(content)
        self.pair_rank = PairRanks(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        tokens = [b""] * self.pair_rank.width
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.token_start = np.concatenate(([0], np.cumsum(self.token_length)[:-1]))
        self.split = regex.compile(pattern).findall
        self.matches: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def cut(text: str) -> list[str]:
        """Chunks of which ``" ".join`` is ``text``."""
        parts = text.split(" ")
        if not EDGE.search(text):
            return parts
        chunks, whole = [], True
        for k, part in enumerate(parts):
            if whole:
                chunks.append(part)
            else:
                chunks[-1] += " " + part
            follows = parts[k + 1] if k + 1 < len(parts) else "x"
            # White space at the edge of a part reaches into the next one.
            whole = not ((part and part[-1].isspace()) or (not part and k) or not follows or follows[0].isspace())
        return chunks

    def _split_chunk(self, chunk: str) -> list[str]:
        """Matches of a space and then ``chunk``; plain words skip the pattern."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
        return self.split(" " + chunk)

    def _encode_matches(self, matches: set[str]) -> dict[str, bytes]:
        """Merge matches that no table holds, short ones by matrix."""
        out, by_size = {}, {}
        for m in matches:
            word = m.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(word)
            if whole is not None:
                out[m] = whole.to_bytes(4, "little")
            elif len(word) > SHORT:
                out[m] = np.array(merge_ids(word, self.ranks), dtype="<u4").tobytes()
            else:
                by_size.setdefault((len(word) - 1).bit_length(), []).append((m, word))
        for group in by_size.values():
            for at in range(0, len(group), 4096):
                part = group[at:at + 4096]
                out.update(zip((m for m, _ in part), merge_rows([w for _, w in part], self.byte_ids, self.pair_rank)))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > TABLE_BYTES:         # grows by one bounded batch beyond this
            self.matches.clear()
            self.chunks.clear()
            self.held = 0
        cut = [self.cut(t) for t in texts]
        heads = {chunks[0] for chunks in cut}
        tails = set().union(*[chunks[1:] for chunks in cut])
        split = {" " + c: self._split_chunk(c) for c in tails if c not in self.chunks}
        for c in heads:
            split.setdefault(c, self.split(c))
        fresh = self._encode_matches({m for ms in split.values() for m in ms if m not in self.matches})
        self.matches.update(fresh)
        ids = {c: b"".join([self.matches[m] for m in ms]) for c, ms in split.items()}
        self.chunks.update((c[1:], b) for c, b in ids.items() if c[:1] == " ")
        self.held += sum(map(len, fresh)) + sum(map(len, split)) + 200 * (len(fresh) + len(split))
        out = []
        for chunks in cut:
            out.append(ids[chunks[0]] + b"".join(map(self.chunks.__getitem__, chunks[1:])))
        return out

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        if not len(at):
            return b""
        length = self.token_length[at]
        ends = np.cumsum(length)
        shift = np.repeat(self.token_start[at] - (ends - length), length)
        return self.token_bytes[shift + np.arange(ends[-1])].tobytes()


def worker_codec(content: bytes, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary, kept between tasks."""
    held = sys.__dict__.setdefault("_byte_bpe_codecs", {})
    key = (hash(content), pattern)
    if key not in held:
        held[key] = Codec(content, pattern)
    return held[key]


def bounded(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``chars`` characters (one text at least)."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def encode_documents(docs: DataFrame, ranks_content: bytes, pattern: str,
                     id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Encode every whole text and decode it again, one row per input row.

    Returns id, n_tokens, ``ids`` (array of int) and ``decoded`` (binary); with
    ``digests_only`` the two are replaced by ids_sha256 and decoded_sha256, so
    no token list crosses back into the JVM.  A null or empty text has no
    tokens.  Repeated rows stay repeated, columns other than the two named
    are not read, an empty table gives no rows.  No shuffle: each input
    partition is mapped on its own.
    """
    kind = next(f.dataType.simpleString() for f in docs.schema.fields if f.name == id_col)
    payload = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_codec(ranks_content, pattern)
        for frame in frames:
            ids = [b for part in bounded(frame["_text"].tolist()) for b in codec.encode_batch(part)]
            decoded = [codec.decode(b) for b in ids]
            out = {"id": frame["_id"], "n_tokens": [len(b) // 4 for b in ids]}
            if digests_only:
                out["ids_sha256"] = [hashlib.sha256(b).hexdigest() for b in ids]
                out["decoded_sha256"] = [hashlib.sha256(b).hexdigest() for b in decoded]
            else:
                out["ids"] = [np.frombuffer(b, "<u4").astype("int32") for b in ids]
                out["decoded"] = decoded
            yield pd.DataFrame(out)

    given = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return (given.mapInPandas(run, f"id {kind}, n_tokens bigint, {payload}")
            .withColumnRenamed("id", id_col))
