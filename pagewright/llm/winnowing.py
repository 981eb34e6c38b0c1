"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item; an item of
fewer words is one window.  Texts and items are cut into k-grams, and every
window keeps its least k-gram hash as fingerprint; equal windows keep equal
ones, so a shared span of a window's length is never missed.

1. Items give their different windows with fingerprints.  A bitmap of the
   fingerprints (a fixed 2 MB, however many there are) goes to all tasks.
2. Texts are winnowed where they are read.  A fingerprint is looked up once for
   the windows that share it; only windows behind a fingerprint in the bitmap
   leave the task.
3. These are joined with the items' windows on the fingerprint and extended over
   the words themselves, so neither bitmap nor hashes decide a hit.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

WINDOW = 10
BITMAP_BITS = 24            # log2 of the bitmap's bits
BROADCAST_BYTES = 16 << 20  # item windows that may be broadcast, by the bytes of their words
BLOCK = 1 << 20             # bytes of text in one round of numpy work
# Words are runs of ASCII letters (lower-cased) and digits and of all that is not ASCII.
CLASS = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        CLASS[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b
LOWER_WORDS = bytes(int(c) or 32 for c in CLASS)
MULTIPLY, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and 64-bit hash of every word of ``data``."""
    found = []
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and CLASS[data[end]]:     # never cut a word
            end += 1
        letters = CLASS[np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)]
        inside = np.zeros(len(letters) + 2, dtype=np.int8)
        inside[1:-1] = letters != 0
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # A word's hash is a slice of one running polynomial, shifted back to power 0.
        run = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum(letters * powers(MULTIPLY, len(letters)), out=run[1:])
        back = powers(INVERSE, len(letters) + 1)
        hashes = mixed((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        found.append((starts + at, ends + at, hashes))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def fingerprints(words: np.ndarray, span: int) -> np.ndarray:
    """Least k-gram hash of every ``span`` consecutive words (k is half of span)."""
    k = max(1, span // 2)
    n = len(words) - k + 1
    grams = np.full(n, span, dtype=np.uint64)
    for j in range(k):
        grams = grams * np.uint64(MULTIPLY) + words[j:j + n]
    grams = mixed(grams)
    least = grams[:n - span + k]
    for j in range(1, span - k + 1):
        least = np.minimum(least, grams[j:j + n - span + k])
    return least


def bit_of(fingerprint: np.ndarray) -> np.ndarray:
    return (fingerprint >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def winnowed(texts: list[bytes], spans: list[int], bitmap: np.ndarray | None) -> Iterator[tuple]:
    """Number of words and windows (first word, words, fingerprint, joined words) of
    each text, those windows alone whose fingerprint is in the bitmap if one is given."""
    data = b"\n".join(texts)        # a line break is no part of a word
    starts, ends, hashes = word_spans(data)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    limits = np.searchsorted(starts, text_ends)         # words before the end of each text
    owner = np.repeat(np.arange(len(texts)), np.diff(limits, prepend=0))
    first = np.concatenate([[0], limits[:-1]])
    out: list[list] = [[] for _ in texts]
    for span in spans:
        for at in range(0, max(0, len(hashes) - span + 1), BLOCK):      # a window of words at a time
            words = hashes[at:at + BLOCK + span - 1]
            least = fingerprints(words, span)
            n = len(least)
            here = owner[at:at + n] == owner[at + span - 1:at + span - 1 + n]
            change = np.ones(n, dtype=bool)
            change[1:] = least[1:] != least[:-1]
            run = np.cumsum(change) - 1
            kept = here
            if bitmap is not None:
                bit = bit_of(least[change])
                kept = here & ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)[run]
            for i in np.flatnonzero(kept).tolist():
                k = int(owner[at + i])
                joined = b" ".join(data[starts[at + i]:ends[at + i + span - 1]].translate(LOWER_WORDS).split())
                out[k].append((at + i - int(first[k]), span, int(least[i].view(np.int64)), joined))
    return zip(np.diff(limits, prepend=0).tolist(), out)


def parts(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts as bytes, about ``BLOCK`` bytes (one text at least) at a time."""
    part, held = [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if part and held + len(raw) > BLOCK:
            yield part
            part, held = [], 0
        part.append(raw)
        held += len(raw)
    if part:
        yield part


def item_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """item (as text), span, fp, words: the windows of every item."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, at, ids = [], 0, f["item"].tolist()
            for part in parts(f["text"].tolist()):
                counts = [n for n, _ in winnowed(part, [], None)]
                for span in sorted({min(n, window) for n in counts if n}):
                    own = [k for k, n in enumerate(counts) if min(n, window) == span]
                    for k, (_, found) in zip(own, winnowed([part[k] for k in own], [span], None)):
                        rows += [(ids[at + k], span, fp, words.decode("utf-8", "surrogatepass")) for _, _, fp, words in found]
                at += len(part)
            yield pd.DataFrame(rows, columns=["item", "span", "fp", "words"])

    given = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return given.mapInPandas(run, "item string, span int, fp bigint, words string")


def fingerprint_bitmap(windows: DataFrame) -> np.ndarray:
    """One bit per value of the fingerprint's first bits, gathered as 64 bits a row:
    at most 2 ** (BITMAP_BITS - 6) rows reach the driver, whatever the benchmark's size."""
    bit = F.shiftrightunsigned("fp", 64 - BITMAP_BITS)
    rows = (windows.select(F.shiftrightunsigned(bit, 6).alias("place"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
            .groupBy("place").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect())
    words = np.zeros(1 << (BITMAP_BITS - 6), dtype="<i8")
    for place, bits in rows:
        words[place] = bits
    return words.view(np.uint8)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Words of every text that stand in an item's window, one row per input row.

    Returns the id, ``n_words``, ``n_hit``, ``spans`` (hit stretches as first word
    and end, in order) and ``items`` (ids, as text, of the items with a window in
    the text, sorted as text).

    Null and empty texts have no words: no hits.  Repeated rows and ids each give
    a row.  Repeated items count once by id; the windows of items with a null id
    are hits, but name no item.  An empty benchmark hits nothing, an empty table
    gives no rows, other columns are not read.  Texts of any length are read in
    blocks of about a megabyte; a passage common to many texts is many rows of
    one join key, which a broadcast (of item windows within a stated size) or
    the skew join splits; equal sets of windows name their items once.
    """
    field = next(f for f in docs.schema.fields if f.name == id_col)
    of_items = materialize(item_windows(benchmark, window, item_col, item_text), "item-windows")
    known = materialize(of_items.select("fp", "span", "words").distinct()
                        .withColumn("wid", F.monotonically_increasing_id()), "windows")
    spans = sorted(r[0] for r in known.select("span").distinct().collect())     # at most ``window`` of them
    bitmap = zlib.compress(fingerprint_bitmap(known).tobytes(), 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)
        for f in frames:
            base = f["row"].tolist()
            ids, at = f["_id"].tolist(), 0
            for part in parts(f.pop("_text").tolist()):
                rows = []
                for n, found in winnowed(part, spans, bits):
                    rows.append((base[at], ids[at], n, None, None, None, None))
                    rows += [(base[at], None, None, start, span, fp, words.decode("utf-8", "surrogatepass"))
                             for start, span, fp, words in found]
                    at += 1
                made = pd.DataFrame(rows, columns=["row", "_id", "n_words", "start", "span", "fp", "words"], dtype=object)
                yield made.astype({c: "Int64" for c in ("row", "n_words", "start", "span", "fp")})

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("_id"),
                        F.col(text_col).alias("_text"))
    seen = materialize(given.mapInPandas(run, "row bigint, _id string, n_words bigint, start bigint, span int, "
                                              "fp bigint, words string"), "winnowed")
    held = known.agg(F.coalesce(F.sum(F.octet_length("words") + 64), F.lit(0))).first()[0]
    hits = materialize(seen.where(F.col("start").isNotNull())
                       .join(F.broadcast(known) if held <= BROADCAST_BYTES else known, ["fp", "span", "words"])
                       .select("row", "start", (F.col("start") + F.col("span")).alias("end"), "wid"), "hits")

    # Stretches of overlapping windows.
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= reach, 0).otherwise(1)
    stretches = (hits.withColumn("_fresh", fresh).withColumn("_stretch", F.sum("_fresh").over(order))
                 .groupBy("row", "_stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    per_text = stretches.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"),
                                            F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    # Items of each different set of windows.
    sets = hits.groupBy("row").agg(F.array_sort(F.collect_set("wid")).alias("wids"))
    named = of_items.where(F.col("item").isNotNull()).join(known, ["fp", "span", "words"]).select("wid", "item").distinct()
    items = (sets.select("wids").distinct().select("wids", F.explode("wids").alias("wid")).join(named, "wid")
             .groupBy("wids").agg(F.array_sort(F.collect_set("item")).alias("items")))
    found = per_text.join(sets.join(items, "wids", "left"), "row")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (seen.where(F.col("n_words").isNotNull()).select("row", "_id", "n_words").join(found, "row", "left")
            .select(F.col("_id").cast(field.dataType).alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce("spans", empty).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))
