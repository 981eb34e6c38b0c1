"""Periodic run detection: maximal pairs from a bottom-up LCP-interval tree.

A run is a stretch of words with smallest period q that is at least
``max(min_length, 2 * q)`` words long and goes on in neither direction.  Its
first word s and s + q are a maximal pair: the same words follow both for
``length - q`` words, different words (or the text's ends) stand before and
after.  So no stretch is ever extended:

1. Words that do not start a repeated stretch of ``min_length / 2`` words in
   their text start no such pair; one sort of hashes leaves them out.
2. The other positions are sorted as suffixes by prefix doubling; common prefix
   lengths of neighbours come from the doubling's own levels.
3. Bottom-up over the LCP intervals, an interval holds its positions in order
   and in one list per left word.  Joining a child, each position of the smaller
   side looks at the other side's positions no farther than the interval's
   length, and steps over those with its own left word at once.  Every pair
   found is a repetition; of equal stretches the smallest distance is the period.

A text is one value; texts are mapped where they are read, without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .bpe import bounded

MIN_LENGTH = 12
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_tail(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The registered query's rewriting: one text in ten (by the id's CRC) repeats
    a stretch of itself from some word on.  A null id leaves the text as it is."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // len(period) + 1))[:n - a]


def with_repeats(texts: list[list[bytes]], least: int) -> list[int]:
    """Texts in which some ``least`` words stand twice (by hash: none is missed)."""
    lengths = np.array([len(t) for t in texts])
    total = int(lengths.sum())
    if total < least:
        return []
    hashes = np.fromiter((hash(w) for t in texts for w in t), dtype=np.int64, count=total).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    grams = owner[:total - least + 1].astype(np.uint64)
    inside = owner[:total - least + 1] == owner[least - 1:]
    for j in range(least):
        grams = grams * MIX + (hashes[j:total - least + 1 + j] ^ (hashes[j:total - least + 1 + j] >> np.uint64(31)))
    grams, owner = grams[inside], owner[:total - least + 1][inside]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    return np.unique(owner[twice[at] == grams]).tolist()


def ranks_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Number of smaller pairs, per pair."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return out


def suffixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``least`` codes stand elsewhere too, sorted as
    suffixes, and the common prefix length of each with the one before it."""
    n = len(codes)

    def after(ranks: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """Ranks ``step`` further on; past the end, a rank below all."""
        there = at + step
        return np.where(there < n, ranks[np.minimum(there, n - 1)], -1)

    every = np.arange(n)
    ranks, width = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    one = ranks
    while width < least:
        if 2 * width <= least:
            ranks = ranks_of(ranks, after(ranks, every, width))
            width *= 2
        else:
            ranks = ranks_of(ranks, after(one, every, width))
            width += 1
    held = np.bincount(ranks, minlength=n)
    open_ = np.flatnonzero(held[ranks] > 1)
    start, levels = open_, [(width, ranks)]
    while len(open_):               # groups of equal rank are split by what follows
        second = after(ranks, open_, width)
        order = np.lexsort((second, ranks[open_]))
        at, a, b = open_[order], ranks[open_][order], second[order]
        k = np.arange(len(at))
        group, part = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)
        group[1:] = a[1:] != a[:-1]
        part[1:] = group[1:] | (b[1:] != b[:-1])
        ranks = ranks.copy()
        ranks[at] = a + np.maximum.accumulate(np.where(part, k, 0)) - np.maximum.accumulate(np.where(group, k, 0))
        width *= 2
        levels.append((width, ranks))
        held = np.bincount(ranks[open_], minlength=n)
        open_ = open_[held[ranks[open_]] > 1]
    sa = start[np.argsort(ranks[start], kind="stable")]
    common = np.zeros(len(sa), dtype=np.int64)
    x, y = sa[:-1].copy(), sa[1:].copy()
    for width, ranks in reversed(levels):
        same = after(ranks, x, 0) == after(ranks, y, 0)
        x, y = x + same * width, y + same * width
    for _ in range(least - 1):
        same = after(one, x, 0) == after(one, y, 0)
        x, y = x + same, y + same
    common[1:] = x - sa[:-1]
    return sa, common


class Interval:
    """Positions of an LCP interval, in order and by left word."""

    __slots__ = ("positions", "by_left")

    def __init__(self, position: int, left: int):
        self.positions, self.by_left = [position], {left: [position]}


def same_left(positions: list[int], own: list[int], t: int, u: int, step: int) -> int:
    """How many positions from ``t`` on (in direction ``step``) are those of ``own`` from ``u`` on."""
    most = min(len(positions) - t, len(own) - u) if step > 0 else min(t, u) + 1
    done, reach = 1, 2
    while reach <= most and positions[t + step * (reach - 1)] == own[u + step * (reach - 1)]:
        done, reach = reach, reach * 2
    high = min(reach, most + 1)     # done holds, high does not
    while high - done > 1:
        mid = (done + high) // 2
        if positions[t + step * (mid - 1)] == own[u + step * (mid - 1)]:
            done = mid
        else:
            high = mid
    return done


def maximal_pairs(sa: list[int], common: list[int], left: list[int], least: int,
                  min_length: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, length): the same words follow i and j, not farther apart than that."""
    def pairs(node: Interval, i: int, length: int) -> Iterator[tuple[int, int, int]]:
        positions, own_left = node.positions, left[i]
        own = node.by_left.get(own_left)
        for step in (1, -1):
            t = bisect_right(positions, i) if step > 0 else bisect_left(positions, i) - 1
            while 0 <= t < len(positions) and abs(positions[t] - i) <= length:
                j = positions[t]
                if left[j] == own_left:
                    t += step * same_left(positions, own, t, bisect_left(own, j), step)
                    continue
                if abs(j - i) + length >= min_length:
                    yield min(i, j), max(i, j), length
                t += step

    stack: list[tuple[int, Interval]] = []
    node = Interval(sa[0], left[sa[0]]) if sa else None

    def joined(a: Interval, b: Interval, length: int):
        big, small = (a, b) if len(a.positions) >= len(b.positions) else (b, a)
        for i in small.positions:
            yield from pairs(big, i, length)
        for i in small.positions:
            insort(big.positions, i)
            insort(big.by_left.setdefault(left[i], []), i)
        return big

    for k in range(1, len(sa) + 1):
        length = common[k] if k < len(sa) else 0
        while stack and stack[-1][0] > length:
            deep, held = stack.pop()
            node = yield from joined(held, node, deep)
        if length >= least:
            if stack and stack[-1][0] == length:
                deep, held = stack.pop()
                node = yield from joined(held, node, deep)
            stack.append((length, node))
        if k < len(sa):
            node = Interval(sa[k], left[sa[k]])


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Per text its runs as (start, length, period), by start, then period."""
    least = max(1, min_length // 2)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    chosen = with_repeats(texts, least)
    if not chosen:
        return out
    starts = np.cumsum([0] + [len(texts[d]) for d in chosen])
    known: dict = {}
    codes = np.empty(starts[-1], dtype=np.int64)
    for k, d in enumerate(chosen):      # codes of different texts differ, so nothing matches across texts
        codes[starts[k]:starts[k + 1]] = [known.setdefault((k, w), len(known)) for w in texts[d]]
    left = np.empty_like(codes)
    left[1:] = codes[:-1]
    left[starts[:-1]] = -1 - np.arange(len(chosen))
    sa, common = suffixes(codes, least)
    best: dict[tuple[int, int], int] = {}
    for i, j, length in maximal_pairs(sa.tolist(), common.tolist(), left.tolist(), least, min_length):
        at = (i, j + length)
        if best.get(at, j - i) >= j - i:
            best[at] = j - i
    for (start, end), period in best.items():
        k = int(np.searchsorted(starts, start, side="right")) - 1
        out[chosen[k]].append((start - int(starts[k]), end - start, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words outside the runs and each run's first period, joined by one space."""
    if runs:
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edge[start + period] += 1
            edge[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              rewrite: Callable | None = None, digests_only: bool = False) -> DataFrame:
    """Periodic runs of every whole text, one row per input row.

    Words stand between ASCII white space.  Returns the id, ``n_words``,
    ``runs`` (array of start, length, period, by start, then period) and
    ``collapsed``, the text with each run cut to its first period.  With
    ``digests_only`` the last two are replaced by n_runs, the longest run (ties:
    smallest start, then period; nulls without runs), and SHA-256 digests, so
    no text goes back to the JVM.  ``rewrite(words, id as text)`` may replace a
    text's words before the search.

    A null or empty text has no words: no runs, collapsed to the empty text.  Repeated rows and ids each give a row, a
    null id stays null, other columns are not read, an empty table gives no
    rows.  A worker holds about a megabyte of texts at a time, or one longer text.
    """
    field = next(f for f in docs.schema.fields if f.name == id_col)
    # Ids travel as text: a null among whole numbers would make them floats in pandas.
    given = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    if digests_only:
        columns = {"n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
                   "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    else:
        columns = {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}
    columns = {"_id": "string", "n_words": "bigint"} | columns

    def described(text: bytes, found: list[tuple[int, int, int]]) -> tuple:
        if not digests_only:
            return [{"start": s, "length": n, "period": p} for s, n, p in found], text.decode("utf-8", "surrogatepass")
        top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        lines = "".join("%d,%d,%d\n" % r for r in found)
        return (len(found), *top, 1000 * top[1] // top[2] if found else None,
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, rows = frame["_id"].tolist(), []
            for part in bounded([t or "" for t in frame.pop("_text")]):
                texts = [t.encode("utf-8", "surrogatepass").split() for t in part]
                if rewrite is not None:
                    texts = [rewrite(words, i) for words, i in zip(texts, ids[len(rows):])]
                for words, found in zip(texts, runs_of(texts, min_length)):
                    rows.append((ids[len(rows)], len(words), *described(collapsed(words, found), found)))
            made = pd.DataFrame(rows, columns=list(columns))
            yield made.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli") if c in made})

    out = given.mapInPandas(run, ", ".join(f"{c} {kind}" for c, kind in columns.items()))
    return out.select(F.col("_id").cast(field.dataType).alias(id_col), *[c for c in columns if c != "_id"])
