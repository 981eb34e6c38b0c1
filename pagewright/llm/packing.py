"""Packing into fixed-capacity sequences by linear grouping.

The plan depends only on how many pieces have each length, a table of at most
``capacity`` rows.  Large lengths are cut, in sorted order, into groups of
equal cardinality and rounded up to their group's longest; the few sizes that
remain are packed by configurations (column generation on the covering
program, rounded down, the rest first-fit).  Each configuration's places are
then given to actual lengths, which leaves real gaps, and the small lengths go
best-fit, longest first, into the tightest gap that takes them.  Bins that
look alike are kept as one run with a count, so the plan stays small however
many pieces there are; pieces find their place by their position in
(length, id) order.
"""

from __future__ import annotations

import bisect
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .bpe import bounded
from .sharding import prefix_positions
from .tokens import worker_tokens

GROUPS = 32             # sizes left after rounding
LARGE_SHARE = 3         # a length of a third of the capacity or more is large
LP_ROUNDS = 400


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokens of every whole text, ``end_id`` at the end, cut every ``capacity``
    tokens: id, piece (from 0), start, length, ids_crc32 and, if asked, ids.

    A null or empty text is the end token alone.  Repeated rows stay repeated.
    """
    kind = next(f.dataType.simpleString() for f in docs.schema.fields if f.name == id_col)
    end = int(end_id).to_bytes(4, "little")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = worker_tokens(tokenizer_json)
        for frame in frames:
            rows = []
            ids_of = (b for part in bounded(frame["_text"].tolist()) for b in tokens.encode_batch(part))
            for key, ids in zip(frame["_id"], ids_of):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(own) // 4, zlib.crc32(own), own))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "ids"])
            if with_ids:
                out["ids"] = [np.frombuffer(b, "<u4").astype("int32") for b in out["ids"]]
            else:
                del out["ids"]
            yield out

    given = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return given.mapInPandas(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
                             + ", ids array<int>" * with_ids)


# -- the plan, over lengths and their counts ------------------------------------

def linear_groups(counts: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cut (length, count) pairs, longest first, into groups of equal cardinality."""
    total = sum(n for _, n in counts)
    each = max(1, -(-total // groups))
    out, room = [[]], each
    for length, n in counts:
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return [g for g in out if g]


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per size of the worthiest bin (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    up, gain = sizes[order], worth[order]
    for w in range(int(up[0]), capacity + 1):
        k = int(np.searchsorted(up, w, side="right"))
        value = best[w - up[:k]] + gain[:k]
        j = int(value.argmax())
        if value[j] > best[w - 1]:
            best[w], last[w] = value[j], order[j]
        else:
            best[w] = best[w - 1]
    counts, w = np.zeros(len(sizes), dtype=np.int64), capacity
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            counts[last[w]] += 1
            w -= int(sizes[last[w]])
    return counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins for ``demand`` items of few sizes: (counts per size, how many bins).

    Revised simplex with generated columns; multiples are rounded down and what
    is left is packed first-fit decreasing.
    """
    size, want = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag(capacity // size).astype(float)
    x = want / np.diag(basis)
    for _ in range(LP_ROUNDS):
        inverse = np.linalg.inv(basis)
        x = inverse @ want
        column = best_configuration(size, np.maximum(inverse.sum(axis=0), 0.0), capacity).astype(float)
        if inverse.sum(axis=0) @ column <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    left = np.array(demand, dtype=np.int64)
    out = []
    for k in np.argsort(-x):
        column = basis[:, k].astype(np.int64)
        held = column > 0
        times = int(min(np.floor(max(x[k], 0) + 1e-9), (left[held] // column[held]).min())) if held.any() else 0
        if times > 0:
            out.append((tuple(column.tolist()), times))
            left -= times * column
    order = np.argsort(-size)
    while left.any():           # each pass uses up a size
        room, column = capacity, np.zeros(len(size), dtype=np.int64)
        for k in order:
            column[k] = min(left[k], room // size[k])
            room -= int(column[k] * size[k])
        held = column > 0
        times = int((left[held] // column[held]).min())
        out.append((tuple(column.tolist()), times))
        left -= times * column
    return out


def pack_lengths(counts: dict[int, int], capacity: int, groups: int = GROUPS,
                 large_share: int = LARGE_SHARE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of equal bins, (how many, [(length, pieces per bin), ...]), that hold
    exactly ``counts`` (length -> pieces)."""
    down = sorted(counts.items(), reverse=True)
    large = [(s, n) for s, n in down if s * large_share >= capacity]
    small = [(s, n) for s, n in down if s * large_share < capacity]
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    if large:
        rounded: dict[int, list[list[int]]] = {}
        for group in linear_groups(large, groups):
            rounded.setdefault(group[0][0], []).extend([s, n] for s, n in group)
        sizes = list(rounded)
        waiting = {s: list(reversed(rounded[s])) for s in sizes}    # next one at the end
        for column, times in configurations(sizes, [sum(n for _, n in rounded[s]) for s in sizes], capacity):
            places = []             # per place of the configuration: runs of actual lengths
            for s, per_bin in zip(sizes, column):
                for _ in range(per_bin):
                    need, own = times, []
                    while need:
                        head = waiting[s][-1]
                        take = min(need, head[1])
                        own.append([head[0], take])
                        head[1] -= take
                        need -= take
                        if not head[1]:
                            waiting[s].pop()
                    places.append(own)
            while places[0]:
                n = min(p[0][1] for p in places)
                held: dict[int, int] = {}
                for p in places:
                    held[p[0][0]] = held.get(p[0][0], 0) + 1
                    p[0][1] -= n
                    if not p[0][1]:
                        p.pop(0)
                runs.append((n, list(held.items())))
    # Best fit: open[gap] = runs with that gap.
    open_runs: dict[int, list] = {}
    for n, held in runs:
        open_runs.setdefault(capacity - sum(s * c for s, c in held), []).append((n, held))
    gaps = sorted(open_runs)

    def put(gap: int, run) -> None:
        if gap not in open_runs:
            bisect.insort(gaps, gap)
            open_runs[gap] = []
        open_runs[gap].append(run)

    for s, n in small:
        while n:
            k = bisect.bisect_left(gaps, s)
            if k < len(gaps):
                gap = gaps[k]
                bins, held = open_runs[gap].pop()
                if not open_runs[gap]:
                    del open_runs[gap], gaps[k]
            else:
                gap, held = capacity, []
                bins = -(-n // (capacity // s))
            per_bin = gap // s
            full = min(bins, n // per_bin)
            if full:
                put(gap - per_bin * s, (full, held + [(s, per_bin)]))
                n, bins = n - full * per_bin, bins - full
            if bins and n:
                put(gap - n * s, (1, held + [(s, n)]))
                n, bins = 0, bins - 1
            if bins:
                put(gap, (bins, held))
    return [run for gap in gaps for run in open_runs[gap] if run[1]]


def placement(runs: list[tuple[int, list[tuple[int, int]]]], counts: dict[int, int]) -> dict[str, np.ndarray]:
    """Arrays by which a piece's position in (length, id) order gives its place:
    entry k holds for positions from ``position[k]`` on."""
    first, at = {}, 0
    for s in sorted(counts):
        first[s] = at
        at += counts[s]
    rows, sequence = [], 0
    for n, held in runs:
        offset = 0
        for s, per_bin in held:
            rows.append((first[s], per_bin, sequence, offset, s))
            first[s] += n * per_bin
            offset += s * per_bin
        sequence += n
    rows.sort()
    names = ("position", "per_bin", "sequence", "offset", "length")
    return dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, 5).T))


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents: id, piece, start, length, ids_crc32, sequence_id,
    offset and, with ``with_ids``, the token ids of the piece.

    Only documents longer than ``capacity`` are cut.  Null or empty texts are
    one token long; repeated rows are packed once each; an empty table gives
    no rows; only the two named columns are read.  The driver sees one row per
    length (at most ``capacity``); pieces are numbered by range partitions.
    """
    pieces = materialize(token_pieces(docs, tokenizer_json, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = placement(pack_lengths(counts, capacity), counts)
    at = prefix_positions(pieces, ["length", "id", "piece", "ids_crc32"]).drop("rows_all")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            k = np.searchsorted(place["position"], frame["row_before"].to_numpy(), side="right") - 1
            rank = frame["row_before"].to_numpy() - place["position"][k]
            frame["sequence_id"] = place["sequence"][k] + rank // place["per_bin"][k]
            frame["offset"] = place["offset"][k] + rank % place["per_bin"][k] * place["length"][k]
            yield frame.drop(columns="row_before")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema.fields if f.name != "row_before")
    return at.mapInPandas(run, f"{fields}, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)
