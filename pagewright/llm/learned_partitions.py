"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample: its neighbour graph is cut into parts of equal
size with few edges between them, and a small network learns to tell from a
vector alone how its neighbours spread over the parts; an offset per part
keeps the parts equal when the network places rows.  Indexing: every row goes
to its most probable part.  Search: a query visits its own most probable
parts, until their probabilities add up to what rows kept from the fit needed
for the wanted recall, and every row there is scored exactly.

A vector is sent to the query blocks of its own part only.  Parts are cut into
blocks of bounded size, so a part that holds a third of all rows (equal vectors
cannot be told apart) is many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .vectors import largest, matrix, top_rows, usable

SAMPLE = 6000           # rows that the index is fitted on, at most
ROWS_PER_PART = 500     # wanted mean of a part, as long as the sample can tell so many parts apart
SAMPLE_PER_PART = 50    # sample rows that a part needs at least; a larger sample allows more parts
QUERY_BLOCK = 8192
QUERY_GROUP = 256       # queries scored at a time
VECTOR_BLOCK = 4096


def levelled(x: np.ndarray) -> np.ndarray:
    """Every row times a power of two that brings its largest component to 0.5..1,
    so that no square over- or underflows; cosines stay as they are."""
    if not x.size:
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = levelled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows by cosine of every row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), dtype=np.int64)
    for at in range(0, len(x), 1024):
        score = x[at:at + 1024] @ x.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        if k > 0:
            part = np.argpartition(-score, k - 1, axis=1)[:, :k]
            own = np.take_along_axis(score, part, axis=1)
            out[at:at + 1024] = np.take_along_axis(part, np.argsort(-own, axis=1), axis=1)
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 12, slack: float = 0.05,
                   seed: int = 11) -> np.ndarray:
    """Parts of at most (1 + slack) * n / parts vertices with few cut edges.

    Starts from sorted recursive halving along principal directions and then
    moves or swaps vertices towards the part that most of their graph
    neighbours are in, while the sizes allow it.
    """
    n = len(x)
    label = np.zeros(n, dtype=np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            label[rows] = first
            continue
        half = count // 2
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(rows) * half // count
        todo += [(order[:cut], first, half), (order[cut:], first + half, count - half)]
    source = np.repeat(np.arange(n), near.shape[1])
    target = near.ravel()
    room = int(np.ceil((1 + slack) * n / parts))
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        votes = np.zeros((n, parts))
        np.add.at(votes, (source, label[target]), 1.0)
        np.add.at(votes, (target, label[source]), 1.0)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.lexsort((rng.random(len(movers)), -gain[movers]))]
        waiting: dict[tuple[int, int], list[int]] = {}
        moved = 0
        for v in movers.tolist():
            a, b = int(label[v]), int(wish[v])
            if size[b] < room:
                label[v] = b
                size[a] -= 1
                size[b] += 1
                moved += 1
            elif waiting.get((b, a)):
                label[v], label[waiting[(b, a)].pop()] = b, a
                moved += 2
            else:
                waiting.setdefault((a, b), []).append(v)
        if moved < n // 500:
            break
    return label


class Router:
    """One hidden layer over the vector, softmax over parts."""

    def __init__(self, w1, b1, w2, b2):
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def balance(self, x: np.ndarray, rounds: int = 60) -> None:
        """Offsets under which the rows' most probable parts are as equal in size as they can."""
        parts = len(self.b2)
        best, least = self.b2, None
        for at in range(rounds):
            size = np.bincount(self.probabilities(x).argmax(axis=1), minlength=parts)
            if least is None or size.max() < least:
                best, least = self.b2, size.max()
            self.b2 = self.b2 - 0.5 * (1 - at / rounds) * np.log((size + 1) / (len(x) / parts + 1))
        self.b2 = best

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 40, rate: float = 3e-3,
            seed: int = 5) -> "Router":
        """``target``: the share of each row's neighbours in every part."""
        rng = np.random.default_rng(seed)
        d, parts = x.shape[1], target.shape[1]
        p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden),
             rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at:at + 256]
                a = x[rows] @ p[0] + p[1]
                h = np.maximum(a, 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                dz = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                dh = (dz @ p[2].T) * (a > 0)
                step += 1
                for j, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] = p[j] - rate * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.999 ** step)) + 1e-8)
        return cls(*p)


def visits(router: Router, x: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's parts, most probable first, and how many of them it visits: the
    fewest whose probabilities add up to ``share``."""
    p = router.probabilities(x)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    return order, np.maximum(1, (before < share).sum(axis=1))


def fit_index(sample: np.ndarray, parts: int, k: int, target_recall: float) -> tuple[Router, float]:
    """Router, and the share of probability to visit, from unit vectors.

    The last third of the sample is kept from the fit; the share is the least
    that finds ``target_recall`` of these rows' k nearest among themselves, which
    the router has seen as little as it will see the indexed rows.
    """
    if parts == 1 or len(sample) < 20:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, parts)), np.zeros(parts)), 1.0
    held = max(1, len(sample) // 3)
    fit, test = sample[:-held], sample[-held:]
    near = neighbours(fit, 10)
    label = balanced_parts(fit, near, parts)
    target = np.zeros((len(fit), parts))
    np.add.at(target, (np.repeat(np.arange(len(fit)), near.shape[1]), label[near].ravel()), 1.0)
    np.add.at(target, (np.arange(len(fit)), label), 1.0)
    router = Router.fit(fit, target / target.sum(axis=1, keepdims=True))
    router.balance(sample)
    p = router.probabilities(test)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    place = np.argsort(order, axis=1)               # visit at which each part comes
    at = np.take_along_axis(place, p.argmax(axis=1)[neighbours(test, k)], axis=1)
    needed = np.sort(np.take_along_axis(before, at, axis=1).ravel())
    if not len(needed):
        return router, 1.0
    return router, float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(target_recall * len(needed))))], 2.0))


def nearest(vectors: DataFrame, k: int = 5, query_every: int = 50, target_recall: float = 0.96,
            id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (cosine in double precision) of each
    query's k nearest rows found, nearest first, ties to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``; candidates
    are rows with another id and as many components.  Null, empty or zero
    vectors, those with null or non-finite components, and rows with a null
    id take no part; repeated rows each count; a table without usable rows
    gives none; other columns are ignored; components of any finite size keep
    their cosine.  The fit reads a sample of at most ``sample`` rows of the
    commonest width, which bounds the parts (``SAMPLE_PER_PART``); rows of another
    width make one part of their own per width.
    """
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(usable(F.col("v")) & F.col("vec_id").isNotNull()).where(F.exists("v", lambda x: x != 0))
            .withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()))
    rows = materialize(rows, "vectors")
    main = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").first()
    dim, n = (main["dim"], main["n"]) if main else (1, 0)
    # The rows with the smallest hashes: bounded, and the same for any layout.
    drawn = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("v").collect()
    x = unit(np.array([r["v"] for r in drawn], dtype=np.float64).reshape(-1, dim))
    parts = max(1, min(n // ROWS_PER_PART, len(x) // SAMPLE_PER_PART))
    router, share = fit_index(x, parts, k, target_recall)

    def routed(frames):
        for f in frames:
            part, visited = np.zeros(len(f), dtype=np.int32), [None] * len(f)
            asks = (f["vec_id"] % query_every == 0).to_numpy()
            own = np.flatnonzero(f["dim"].to_numpy() == dim)
            for i in np.flatnonzero(asks).tolist():
                visited[i] = [0]
            if len(own):
                order, count = visits(router, unit(matrix(f["v"].iloc[own])), share)
                part[own] = order[:, 0]
                for j in np.flatnonzero(asks[own]).tolist():
                    visited[own[j]] = order[j, :count[j]].tolist()
            f["part"], f["visited"] = part, visited
            yield f

    placed = materialize(rows.mapInPandas(
        routed, "vec_id bigint, v array<double>, dim int, row bigint, part int, visited array<int>"), "placed")
    asked = placed.where(F.col("visited").isNotNull()).select(
        F.col("row").alias("qrow"), F.col("vec_id").alias("query_id"), "v", "dim", F.explode("visited").alias("part"))
    # Blocks of a part: of its vectors (cuts) and of the queries that visit it.
    sizes = placed.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("n")).join(
        asked.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("q")), ["dim", "part"])
    sizes = sizes.select("dim", "part", F.ceil(F.col("n") / VECTOR_BLOCK).cast("int").alias("cuts"),
                         F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qbs"))

    def numbered(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    index = (placed.select("vec_id", "v", "dim", "part", "row").join(sizes, ["dim", "part"])
             .withColumn("cut", F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int")).withColumn("qb", numbered("qbs")))
    asked = (asked.join(sizes, ["dim", "part"])
             .withColumn("qb", F.pmod(F.xxhash64("qrow"), F.col("qbs")).cast("int")).withColumn("cut", numbered("cuts")))

    def rerank(key, qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(qs) and len(vs):
            a, b, ids = levelled(matrix(qs["v"])), levelled(matrix(vs["v"])), vs["vec_id"].to_numpy()
            length, own, qrow = np.sqrt((b * b).sum(axis=1)), qs["query_id"].to_numpy(), qs["qrow"].to_numpy()
            for at in range(0, len(a), QUERY_GROUP):
                group = a[at:at + QUERY_GROUP]
                rough = (group @ b.T) / (length * np.sqrt((group * group).sum(axis=1))[:, None])
                rough[own[at:at + QUERY_GROUP, None] == ids] = -np.inf
                # Products are summed in another order for every block: the near ones are scored again alike.
                least = np.partition(rough, -k, axis=1)[:, -k] if len(b) > k else np.full(len(group), -2.0)
                for i, v in enumerate(group):
                    near = np.flatnonzero(rough[i] >= max(least[i] - 1e-9, -2.0))
                    score = (b[near] * v).sum(axis=1) / (length[near] * np.sqrt((v * v).sum()))
                    best = largest(score, ids[near], k)
                    found += zip([qrow[at + i]] * len(best), [own[at + i]] * len(best), ids[near[best]].tolist(), score[best].tolist())
        return pd.DataFrame(found, columns=["_qrow", "query_id", "vec_id", "score"])

    keys = ("dim", "part", "cut", "qb")
    asked = asked.select("qrow", "query_id", "v", *keys)
    # Both sides come from one table; toDF gives the queries' columns an identity of their own.
    found = (asked.toDF(*asked.columns).groupBy(*keys)
             .cogroup(index.select("vec_id", "v", *keys).groupBy(*keys))
             .applyInPandas(rerank, "_qrow bigint, query_id bigint, vec_id bigint, score double"))
    return top_rows(found, k)
