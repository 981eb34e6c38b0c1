"""Exact top-k by integer inner product: three-phase uniform threshold.

Every vector is cut into ``slices`` runs of components.  A slice of a block of
vectors is one score list per query: its entries are partial products, and a
pair's score is the sum of its entries over the slices.

1. Each list gives its k best entries; the pairs they name are scored, and the
   k-th best of a query's scores is a safe cutoff ``c`` (never above the true
   k-th best score).
2. A pair all of whose entries are below ``c / slices`` sums below ``c`` and
   cannot be among the k best.  Lists give every entry that reaches the uniform
   threshold; a pair's known entries, with the threshold for those not given,
   bound its score, and pairs that cannot reach ``c`` go.
3. The remaining pairs are scored in full; the k best of a block leave the task.

A group of queries meets a block of vectors in a task of its own, which works
through the queries in bounded steps, all lists of a step at once.  No pair
leaves a task but a query's k best, whatever vector, id or score is common and
whatever the cutoff's sign.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .vectors import block_of, blocks, usable

QUERY_GROUP = 8192      # queries that meet a block of vectors in one task
QUERY_BLOCK = 256        # of which so many are worked on at a time
VECTOR_BLOCK = 4096
PLAIN = 1 << 22         # components up to this multiply exactly as doubles
WIDEST = 1 << 6         # components of such a product; wider vectors take Python's integers where they must
LONG = (1 << 63) - 1
DIGITS = 99999


def integer_rows(column: pd.Series, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of rows of equal length as doubles, and which rows are not
    exact that way (their integers come from ``exact_rows``)."""
    raw = np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        made = np.floor(raw * scale)
    most = PLAIN if raw.shape[1] <= WIDEST else PLAIN * WIDEST // raw.shape[1]
    return made, (np.abs(made) > most).any(axis=1)


def exact_rows(column: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, whatever their size."""
    def whole(x: float) -> int:
        top, bottom = float(x).as_integer_ratio()
        return top * scale // bottom
    out = np.empty((len(column), len(column.iloc[0]) if len(column) else 0), dtype=object)
    for i, row in enumerate(column):
        out[i] = [whole(x) for x in row]
    return out


def told(score: int) -> tuple[int, str]:
    """The score as a long and, beyond that, as text in the same order."""
    if -LONG <= score <= LONG:
        return score, ""
    digits = str(abs(score))
    if score > 0:
        return LONG, f"1{len(digits):05d}{digits}"
    return -LONG - 1, f"0{DIGITS - len(digits):05d}" + "".join(str(9 - int(d)) for d in digits)


def read_back(score: str, big: str) -> int:
    if not big:
        return int(score)
    if big[0] == "1":
        return int(big[6:])
    return -int("".join(str(9 - int(d)) for d in big[6:]))


def lists(queries: np.ndarray, vectors: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial products of all pairs, one matrix per slice."""
    step = -(-queries.shape[1] // slices)
    return [queries[:, j:j + step] @ vectors[:, j:j + step].T for j in range(0, queries.shape[1], step)]


def best_columns(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest finite entries, ties to the first column."""
    scores, rows, columns = scores.copy(), [], []
    every = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        there = np.flatnonzero(scores[every, at] > -np.inf)
        rows.append(there)
        columns.append(at[there])
        scores[every, at] = -np.inf
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (every[:0], every[:0])


def named_pairs(entries: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: pairs that some list has among a query's k best."""
    out = np.zeros(allowed.shape, dtype=bool)
    for e in entries:
        out[best_columns(np.where(allowed, e, -np.inf), k)] = True
    return out


def possible_pairs(entries: list[np.ndarray], allowed: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Phase 2: pairs that the uniform threshold ``cuts / lists`` does not rule out.
    A query without a cutoff (minus infinity) keeps all of its pairs."""
    n, cut = len(entries), cuts[:, None]
    known, missing, given = 0, 0, np.zeros(allowed.shape, dtype=bool)
    for e in entries:
        sent = e * n >= cut
        given |= sent
        known = known + np.where(sent, e, 0)
        missing = missing + ~sent
    open_ = cuts == -np.inf
    reach = known * n + missing * np.where(open_, 0, cuts)[:, None] >= np.where(open_, 0, cuts)[:, None] * n
    return allowed & (open_[:, None] | (given & reach))


def uniform_threshold_topk(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, slices: int = 2,
                           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products.

    Queries are the rows whose id is divisible by ``query_every``; candidates
    are all rows with another id and as many components.  Null vectors, empty
    ones, those with null or non-finite components and rows with a null id
    take no part; repeated rows each count (as query and as candidate);
    ties go to the smaller id.  Tables without queries or candidates give no
    rows; other columns are ignored.  Components and scores of any size are
    exact; a score beyond a long ranks by its true value and is returned as the
    nearest long.
    """
    usable_rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
                   .where(usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))
                   .withColumn("row", F.monotonically_increasing_id()))
    base = materialize(usable_rows, "vectors")
    is_query = F.col("vec_id") % query_every == 0
    n = base.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    groups, n_blocks = blocks(n["q"], QUERY_GROUP), blocks(n["n"], VECTOR_BLOCK)
    queries = materialize(base.where(is_query).select(F.col("row").alias("qrow"), F.col("vec_id").alias("query_id"), "v", "dim",
                                                      block_of(groups, "row").alias("qg")), "queries")

    def cells(side: DataFrame, other: str, count: int):
        keyed = side.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        return keyed.groupBy("qg", "vb", "dim")

    def scored(qs: pd.DataFrame, vs: pd.DataFrame, chosen) -> Iterator[pd.DataFrame]:
        """The k best of the pairs that ``chosen(entries, allowed, cuts)`` leaves, per query."""
        (qi, q_big), (vi, v_big) = integer_rows(qs["v"], scale), integer_rows(vs["v"], scale)
        for large_q in (False, True):
            for large_v in (False, True):
                q, v = qs[q_big == large_q], vs[v_big == large_v].sort_values("vec_id", kind="stable")
                if not len(q) or not len(v):
                    continue
                exact = large_q or large_v
                vm = exact_rows(v["v"], scale) if exact else vi[v.index]
                ids = v["vec_id"].to_numpy()
                for at in range(0, len(q), QUERY_BLOCK):
                    part = q.iloc[at:at + QUERY_BLOCK]
                    entries = lists(exact_rows(part["v"], scale) if exact else qi[part.index], vm, slices)
                    allowed = ids[None, :] != part["query_id"].to_numpy()[:, None]
                    cuts = np.array([-np.inf if c is None else read_back(c, b) if exact else float(read_back(c, b))
                                     for c, b in zip(part["cut"], part["big"])], dtype=object if exact else np.float64)
                    whole = np.where(chosen(entries, allowed, cuts), sum(entries[1:], entries[0]), -np.inf)
                    rows, columns = best_columns(whole, k)
                    pairs = [told(int(s)) for s in whole[rows, columns]]
                    if pairs:
                        yield pd.DataFrame({"_qrow": part["qrow"].to_numpy()[rows], "query_id": part["query_id"].to_numpy()[rows],
                                            "vec_id": ids[columns], "score": np.array([s for s, _ in pairs], dtype=np.int64),
                                            "big": [b for _, b in pairs]})

    def phase(queries: DataFrame, chosen) -> DataFrame:
        def cell(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
            found = list(scored(qs.reset_index(drop=True), vs.reset_index(drop=True), chosen)) if len(qs) and len(vs) else []
            return pd.concat(found) if found else pd.DataFrame(columns=["_qrow", "query_id", "vec_id", "score", "big"])

        others = base.withColumn("vb", block_of(n_blocks, "row")).select("vb", "dim", "vec_id", "v")
        found = (cells(queries, "vb", n_blocks).cogroup(cells(others, "qg", groups))
                 .applyInPandas(cell, "_qrow bigint, query_id bigint, vec_id bigint, score bigint, big string"))
        best = Window.partitionBy("_qrow").orderBy(F.col("score").desc(), F.col("big").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = phase(queries.withColumn("cut", F.lit(None).cast("string")).withColumn("big", F.lit("")),
                  lambda entries, allowed, _: named_pairs(entries, allowed, k))
    # The safe cutoff: one number per query, sent along with it.  Where fewer than k
    # pairs were scored there is none, and all pairs are resolved.
    cutoff = first.where(F.col("rank") == k).select(F.col("_qrow").alias("qrow"), F.col("score").cast("string").alias("cut"), "big")
    limited = materialize(queries.join(cutoff, "qrow", "left").withColumn("big", F.coalesce("big", F.lit(""))), "cutoff")
    return phase(limited, possible_pairs).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
