"""Blocks of vectors for numpy work inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """True for a non-empty vector of finite, non-null components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return np.array(column.tolist(), dtype=dtype) if len(column) else np.zeros((0, 0), dtype=dtype)


def blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def block_of(n: int, *cols: str) -> Column:
    """Even block number 0..n-1 from a hash of the row (hot values spread by id)."""
    return F.pmod(F.xxhash64(*cols, F.lit(n)), F.lit(n)).cast("int")


def largest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def top_rows(found: DataFrame, k: int, query: str = "query_id", score: str = "score", key: str = "vec_id") -> DataFrame:
    """The k best rows per query with ``rank`` from 1.  Inputs are block-wise
    top-k lists, so a query brings at most k rows per block; the native
    ``row_number() <= k`` filter cuts each task's share before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy("_qrow").orderBy(F.col(score).desc(), F.col(key))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(query, F.col("rank").cast("int").alias("rank"), key, score))
