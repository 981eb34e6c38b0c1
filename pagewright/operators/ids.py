"""Dense positions, identity ids, per-key batches and latest-row-per-key.

A global ``row_number()`` without ``PARTITION BY`` pulls every row into one
task, and ``row_number() OVER (PARTITION BY key)`` puts a hot key into one
task.  The helpers here avoid both: rows are range-partitioned and sorted,
frozen by a reliable checkpoint, numbered inside each partition, and shifted
by the row counts of the partitions before them (one small row per
partition).  A key spread over several partitions is still numbered right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1   # monotonically_increasing_id keeps the row number in the low 33 bits


def global_positions(df: DataFrame, order_cols: list, pos_col: str = "_pos") -> DataFrame:
    """Add a dense 0-based position following ``order_cols`` (which should be
    a total order).  Work is spread over all partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (df.orderBy(*order_cols)
               .withColumn("_mid", F.monotonically_increasing_id()))
    # Range bounds come from sampling; freeze the rows so both uses below see
    # the same partitions (and a lost executor recomputes nothing).
    ordered = ordered.checkpoint(eager=True)
    ordered = ordered.withColumn("_part", F.shiftright(F.col("_mid"), 33))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the running sum below is bounded by the
    # partition count, never by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ordered.join(F.broadcast(offsets), "_part")
            .withColumn(pos_col, F.col("_off") + (F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
            .drop("_mid", "_part", "_off"))


def assign_ids(df: DataFrame, order_cols: list, start=1, id_col: str = "id") -> DataFrame:
    """Identity column: ``start``, ``start+1``, ... in ``order_cols`` order.

    ``start`` may be an int or a one-value Column (e.g. a scalar subquery of
    ``max(id) + 1`` over the current table)."""
    start_col = start if isinstance(start, Column) else F.lit(start)
    pos = global_positions(df.drop(id_col) if id_col in df.columns else df, order_cols)
    return pos.withColumn(id_col, (start_col + F.col("_pos")).cast("bigint")).drop("_pos")


def assign_batches(df: DataFrame, key: str = "inode_id", order: str = "index", size: int = 64,
                   tiebreak: str = "id") -> DataFrame:
    """Number the rows of each ``key`` in ``order`` and cut them into batches
    of at most ``size``: adds ``rn`` (1-based), ``batch`` and ``pos_in_batch``.

    The first position of each key is a grouped ``min`` (combined map-side),
    so a key holding a third of all rows is split over many tasks."""
    pos = global_positions(df, [key, order, tiebreak])
    first = pos.groupBy(key).agg(F.min("_pos").alias("_first"))
    out = pos.join(first, key).withColumn("rn", F.col("_pos") - F.col("_first") + 1)
    return (out.withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("int"))
            .withColumn("pos_in_batch", ((F.col("rn") - 1) % size).cast("int"))
            .drop("_pos", "_first"))


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (a total order).

    Written as ``max_by`` so each task keeps one row per key before the
    shuffle; a hot key costs one row per task, not a task of its own."""
    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")
