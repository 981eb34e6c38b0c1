"""Contiguous shards of near-equal bytes from global size prefix sums.

Only keys and sizes are moved: rows are range-partitioned in (id, checksum)
order, each partition's total goes into one small prefix table (one row per
partition), and every row's global byte offset decides its shard.  The text
itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

_ROW_BITS = (1 << 33) - 1     # monotonically_increasing_id: row number inside the partition


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)


def prefix_positions(keys: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """Add ``row_before`` (rows before this one in ``order``) and ``rows_all``;
    with a ``weight`` column also ``weight_before`` and ``weight_all``.

    Rows equal in every ordering column are spread by a random salt, so a key
    that holds a third of all rows fills many partitions.  The ranged rows are
    written once: sampling bounds twice could place rows differently.
    """
    ranged = (keys.withColumn("_salt", F.rand(20))
              .repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col("_salt"))
              .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order], "_salt")
              .withColumn("_mid", F.monotonically_increasing_id()).drop("_salt"))
    ranged = (materialize(ranged, "ranged")
              .withColumn("_part", F.shiftright("_mid", 33))
              .withColumn("_row", F.col("_mid").bitwiseAND(F.lit(_ROW_BITS))))
    by = F.col(weight) if weight else F.lit(0)
    totals = ranged.groupBy("_part").agg(F.sum(by).alias("_w"), F.count(F.lit(1)).alias("_n"))
    # One row per partition of the range step: the ordered window below is
    # bounded by the partition count, never by the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("_part",
                            F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w_off"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_off"),
                            F.sum("_w").over(everything).alias("weight_all"),
                            F.sum("_n").over(everything).alias("rows_all"))
    placed = (ranged.join(F.broadcast(offsets), "_part")
              .withColumn("row_before", F.col("_n_off") + F.col("_row")))
    if weight:
        inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("weight_before", F.col("_w_off") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    else:
        placed = placed.drop("weight_all")
    return placed.drop("_mid", "_part", "_row", "_w_off", "_n_off")


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut ``docs``, ordered by id, into ``n_shards`` contiguous shards at equal
    byte targets.  Returns id, size, text_crc32, shard, slot.

    A row whose first byte lies in the k-th of ``n_shards`` equal parts of all
    bytes goes to shard k, so each shard is off its target by less than one
    document.  Null ids come first; a null or empty text has size 1; rows
    with equal ids are ordered by size and checksum, and fully equal rows are
    interchangeable; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).alias("_id"), text_size(F.col(text_col)).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    at = prefix_positions(keys, ["_id", "size", "text_crc32"], "size")
    placed = at.withColumn("shard", F.least(F.expr(f"(weight_before * {n_shards}) div weight_all"),
                                            F.lit(n_shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("row_before").alias("_first"))     # one row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("row_before") - F.col("_first")).alias("slot")))
