"""Keyed table operations: lookup, upsert, flags, defaults, counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import is_ready as _is_ready
from ..session import materialize
from .ids import assign_ids, latest_by_key


def lookup_inodes(requests: DataFrame, inodes: DataFrame, key: str = "id"):
    """Requests with their inode (inner join) and requests whose id is gone.

    Returns ``(found, missing)``; ``missing`` feeds the dead-letter output
    (the worker's ``.one()`` raised for them)."""
    found = requests.join(inodes, key, "inner")
    missing = requests.join(inodes.select(key), key, "left_anti")
    return found, missing


def all_inode_ids(inodes: DataFrame) -> DataFrame:
    """Ids only; Parquet reads just that column."""
    return inodes.select("id")


def page_counts(pages: DataFrame, key: str = "inode_id") -> DataFrame:
    """Pages per document (partial counts are combined before the shuffle)."""
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("n_pages"))


def set_flags(inodes: DataFrame, ids: DataFrame | None = None, **flags) -> DataFrame:
    """Set boolean/int flags on the inodes listed in ``ids`` (all when None)
    and keep ``is_ready`` in step when the table carries it."""
    if ids is None:
        out = inodes
        for name, value in flags.items():
            out = out.withColumn(name, F.lit(value))
    else:
        hits = ids.select("id").distinct().withColumn("_hit", F.lit(True))
        out = inodes.join(hits, "id", "left")
        for name, value in flags.items():
            out = out.withColumn(name, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(name)))
        out = out.drop("_hit")
    if "is_ready" in out.columns:
        out = out.withColumn("is_ready", _is_ready())
    return out


def apply_defaults(df: DataFrame, table: str, now: dt.datetime | None = None) -> DataFrame:
    """Fill missing or NULL columns with the table's insert defaults and
    return the table's full column list.  ``now`` fixes the insert time."""
    schema = schemas.TABLES[table]
    defaults = schemas.DEFAULTS.get(table, {})
    now_col = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    cols = []
    for field in schema.fields:
        default = defaults.get(field.name)
        dflt = None if default is None else (now_col if default == "now" else F.lit(default))
        if field.name in df.columns:
            c = F.col(field.name).cast(field.dataType)
            if dflt is not None:
                c = F.coalesce(c, dflt.cast(field.dataType))
        else:
            c = (dflt if dflt is not None else F.lit(None)).cast(field.dataType)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def upsert_pages(current: DataFrame, incoming: DataFrame, reset_embedding_on_change: bool = False,
                 prune: bool = False, order: list[str] | None = None, next_id: int | None = None) -> DataFrame:
    """Insert or update pages on (inode_id, index).

    A matching key keeps its id and embedding and takes the new contents
    (``reset_embedding_on_change`` clears a vector whose text changed).  New
    keys get fresh ids after the current maximum, in (inode_id, index) order.
    Pages of an incoming document that the new extraction no longer has are
    kept, or dropped with ``prune``.  ``incoming`` with repeated keys is
    reduced to the last row by ``order`` first.  ``next_id`` gives the first
    fresh id when ``current`` holds only part of the table.
    """
    keys = ["inode_id", "index"]
    inc = incoming.select(*keys, *(order or []), F.col("contents"))
    if order:
        inc = latest_by_key(inc, keys, order).select(*keys, "contents")
    # Written once: the new texts are read for the pages they replace and for those they add.
    inc = materialize(inc.select(*keys, F.col("contents").alias("_new"), F.lit(True).alias("_in")), "incoming", "zstd")
    # The table's texts and vectors are shuffled once, for this join; the keys
    # that are new are found from the keys alone.
    kept = current.select("id", *keys, "contents", "embedding").join(inc, keys, "left")
    if prune:
        # The old pages of incoming documents that the new extraction no longer has.
        touched = inc.select("inode_id").distinct().withColumn("_touched", F.lit(True))
        kept = kept.join(touched, "inode_id", "left").where(F.col("_in").isNotNull() | F.col("_touched").isNull())
    emb = F.col("embedding")
    if reset_embedding_on_change:
        emb = F.when(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("contents")),
                     F.lit(None)).otherwise(emb)
    kept = kept.select("id", *keys, F.coalesce("_new", "contents").alias("contents"), emb.alias("embedding"))
    fresh = inc.join(current.select(*keys), keys, "left_anti").select(
        *keys, F.col("_new").alias("contents"), F.lit(None).cast(current.schema["embedding"].dataType).alias("embedding"))
    if next_id is None:
        next_id = (current.agg(F.max("id")).first()[0] or 0) + 1
    fresh = assign_ids(fresh, keys, start=next_id).select("id", *keys, "contents", "embedding")
    return kept.unionByName(fresh)
