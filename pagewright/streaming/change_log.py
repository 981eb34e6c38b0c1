"""The worker's tables as partitioned Parquet of changes.

Every table is rows of changes under ``bucket=/query=/batch=``: the seed, and what
each micro-batch of each streaming query changed, stamped with the feed's ``seq``
(``version``).  A batch that runs again overwrites its own partitions (Spark's
dynamic partition overwrite) and nothing else, so replays change nothing and workers never
touch each other's files.  Reading folds the changes per key; the feed's
order decides, not the order in which workers came to it.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..session import materialize

ROWS_PER_BUCKET = 500_000
# So many ids go to every task (about 30 MB there); more are joined by a shuffle.
FEW_IDS = 500_000
SEED_VERSION = -1
TABLE_SCHEMAS = {"inodes": schemas.INODES, "pages": schemas.PAGES, "docs": schemas.DOCS}
KEYS = {"inodes": ["id"], "pages": ["inode_id", "index"], "docs": ["doc_id"]}
# Columns whose first value stays: a page keeps its id and its vector.
KEEPS_FIRST = {"pages": ["id", "embedding"]}


def owner_of(table: str) -> Column:
    """The inode id that a row of ``table`` belongs to."""
    return {"inodes": F.col("id"), "pages": F.col("inode_id"), "deleted": F.col("id"),
            "docs": F.coalesce("parent_id", "doc_id").cast("bigint")}[table]


# Where that is a plain column; the joins by it then serve what groups by it.
OWNER_COLUMNS = {"inodes": "id", "pages": "inode_id", "deleted": "id"}


def _with_partitions(fields) -> T.StructType:
    loose = [T.StructField(f.name, f.dataType) for f in fields]
    return T.StructType(loose + [T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType()),
                                 T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())])


CHANGE_SCHEMAS = {t: _with_partitions(s.fields) for t, s in TABLE_SCHEMAS.items()}
CHANGE_SCHEMAS["deleted"] = _with_partitions([T.StructField("id", T.LongType())])


class FeedTables:
    """The tables and outputs of a feed under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    @property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.root}/layout").first()["buckets"]

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(self.buckets)).cast("int")

    def changes(self, table: str, without: tuple[str, int] | None = None) -> DataFrame:
        """All changes of a table; ``without`` leaves out a batch that is being run (again)."""
        path, schema = f"{self.root}/{table}", CHANGE_SCHEMAS[table]
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(path)
        if without:
            rows = rows.where(~((F.col("query") == without[0]) & (F.col("batch") >= without[1])))
        return rows

    def read(self, table: str, touched: DataFrame | None = None, buckets: list[int] | None = None,
             without: tuple[str, int] | None = None, added: DataFrame | None = None,
             prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The table as the changes make it, of the inodes ``touched`` (in ``buckets``) or of all.

        ``added`` are changes that are not written yet.  ``prepare`` changes columns row by
        row before the changes are folded, so what it leaves out is not shuffled."""
        rows = self._changes_of(table, touched, buckets, without, added, prepare, by_owner=table == "pages")
        keys, first = KEYS[table], KEEPS_FIRST.get(table, [])
        names = [f.name for f in TABLE_SCHEMAS[table].fields if f.name not in keys]

        def folded(name: str) -> Column:
            # A document is replaced as a whole, with its nulls; other rows column by column.
            at = F.col("version") if table == "docs" else F.when(F.col(name).isNotNull(), F.col("version"))
            return (F.min_by if name in first else F.max_by)(name, at).alias(name)

        return rows.groupBy(*keys).agg(*[folded(n) for n in names]).select(*[f.name for f in TABLE_SCHEMAS[table].fields])

    def _changes_of(self, table: str, touched: DataFrame | None, buckets: list[int] | None,
                    without: tuple[str, int] | None, added: DataFrame | None = None,
                    prepare: Callable[[DataFrame], DataFrame] | None = None, by_owner: bool = False) -> DataFrame:
        """Changes of the inodes ``touched`` (or of all) that are not deleted.  ``by_owner``
        leaves those of ``touched`` dealt out by inode, for joins and the fold to come."""
        rows, gone = self.changes(table, without), self.changes("deleted", without)
        if buckets is not None:
            rows, gone = rows.where(F.col("bucket").isin(buckets)), gone.where(F.col("bucket").isin(buckets))
        if added is not None:
            rows = rows.unionByName(added, allowMissingColumns=True)
        owner = OWNER_COLUMNS.get(table, "_owner")
        if owner == "_owner":
            rows = rows.withColumn("_owner", owner_of(table))
        rows = rows if prepare is None else prepare(rows)
        gone = gone.select(F.col("id").alias(owner))
        if touched is None:
            return rows.join(gone, owner, "left_anti")
        # The deleted leave the ids, so the rows, which may be wide, meet one join only.
        ids = touched.select(F.col("id").alias(owner)).distinct().join(gone, owner, "left_anti")
        if not by_owner:
            return rows.join(ids, owner, "left_semi")
        # One shuffle of the rows: of those wanted, or of all before a join that needs it too.
        ids = materialize(ids, "wanted")
        if ids.count() > FEW_IDS:
            ids = materialize(ids.join(rows.select(owner), owner, "left_semi"), "wanted")
        if ids.count() > FEW_IDS:
            return rows.repartition(owner).join(ids, owner, "left_semi")
        return rows.join(F.broadcast(ids), owner, "left_semi").repartition(owner)

    def bare_pages(self, touched: DataFrame, buckets: list[int], without: tuple[str, int] | None = None) -> DataFrame:
        """The pages without a vector of the inodes ``touched``.  No change of such a page has
        a vector, so the texts of the others are not shuffled."""
        rows, keys = self._changes_of("pages", touched, buckets, without), KEYS["pages"]
        bare, filled = rows.where(F.col("embedding").isNull()), rows.where(F.col("embedding").isNotNull()).select(*keys)
        at = F.col("version")
        return (bare.groupBy(*keys).agg(F.min_by("id", F.when(F.col("id").isNotNull(), at)).alias("id"),
                                        F.max_by("contents", F.when(F.col("contents").isNotNull(), at)).alias("contents"))
                .join(filled, keys, "left_anti")
                .select("id", *keys, "contents", F.lit(None).cast(schemas.VECTOR).alias("embedding")))

    def output(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/out/{name}").parquet(f"{self.root}/out/{name}")

    def applied(self, query: str, batch: int) -> bool:
        return self._exists(f"{self.root}/applied/query={query}/batch={batch}/_SUCCESS")

    def write(self, table: str, rows: DataFrame, query: str, batch: int) -> None:
        """The changes of one batch, over those that an earlier run of it left."""
        names = [f.name for f in CHANGE_SCHEMAS[table].fields][:-3]
        kinds = {f.name: f.dataType for f in CHANGE_SCHEMAS[table].fields}
        cols = [(F.col(n) if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names]
        (rows.select(*cols, self.bucket(owner_of(table)).alias("bucket"), F.lit(query).alias("query"), F.lit(batch).cast("bigint").alias("batch"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket", "query", "batch")
         .parquet(f"{self.root}/{table}"))

    def write_output(self, name: str, rows: DataFrame, query: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/out/{name}/query={query}/batch={batch}", compression="zstd")

    def finish(self, query: str, batch: int) -> None:
        """Mark a batch as whole; until then it is not seen as applied and runs again."""
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/applied/query={query}/batch={batch}")


def seed_store(tables: FeedTables, inodes: DataFrame, pages: DataFrame, docs: DataFrame | None = None,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Write the first state of all tables, each once; their size, counted before, sets
    the number of buckets."""
    spark = tables.spark
    given = {"inodes": inodes, "pages": pages, "docs": docs if docs is not None else spark.createDataFrame([], schemas.DOCS)}
    rows = sum(df.count() for df in given.values())
    spark.range(1).select(F.lit(max(1, -(-rows // rows_per_bucket))).alias("buckets")).write.parquet(f"{tables.root}/layout")
    for table, df in given.items():
        tables.write(table, df.withColumn("version", F.lit(SEED_VERSION)), "seed", 0)


def compact(tables: FeedTables, root: str) -> FeedTables:
    """A new store whose seed is the present state (run while no worker runs)."""
    out = FeedTables(tables.spark, root)
    seed_store(out, *(tables.read(t) for t in ("inodes", "pages", "docs")))
    return out
