"""Relational tables: Parquet by default, JDBC with the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


def read_table(spark: SparkSession, name: str, base: str) -> DataFrame:
    """Read table ``name`` stored as Parquet under ``base``.

    ``name`` is a table (``base/name.parquet``) or a version folder written
    by :func:`write_table` (``"inodes/v00000001"``); the table's explicit
    schema keeps the types fixed.
    """
    reader = spark.read
    table = name.split("/", 1)[0]
    if table in schemas.TABLES:
        reader = reader.schema(schemas.TABLES[table])
    path = f"{base.rstrip('/')}/{name}"
    return reader.parquet(path if "/" in name else f"{path}.parquet")


def write_table(df: DataFrame, name: str, base: str, version: int) -> str:
    """Write a new version of a table; a path being read is never overwritten."""
    path = f"{base.rstrip('/')}/{name}/v{version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_jdbc_table(spark: SparkSession, name: str, url: str, schema_name: str = "private",
                    properties: dict | None = None, column: str = "id", partitions: int | None = None) -> DataFrame:
    """Same table from a relational database over JDBC (needs the driver jar).

    The bounds of the numeric key ``column`` are asked of the database first,
    and the table is read in ``partitions`` key ranges (the session's shuffle
    partitions unless given), one task each."""
    source, properties = f"{schema_name}.{name}", properties or {}
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = spark.read.jdbc(url, f"(SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) AS bounds",
                                properties=properties).first()
    if low is None or n < 2:
        return spark.read.jdbc(url, source, properties=properties)
    return spark.read.jdbc(url, source, column=column, lowerBound=int(low), upperBound=int(high) + 1,
                           numPartitions=n, properties=properties)


class TestTables:
    """The driver's test tables at one scale factor, plus the fixture views of
    FIXTURES.md built from them.  Every access builds a fresh, lazy plan:
    nothing is cached, and no executed DataFrame object is reused inside a
    later plan (Spark 4.1 can fail to re-optimise such a union)."""

    BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
            "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TestTables.BASE:
            return self.base(name)
        raise AttributeError(name)

    # Fixture views ---------------------------------------------------------
    @property
    def fx_users(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_users(self)

    @property
    def fx_inodes(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_inodes(self)

    @property
    def fx_pages(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_pages(self)

    @property
    def fx_objects(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_objects(self)

    @property
    def fx_messages(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_messages(self)

    @property
    def fx_prompts(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_prompts(self)

    @property
    def fx_conversations_inodes(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_conversations_inodes(self)

    @property
    def fx_inodes_bad(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_inodes_bad(self)

    @property
    def fx_pages_bad(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_pages_bad(self)

    @property
    def fx_links_bad(self) -> DataFrame:
        from . import fixtures
        return fixtures.fx_links_bad(self)
