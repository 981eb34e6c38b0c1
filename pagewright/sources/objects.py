"""Object bytes: Spark's binaryFile source, keyed like the object store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_objects(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Read files under ``root`` as (key, modificationTime, length, content).

    ``key`` is the path below ``root``; with the bucket layout mirrored it is
    ``users/{owner}{path}`` and joins to :func:`pagewright.functions.object_path`.
    Files are split over tasks by Spark; bytes never pass through the driver.  Folders are
    listed, and small files read, many to a task: their number does not set that of the tasks.
    """
    root = root.rstrip("/")
    bare = root.split(":", 1)[1] if root.startswith(("file:", "hdfs:", "s3a:", "abfss:", "gs:")) else root
    tasks = 4 * spark.sparkContext.defaultParallelism
    given = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(tasks))
    try:
        df = (spark.read.format("binaryFile")
              .option("pathGlobFilter", glob)
              .option("recursiveFileLookup", str(recursive).lower())
              .load(root))
    finally:
        if given is None:
            spark.conf.unset(LISTING)
        else:
            spark.conf.set(LISTING, given)
    # Spark counts a file as 4 MB at least; as many tasks as the bytes need are enough.
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    a_task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    df = df.coalesce(max(tasks, -(-size // a_task)))
    key = F.regexp_extract(F.col("path"), r"\Q" + bare + r"\E/(.*)$", 1)
    return df.select(key.alias("key"), "modificationTime", "length", "content")
