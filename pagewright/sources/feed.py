"""Change feed: routing key + JSON body, as a batch table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of feed files (JSON lines with seq, ts, routing_key, body)."""
    return spark.read.schema(schemas.FEED).json(path)


def read_feed_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Streaming read of the same files.  ``max_files`` bounds one micro-batch
    (the worker took one message at a time; a batch here holds many).
    The same ``decode_messages`` applies to a Kafka ``value`` column."""
    return (spark.readStream.schema(schemas.FEED)
            .option("maxFilesPerTrigger", max_files)
            .json(path))


def decode_messages(feed: DataFrame) -> DataFrame:
    """Parse ``body`` into after/before fields.

    Adds ``id`` (after.id, else before.id), the before image, and
    ``bad_body`` for bodies that parse to neither form.
    """
    parsed = F.from_json(F.col("body"), schemas.BODY)
    return (feed.withColumn("_b", parsed)
            .withColumn("after_id", F.col("_b.after.id"))
            .withColumn("before_id", F.col("_b.before.id"))
            .withColumn("before_type", F.col("_b.before.type"))
            .withColumn("before_owner_id", F.col("_b.before.owner_id"))
            .withColumn("before_path", F.col("_b.before.path"))
            .withColumn("id", F.coalesce(F.col("after_id"), F.col("before_id")))
            .withColumn("bad_body", F.col("id").isNull())
            .drop("_b"))


def encode_after(id_col) -> F.Column:
    """Message body ``{"after":{"id":...}}``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.to_json(F.struct(F.struct(c.alias("id")).alias("after")))
