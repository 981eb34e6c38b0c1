"""Change-feed dispatch: routing, follow-up messages, notifications, dead
letters.  All of it is projection and filtering over decoded messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import notifiable
from ..sources.feed import encode_after


def route(decoded: DataFrame) -> DataFrame:
    """Add ``task`` (the routing key when known) and ``status``:
    ok, unknown_key or bad_body."""
    known = F.col("routing_key").isin(schemas.ROUTING_KEYS)
    need_before = F.col("routing_key") == "delete_inode"
    has_body = F.when(need_before, F.col("before_id").isNotNull()).otherwise(F.col("after_id").isNotNull())
    return (decoded.withColumn("task", F.when(known, F.col("routing_key")))
            .withColumn("status", F.when(~known, F.lit("unknown_key"))
                        .when(~has_body, F.lit("bad_body"))
                        .otherwise(F.lit("ok"))))


def followups(done: DataFrame, task: str) -> DataFrame:
    """Messages a finished task publishes: ingest -> embed_inode; embed, move
    and share -> index_inode.  ``done`` holds (seq, id) of the messages that
    completed (a move only when its path changed)."""
    nxt = {"ingest_inode": "embed_inode", "embed_inode": "index_inode",
           "move_inode": "index_inode", "share_inode": "index_inode"}[task]
    return done.select("seq", F.lit(nxt).alias("routing_key"), encode_after("id").alias("body"))


def notifications(done: DataFrame, task: str) -> DataFrame:
    """User notices ``{"id","task"}`` when the inode is ready or errored; the
    channel is 'public' for public inodes, else 'user-{owner}'.  ``done``
    holds the inode row after the task (is_ready, error, is_public,
    owner_id)."""
    channel = F.when(F.col("is_public"), F.lit("public")).otherwise(
        F.concat(F.lit("user-"), F.col("owner_id").cast("string")))
    body = F.to_json(F.struct(F.col("id"), F.lit(task).alias("task")))
    return (done.where(notifiable(F.col("is_ready"), F.col("error")))
            .select("seq", "id", channel.alias("channel"), body.alias("body")))


def dead_letters(*parts: DataFrame) -> DataFrame:
    """Union of failed messages, each part carrying (seq, routing_key, reason)."""
    out = parts[0].select("seq", "routing_key", "reason")
    for p in parts[1:]:
        out = out.unionByName(p.select("seq", "routing_key", "reason"))
    return out
