"""What a batch of messages does to each inode, without walking through them.

An inode's state only moves forward inside a batch: its file is ingested at the
first ingest message that finds an object, its path changes at the first move,
vectors are there from the first embedding of a phase on (before and after that
ingest), and nothing happens from its deletion on.  These moments are minima
over its messages, so one aggregation per step gives them, whatever number of
messages an id has, and what each message finds follows by comparing its ``seq``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import messages as M
from ..session import materialize

NEVER = (1 << 63) - 1
# Steps of one message, in order: an ingest is followed by its embedding, that by indexing.
INGEST, EMBED, INDEX = 0, 1, 2


def first(seq: Column, when: Column) -> Column:
    """Smallest ``seq`` for which ``when`` holds, NEVER if there is none."""
    return F.coalesce(F.min(F.when(when, seq)), F.lit(NEVER))


def subtree_ends(inodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """(id, end): the first delete message that reaches an inode, its own or one
    of a folder above it.  Only folders that were deleted are walked down."""
    edges = inodes.where(F.col("parent_id").isNotNull()).select(F.col("id").alias("_child"), F.col("parent_id").alias("id"))
    ends = frontier = materialize(deleted.groupBy("id").agg(F.min("end").alias("end")), "ends")
    while True:
        below = frontier.join(edges, "id").groupBy(F.col("_child").alias("id")).agg(F.min("end").alias("end"))
        known = ends.select("id", F.col("end").alias("_known"))
        frontier = materialize(below.join(known, "id", "left").where(F.col("_known").isNull() | (F.col("end") < F.col("_known")))
                               .select("id", "end"), "below")
        if not frontier.limit(1).count():
            return ends
        ends = materialize(ends.unionByName(frontier).groupBy("id").agg(F.min("end").alias("end")), "ends")


def phase_of(seq: Column) -> Column:
    """True in an inode's last phase: from its ingest on, or all along without one."""
    return (F.col("ingest_at") == NEVER) | (seq >= F.col("ingest_at"))


def error_at(seq: Column) -> Column:
    return F.when(seq >= F.col("ingest_at"), F.col("error_after")).otherwise(F.col("error"))


def embed_events(messages: DataFrame, facts: DataFrame, chained: bool) -> DataFrame:
    """Embed messages and, if this worker goes on by itself, ingests that were
    processed: (seq, id, late, outcome), outcome being ok or a dead letter's reason."""
    asked = (F.col("task") == "embed_inode") | (F.lit(chained) & (F.col("task") == "ingest_inode") & F.col("has_object"))
    seq = F.col("seq")
    failed = F.when(phase_of(seq), F.col("failed_late")).otherwise(F.col("failed_early"))
    outcome = (F.when(error_at(seq).isNotNull(), "errored_inode").when(failed, "embedding_failed").otherwise("ok"))
    return (messages.join(facts, "id").where(asked & (seq < F.col("end")))
            .select("seq", "id", phase_of(seq).alias("late"), outcome.alias("outcome")))


def index_events(messages: DataFrame, facts: DataFrame, embedded: DataFrame, chained: bool) -> DataFrame:
    """(seq, id, late): index messages and the follow-ups of share, of a move that
    changed the path and of embeddings."""
    seq = F.col("seq")
    own = F.col("task") == "index_inode"
    led = (F.col("task") == "share_inode") | ((F.col("task") == "move_inode") & (seq == F.col("move_at")))
    asked = messages.join(facts, "id").where((seq < F.col("end")) & (own | led if chained else own)).select("seq", "id", phase_of(seq).alias("late"))
    return asked.unionByName(embedded.where(F.col("outcome") == "ok").select("seq", "id", "late")) if chained else asked


def outcomes(messages: DataFrame, facts: DataFrame, embeds: DataFrame, indexes: DataFrame, has_source: bool) -> dict[str, DataFrame]:
    """followups, notifications and dead letters of every message.

    ``facts`` has one row per inode of the batch: its row, ``end``, ``ingest_at``,
    ``move_at``, ``embed_early`` and ``embed_late`` (first embeddings), and
    ``open_*`` (whether pages lack vectors before and after those)."""
    seq = F.col("seq")
    # Is a page without a vector in the way at an index event?
    late = F.when(F.col("embed_late") <= seq, F.col("open_late_after")).otherwise(F.col("open_late"))
    early = F.when(F.col("embed_early") <= seq, F.col("open_early_after")).otherwise(F.col("open_early"))
    indexed = indexes.join(facts, "id").withColumn("open", F.when(F.col("late"), late).otherwise(early))
    index_at = indexed.where(~F.col("open")).groupBy("id").agg(F.min("seq").alias("index_at"))
    facts = facts.join(index_at, "id", "left").withColumn("index_at", F.coalesce("index_at", F.lit(NEVER)))

    def reached(at: str, step: int, own: int) -> Column:
        return (F.col(at) < seq) | ((F.col(at) == seq) & F.lit(own <= step))

    def noted(done: DataFrame, task: str, step: int) -> DataFrame:
        state = done.select("seq", "id").join(facts, "id")
        ready = (F.col("is_uploaded") & (F.col("is_ingested") | (F.col("ingest_at") <= seq))
                 & (F.col("is_embedded") | reached("embed_early", step, EMBED) | reached("embed_late", step, EMBED))
                 & (F.col("is_indexed") | reached("index_at", step, INDEX)))
        return M.notifications(state.select("seq", "id", ready.alias("is_ready"), error_at(seq).alias("error"), "is_public", "owner_id"), task)

    known = messages.join(facts, "id")
    alive = known.where(seq < F.col("end"))
    gone = (messages.join(facts.select("id", "end"), "id", "left").where((F.col("task") != "delete_inode") & (F.coalesce("end", F.lit(-NEVER)) <= seq))
            .select("seq", F.col("task").alias("routing_key"), F.lit("missing_inode").alias("reason")))
    ingests = alive.where(F.col("task") == "ingest_inode")
    ingested = ingests.where(F.col("has_object"))
    lost = ingests.where(~F.col("has_object")).select("seq", F.lit("ingest_inode").alias("routing_key"),
                                                     F.lit("missing_object" if has_source else "no_object_source").alias("reason"))
    embedded = embeds.where(F.col("outcome") == "ok")
    moved = alive.where((F.col("task") == "move_inode") & (seq == F.col("move_at")))
    shared = alive.where(F.col("task") == "share_inode")
    done = {"ingest_inode": ingested, "embed_inode": embedded, "move_inode": moved, "share_inode": shared}
    followups = [M.followups(df.select("seq", "id"), task) for task, df in done.items()]
    notes = [noted(ingested, "ingest_inode", INGEST), noted(embedded, "embed_inode", EMBED),
             noted(indexed.where(~F.col("open")), "index_inode", INDEX)]
    letters = [gone, lost,
               embeds.where(F.col("outcome") != "ok").select("seq", F.lit("embed_inode").alias("routing_key"), F.col("outcome").alias("reason")),
               indexed.where(F.col("open")).select("seq", F.lit("index_inode").alias("routing_key"), F.lit("missing_embedding").alias("reason"))]
    return {"followups": reduce(DataFrame.unionByName, followups), "notifications": reduce(DataFrame.unionByName, notes), "dead_letters": M.dead_letters(*letters),
            "facts": facts, "shared": shared, "moved": moved}
