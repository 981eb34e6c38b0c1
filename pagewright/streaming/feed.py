"""The worker loop as a streaming query.

``readStream`` of feed files -> ``foreachBatch``.  A micro-batch is decoded once, the
moments at which each inode changes are found by aggregation (see ``fold``), and
each kind of work is then done once for all inodes: early embedding, ingest, late
embedding, documents.  The number of Spark jobs does not depend on how many messages an
id has.  A finished task's follow-up is run at once (ingest, then embed, then index),
before the id's next message.  A delete ends the id and everything below it from its
``seq`` on: later messages for it are dead letters.

An inode's object is looked up under the path it has when the batch begins (the
manifest's moves are carried out after the batch).  An embedder that fails for an inode
fails for all its embed messages of that phase.

Tables are changes per (query, batch), see ``change_log``.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import is_file, non_empty, object_path, path_changed
from ..operators import embed as E
from ..operators import index as IX
from ..operators import messages as M
from ..operators.tree import resolve_paths_of
from ..plans import jobs as J
from ..session import materialize, work_dir
from ..sources.feed import decode_messages, read_feed_stream
from . import fold
from .change_log import FeedTables, compact, seed_store

ROWS_PER_FILE = 250_000
FACTS = ["id", "owner_id", "type", "path", "is_indexed", "is_public", "is_uploaded", "is_ingested", "is_embedded", "error"]


def _requests(ids: DataFrame) -> DataFrame:
    return ids.select(F.col("id").alias("seq"), "id").distinct()


def _open(pages: DataFrame, name: str) -> DataFrame:
    """Inodes with a page that should be indexed and has no vector."""
    return (pages.where(non_empty("contents") & F.col("embedding").isNull())
            .select(F.col("inode_id").alias("id"), F.lit(True).alias(name)).distinct())


def apply_batch(tables: FeedTables, feed: DataFrame, batch_id: int, objects: DataFrame | None = None,
                embedder: Callable | None = None, keys: list[str] | None = None, extractor: Callable | None = None,
                page_count: Callable | None = None, query_id: str = "batch", publish_dir: str | None = None) -> bool:
    """Apply one micro-batch of feed rows; False when ``query_id`` applied it before.

    With ``keys`` the worker takes only those routing keys; the others belong
    to another worker's queue (one worker at a time has the ingest key, which numbers
    new pages).  A follow-up whose key is another worker's is written to
    ``publish_dir`` (the folder that worker reads) as feed files.  Without
    ``objects`` an ingest message is a dead letter (``no_object_source``).
    """
    if tables.applied(query_id, batch_id):
        return False
    spark, here = tables.spark, (query_id, batch_id)
    mine = (lambda key: keys is None or key in keys)
    if keys is not None:
        feed = feed.where(F.col("routing_key").isin(keys))
    ident = F.when(F.col("routing_key") == "delete_inode", F.col("before_id")).otherwise(F.col("after_id"))
    # Read again by the tables' own session: a micro-batch's session plans without AQE.
    path = work_dir(spark, "decoded")
    (M.route(decode_messages(feed)).withColumn("id", ident)
     .select("seq", "routing_key", "id", "task", "status", "before_id", "before_type", "before_owner_id", "before_path")
     .write.parquet(path, compression="zstd"))
    decoded = spark.read.parquet(path)
    messages = decoded.where(F.col("status") == "ok").select("seq", "id", "task")
    tasks = {r["task"] for r in messages.select("task").distinct().collect()}
    nobody = spark.createDataFrame([], "id bigint")

    # The working set: the batch's inodes and what its deletes take along.
    whole = tables.read("inodes", without=here)
    deletes = messages.where(F.col("task") == "delete_inode").select("id", F.col("seq").alias("end"))
    ends = fold.subtree_ends(whole.select("id", "parent_id"), deletes) if "delete_inode" in tasks else nobody.withColumn("end", F.lit(0))
    touched = materialize(messages.select("id").union(ends.select("id")).distinct(), "touched")
    buckets = sorted(r[0] for r in touched.select(tables.bucket(F.col("id"))).distinct().collect())
    inodes = materialize(tables.read("inodes", touched, buckets, here), "inodes")

    # The moments of every inode.
    asked = (lambda task: messages.where(F.col("task") == task).select("id").distinct())
    moved = resolve_paths_of(whole, asked("move_inode")) if "move_inode" in tasks else nobody.withColumn("path", F.lit(""))
    keyed = inodes.join(asked("ingest_inode"), "id", "left_semi").select("id", object_path("owner_id", "path").alias("key"))
    held = nobody if objects is None else keyed.join(objects.select("key"), "key", "left_semi").select("id")
    facts = (inodes.select(*FACTS).join(ends, "id", "left").join(moved.select("id", F.col("path").alias("new_path")), "id", "left")
             .join(held.withColumn("has_object", F.lit(True)), "id", "left")
             .withColumn("has_object", F.coalesce("has_object", F.lit(False))).withColumn("end", F.coalesce("end", F.lit(fold.NEVER))))
    moves = F.col("new_path").isNotNull() & path_changed("new_path", "path") & (F.col("task") == "move_inode")
    moments = (messages.join(facts, "id").where(F.col("seq") < F.col("end")).groupBy("id")
               .agg(fold.first(F.col("seq"), (F.col("task") == "ingest_inode") & F.col("has_object")).alias("ingest_at"),
                    fold.first(F.col("seq"), moves).alias("move_at")))
    never = F.lit(fold.NEVER)
    facts = materialize(facts.join(moments, "id", "left").withColumn("ingest_at", F.coalesce("ingest_at", never))
                        .withColumn("move_at", F.coalesce("move_at", never)), "facts")
    known = messages.join(facts, "id").where(F.col("seq") < F.col("end"))

    def embedded(ids: DataFrame, inodes: DataFrame, pages: DataFrame, name: str) -> tuple[DataFrame | None, DataFrame]:
        """New vectors of the pages of ``ids`` by page id (None: no page needs one), and the ids that failed."""
        if not ids.limit(1).count():
            return None, nobody
        r = J.embed(_requests(ids), inodes, pages, embedder=embedder)
        lost = r["dead_letters"].where(F.col("reason") == "embedding_failed").select(F.col("seq").alias("id"))
        vectors = materialize(r["vectors"], name)
        return vectors if vectors.limit(1).count() else None, materialize(lost.distinct(), "failed")

    def attached(pages: DataFrame, vectors: DataFrame | None, name: str) -> DataFrame:
        return pages if vectors is None else materialize(E.attach_embeddings(pages, vectors), name, "zstd")

    # Embedding before the first ingest, ingest, embedding after it.  Only ingested inodes have
    # a time before; of the others only pages without a vector are needed before the documents.
    ingested = materialize(facts.where(F.col("ingest_at") != fold.NEVER).select("id"), "ingested")
    pages = spark.createDataFrame([], schemas.PAGES)
    pages_early, failed_early, inodes_late, tags = pages, nobody, inodes, None
    pages_late = pages
    if ingested.limit(1).count():
        pages = materialize(tables.read("pages", ingested, buckets, here), "pages", "zstd")
        early = known.where((F.col("task") == "embed_inode") & ~fold.phase_of(F.col("seq")) & F.col("error").isNull()).select("id").distinct()
        vectors_early, failed_early = embedded(early, inodes, pages, "vectors-early")
        pages_early = attached(pages, vectors_early, "pages-early")
        next_page = (tables.changes("pages", here).agg(F.max("id")).first()[0] or 0) + 1
        r = J.ingest(_requests(ingested), inodes, objects, pages_early, extractor=extractor, page_count=page_count, next_page_id=next_page)
        inodes_late, pages_late = materialize(r["inodes"], "inodes-late"), materialize(r["pages"], "pages-late", "zstd")
        tags = r["tags"]
    others = materialize(inodes.select("id").join(ingested, "id", "left_anti"), "others")
    bare = materialize(tables.bare_pages(others, buckets, here), "bare", "zstd")
    bare_late = bare.unionByName(pages_late.where(F.col("embedding").isNull()))
    facts = facts.join(inodes_late.select("id", F.col("error").alias("error_after"), F.col("to_page").alias("new_to_page")), "id")
    chain_embed, chain_index = mine("embed_inode"), mine("index_inode")
    no_failures = facts.withColumn("failed_early", F.lit(False)).withColumn("failed_late", F.lit(False))
    late = fold.embed_events(messages, no_failures, chain_embed).where(F.col("late") & (F.col("outcome") == "ok")).select("id").distinct()
    vectors, failed_late = embedded(late, inodes_late, bare_late, "vectors")
    pages_done = attached(pages_late, vectors, "pages-done") if tags is not None else pages_late
    if vectors is None:
        vectors = spark.createDataFrame([], "id bigint, embedding array<float>")
    filled = bare.drop("embedding").join(vectors, "id")

    # What every message finds.
    flags = [failed_early.withColumn("failed_early", F.lit(True)), failed_late.withColumn("failed_late", F.lit(True)),
             _open(pages, "open_early"), _open(pages_early, "open_early_after"), _open(bare_late, "open_late"),
             _open(bare_late.join(vectors.select("id"), "id", "left_anti"), "open_late_after")]
    for flag in flags:
        name = flag.columns[1]
        facts = facts.join(flag, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    facts = materialize(facts, "facts")
    embeds = materialize(fold.embed_events(messages, facts, chain_embed), "embeds")
    done = F.col("outcome") == "ok"
    firsts = embeds.groupBy("id").agg(fold.first(F.col("seq"), done & ~F.col("late")).alias("embed_early"),
                                      fold.first(F.col("seq"), done & F.col("late")).alias("embed_late"))
    facts = materialize(facts.join(firsts, "id", "left").withColumn("embed_early", F.coalesce("embed_early", never))
                        .withColumn("embed_late", F.coalesce("embed_late", never)), "facts")
    indexes = materialize(fold.index_events(messages, facts, embeds, chain_index), "indexes")
    out = fold.outcomes(messages, facts, embeds, indexes, objects is not None)
    facts = materialize(out["facts"], "facts")

    # Documents: of an inode's last index event, and of the last one before its ingest.
    seen = indexes.groupBy("id").agg(F.max(F.when(F.col("late"), F.col("seq"))).alias("late_at"), F.max(F.when(~F.col("late"), F.col("seq"))).alias("early_at"))
    living = facts.where(F.col("end") == fold.NEVER).join(seen, "id").select("id", "new_path", "move_at", "late_at", "early_at")

    def indexed(at: str, inodes: DataFrame) -> DataFrame:
        rows = inodes.join(living.where(F.col(at).isNotNull()), "id").withColumn(
            "path", F.when(F.col(at) >= F.col("move_at"), F.col("new_path")).otherwise(F.col("path")))
        return materialize(rows.withColumn("version", F.col(at)), "indexed")

    early_rows, late_rows = indexed("early_at", inodes), indexed("late_at", inodes_late)
    # Texts and vectors of the inodes that were not ingested come from the store for this only.
    stored = tables.read("pages", late_rows.select("id").join(ingested, "id", "left_anti"), buckets, here,
                         added=filled.withColumn("version", never))
    docs = IX.inode_docs(late_rows, ("version",))
    for more in (IX.inode_docs(early_rows, ("version",)), IX.page_docs(early_rows, pages_early, ("version",))[0],
                 IX.page_docs(late_rows, pages_done, ("version",))[0], IX.page_docs(late_rows, stored, ("version",))[0]):
        docs = docs.unionByName(more)

    # What changed.
    true = F.lit(True)
    living = facts.where(F.col("end") == fold.NEVER)
    embed_at = F.least("embed_early", "embed_late")
    patches = [living.where(F.col("ingest_at") != never).select("id", F.col("ingest_at").alias("version"), true.alias("is_ingested"),
                                                                F.col("error_after").alias("error"), F.col("new_to_page").alias("to_page")),
               living.where(embed_at != never).select("id", embed_at.alias("version"), true.alias("is_embedded")),
               living.where(F.col("index_at") != never).select("id", F.col("index_at").alias("version"), true.alias("is_indexed")),
               living.where(F.col("move_at") != never).select("id", F.col("move_at").alias("version"), F.col("new_path").alias("path"),
                                                              F.lit(False).alias("should_move"))]
    changes = patches[0]
    for p in patches[1:]:
        changes = changes.unionByName(p, allowMissingColumns=True)
    before = pages.select(F.col("id").alias("_id"), F.col("contents").alias("_contents"), F.col("embedding").isNotNull().alias("_filled"))
    new_text = ~F.col("contents").eqNullSafe(F.col("_contents"))
    new_vector = F.col("embedding").isNotNull() & ~F.coalesce("_filled", F.lit(False))
    changed = pages_done.join(before, F.col("id") == F.col("_id"), "left").where(F.col("_id").isNull() | new_text | new_vector)
    given = filled.select("id", "inode_id", "index", F.lit(None).cast("string").alias("contents"), "embedding", F.col("id").alias("_id"),
                          F.lit(None).cast("string").alias("_contents"), F.lit(False).alias("_filled"))
    page_changes = (changed.unionByName(given)
                    .join(living.select(F.col("id").alias("inode_id"), "ingest_at", embed_at.alias("_embed_at")), "inode_id")
                    .select("id", "inode_id", "index", F.when(F.col("_id").isNull() | new_text, F.col("contents")).alias("contents"),
                            F.when(new_vector, F.col("embedding")).alias("embedding"),
                            F.least("ingest_at", "_embed_at").alias("version")))

    at_path = F.when(F.col("seq") >= F.col("move_at"), F.col("new_path")).otherwise(F.col("path"))
    shared = J.public_tags(out["shared"].where(is_file("type")).withColumn("path", at_path))
    before_image = decoded.where((F.col("status") == "ok") & (F.col("task") == "delete_inode")).select(
        F.col("before_id").alias("id"), F.col("before_type").alias("type"), F.col("before_owner_id").alias("owner_id"), F.col("before_path").alias("path"))
    removed = (before_image.where(is_file("type")).select("id", F.explode(J.object_keys()).alias("_k"))
               .select("id", "_k.kind", "_k.object_key", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("target")))
    relocated = J.move_pairs(out["moved"].where(is_file("type"))).select(
        "id", "kind", F.col("old_key").alias("object_key"), F.lit("move").alias("action"), F.col("new_key").alias("target"))
    letters = decoded.where(F.col("status") != "ok").select("seq", "routing_key", F.col("status").alias("reason"))
    followups = materialize(out["followups"], "followups")
    outputs = {"followups": followups, "notifications": out["notifications"], "dead_letters": M.dead_letters(letters, out["dead_letters"]),
               "manifest": removed.unionByName(relocated), "tags": shared if tags is None else tags.unionByName(shared)}
    for name, rows in outputs.items():
        tables.write_output(name, rows, query_id, batch_id)
    for name, rows in (("inodes", changes), ("pages", page_changes), ("docs", docs),
                       ("deleted", ends.select("id", F.col("end").alias("version")))):
        tables.write(name, rows, query_id, batch_id)
    if publish_dir:
        foreign = followups.where(~F.col("routing_key").isin(*(keys or list(schemas.ROUTING_KEYS))))
        (foreign.select("seq", F.lit(None).cast("timestamp").alias("ts"), "routing_key", "body").hint("rebalance")
         .write.mode("append").json(publish_dir, compression="gzip"))
    tables.finish(query_id, batch_id)
    return True


def run_feed(spark: SparkSession, feed_dir: str, store_root: str, checkpoint: str,
             objects: DataFrame | None = None, embedder: Callable | None = None,
             max_files: int = 1, once: bool = True, keys: list[str] | None = None,
             extractor: Callable | None = None, page_count: Callable | None = None, publish_dir: str | None = None):
    """Consume the feed files under ``feed_dir`` into the tables under
    ``store_root`` (seeded beforehand).  ``once`` drains what is there
    (``availableNow``) and returns; otherwise the query keeps running and is
    returned.  Batches are told apart by the checkpoint's own query id, so
    several workers and fresh checkpoints may share a store."""
    tables = FeedTables(spark, store_root)
    stream = read_feed_stream(spark, feed_dir, max_files=max_files)

    def each(batch: DataFrame, batch_id: int) -> None:
        told = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])
        apply_batch(tables, batch, batch_id, objects=objects, embedder=embedder, keys=keys, extractor=extractor,
                    page_count=page_count, query_id=told["id"], publish_dir=publish_dir)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if once:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return writer.trigger(processingTime="10 seconds").start()


def write_feed(feed: DataFrame, path: str, files: int, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write feed rows as JSON in ``seq`` order: ``files`` equal ranges of ``seq``, one
    after the other (the stream takes files by age), each cut into as many files as
    its rows need.  Returns that number, the ``max_files`` of a range."""
    frozen = materialize(feed, "feed", "zstd")
    lo, hi, n = frozen.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
    lo, hi = (lo or 0), (hi or 0)
    span = hi - lo + 1
    parts = max(1, -(-n // (files * rows_per_file)))
    ranged = frozen.withColumn("_range", F.floor((F.col("seq") - F.lit(lo)) * files / F.lit(span)).cast("int"))
    for k in range(files):
        (ranged.where(F.col("_range") == k).drop("_range").repartitionByRange(parts, "seq").sortWithinPartitions("seq")
         .write.mode("append").json(path, compression="gzip"))
    return parts


__all__ = ["FeedTables", "apply_batch", "compact", "run_feed", "seed_store", "write_feed"]
