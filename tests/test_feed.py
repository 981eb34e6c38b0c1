"""Streaming worker: stream equals batch, replay changes nothing."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators import index as IX
from pagewright.operators.tables import apply_defaults
from pagewright.streaming.feed import FeedTables, apply_batch, run_feed, seed_store, write_feed

from conftest import rows


def test_stream_equals_batch_and_replay(spark):
    ino = apply_defaults(spark.createDataFrame(
        [(1, None, "u", "folder", "d", "/d"), (2, 1, "u", "file", "a.pdf", "/x/a.pdf"),
         (3, 1, "u", "file", "b.pdf", "/d/b.pdf")],
        "id long, parent_id long, owner_id string, type string, name string, path string"), "inodes")
    ino = ino.withColumn("to_page", F.lit(5))
    pg = spark.createDataFrame([(20, 2, 0, "alpha beta", None), (30, 3, 0, "gamma", [0.1] * 64)], schemas.PAGES)
    feed = spark.createDataFrame([
        (1, None, "embed_inode", '{"after": {"id": 2}}'),
        (2, None, "move_inode", '{"after": {"id": 2}}'),
        (3, None, "index_inode", '{"after": {"id": 2}}'),
        (4, None, "index_inode", '{"after": {"id": 3}}'),
        (5, None, "bogus", '{"after": {"id": 3}}'),
        (6, None, "delete_inode", '{"before": {"id": 3, "type": "file", "owner_id": "u", "path": "/d/b.pdf"}}'),
        (7, None, "index_inode", "not json"),
    ], schemas.FEED)
    root = tempfile.mkdtemp(prefix="feed-", dir="/tmp")
    write_feed(feed, f"{root}/in", files=1)
    stream_store = FeedTables(spark, f"{root}/s")
    seed_store(stream_store, ino, pg)
    run_feed(spark, f"{root}/in", f"{root}/s", f"{root}/ck")
    batch_store = FeedTables(spark, f"{root}/b")
    seed_store(batch_store, ino, pg)
    assert apply_batch(batch_store, feed, 0) is True
    assert apply_batch(batch_store, feed, 0) is False        # replay: already applied
    for t in ("docs", "inodes"):
        assert rows(stream_store.read(t).drop("embedding", "readable_by", "created_at", "updated_at")) == \
            rows(batch_store.read(t).drop("embedding", "readable_by", "created_at", "updated_at"))
    docs = IX.flat_docs(stream_store.read("docs"))
    assert rows(docs, "doc_id", "path") == [("2", "/d/a.pdf"), ("2_0", None)]
    letters = rows(stream_store.output("dead_letters"), "seq", "reason")
    assert letters == [(5, "unknown_key"), (7, "bad_body")]
    # a second run over the same checkpoint finds nothing new
    run_feed(spark, f"{root}/in", f"{root}/s", f"{root}/ck")
    assert stream_store.changes("inodes").select("query", "batch").distinct().count() == 2


def test_worker_keys_filter(spark):
    feed = spark.createDataFrame([(1, None, "ingest_inode", '{"after": {"id": 9}}'),
                                  (2, None, "index_inode", '{"after": {"id": 9}}')], schemas.FEED)
    root = tempfile.mkdtemp(prefix="feedk-", dir="/tmp")
    store = FeedTables(spark, root)
    seed_store(store, apply_defaults(spark.createDataFrame([(9, "u", "a", "/a")],
                                                           "id long, owner_id string, name string, path string"),
                                     "inodes"), spark.createDataFrame([], schemas.PAGES))
    assert apply_batch(store, feed, 0, keys=["index_inode"]) is True
    assert rows(store.read("docs"), "doc_id") == [("9",)]
    assert store.output("dead_letters").count() == 0      # the ingest message is not ours


def test_delete_ends_the_id(spark):
    ino = apply_defaults(spark.createDataFrame(
        [(1, None, "u", "folder", "d", "/d"), (2, 1, "u", "file", "a.pdf", "/d/a.pdf")],
        "id long, parent_id long, owner_id string, type string, name string, path string"), "inodes")
    pg = spark.createDataFrame([(20, 2, 0, "alpha", [0.1] * 64)], schemas.PAGES)
    root = tempfile.mkdtemp(prefix="feedd-", dir="/tmp")
    store = FeedTables(spark, root)
    seed_store(store, ino, pg)
    first = spark.createDataFrame([(1, None, "index_inode", '{"after": {"id": 2}}'),
                                   (2, None, "delete_inode", '{"before": {"id": 1, "type": "folder", '
                                                             '"owner_id": "u", "path": "/d"}}')], schemas.FEED)
    apply_batch(store, first, 0)
    assert store.read("inodes").count() == 0 and store.read("pages").count() == 0
    assert store.read("docs").count() == 0
    later = spark.createDataFrame([(3, None, "index_inode", '{"after": {"id": 2}}')], schemas.FEED)
    apply_batch(store, later, 1)
    assert store.read("docs").count() == 0
    assert rows(store.output("dead_letters").where(F.col("batch") == 1), "seq", "reason") == [(3, "missing_inode")]


def _world(spark):
    """Inodes 1 (folder) and 2..5 (files) with objects, nothing ingested."""
    ino = apply_defaults(spark.createDataFrame(
        [(1, None, "u", "folder", "d", "/d")] + [(i, 1, "u", "file", f"{i}.pdf", f"/d/{i}.pdf") for i in range(2, 6)],
        "id long, parent_id long, owner_id string, type string, name string, path string"), "inodes")
    objects = spark.createDataFrame([(f"users/u/d/{i}.pdf", bytearray(f"%PDF-1.7page {i} one|page {i} two".encode()))
                                     for i in range(2, 5)], "key string, content binary")
    return ino, spark.createDataFrame([], schemas.PAGES), objects


def _message(seq, key, i):
    image = {"id": i, "type": "file", "owner_id": "u", "path": f"/d/{i}.pdf"}
    return (seq, None, key, json.dumps({"before" if key == "delete_inode" else "after": image}))


def _splitter():
    """A fresh extractor: nested functions travel to the workers by value."""
    def split(raw):
        return raw.decode()[8:].split("|")
    return split


def _state(store):
    return (rows(store.read("docs"), "doc_id", "contents"),
            rows(store.read("inodes"), "id", "is_ingested", "is_embedded", "is_indexed", "to_page"),
            sorted(store.output("dead_letters").select("seq", "reason").collect()),
            sorted(store.output("followups").select("seq", "routing_key").collect()))


def test_one_upload_message_ends_as_a_searchable_document(spark):
    ino, pg, objects = _world(spark)
    store = FeedTables(spark, tempfile.mkdtemp(prefix="feedu-", dir="/tmp"))
    seed_store(store, ino, pg)
    apply_batch(store, spark.createDataFrame([_message(1, "ingest_inode", 2), _message(2, "ingest_inode", 5)], schemas.FEED),
                0, objects=objects, extractor=_splitter())
    assert rows(store.read("docs"), "doc_id", "contents") == [("2", None), ("2_0", "page 2 one"), ("2_1", "page 2 two")]
    done = store.read("inodes").where("id = 2").select("is_ingested", "is_embedded", "is_indexed").first()
    assert tuple(done) == (True, True, True)
    assert sorted(store.output("followups").select("seq", "routing_key").collect()) == [(1, "embed_inode"), (1, "index_inode")]
    assert rows(store.output("dead_letters"), "seq", "reason") == [(2, "missing_object")]


def test_ingest_without_objects_is_a_dead_letter(spark):
    ino, pg, _ = _world(spark)
    store = FeedTables(spark, tempfile.mkdtemp(prefix="feedo-", dir="/tmp"))
    seed_store(store, ino, pg)
    apply_batch(store, spark.createDataFrame([_message(1, "ingest_inode", 2)], schemas.FEED), 0)
    assert rows(store.output("dead_letters"), "seq", "reason") == [(1, "no_object_source")]


ORDERED = [("ingest_inode", 2), ("ingest_inode", 3), ("embed_inode", 4), ("index_inode", 4), ("ingest_inode", 4), ("delete_inode", 3),
           ("index_inode", 3), ("index_inode", 2), ("embed_inode", 2), ("embed_inode", 99), ("delete_inode", 2), ("embed_inode", 2)]


def test_feed_order_does_not_depend_on_the_files(spark):
    ino, pg, objects = _world(spark)
    feed = spark.createDataFrame([_message(s, k, i) for s, (k, i) in enumerate(ORDERED)], schemas.FEED)
    states = []
    for max_files in (1, 2, 4):
        root = tempfile.mkdtemp(prefix="feedf-", dir="/tmp")
        write_feed(feed, f"{root}/in", files=4)
        store = FeedTables(spark, f"{root}/s")
        seed_store(store, ino, pg)
        run_feed(spark, f"{root}/in", f"{root}/s", f"{root}/ck", objects=objects, extractor=_splitter(), max_files=max_files)
        states.append(_state(store))
    assert states[0] == states[1] == states[2]
    docs, inodes, letters, _ = states[0]
    assert [d for d, _ in docs] == ["4", "4_0", "4_1"] and [i[0] for i in inodes] == [1, 4, 5]
    assert letters == [(6, "missing_inode"), (9, "missing_inode"), (11, "missing_inode")]


def test_two_workers_equal_one_and_a_fresh_checkpoint_goes_on(spark):
    ino, pg, objects = _world(spark)
    feed = [_message(s, k, i) for s, (k, i) in enumerate([("ingest_inode", 2), ("ingest_inode", 3), ("index_inode", 4)])]
    one = FeedTables(spark, tempfile.mkdtemp(prefix="feed1-", dir="/tmp"))
    seed_store(one, ino, pg)
    apply_batch(one, spark.createDataFrame(feed, schemas.FEED), 0, objects=objects, extractor=_splitter())
    root = tempfile.mkdtemp(prefix="feed2-", dir="/tmp")
    write_feed(spark.createDataFrame(feed, schemas.FEED), f"{root}/in", files=2)
    two = FeedTables(spark, f"{root}/s")
    seed_store(two, ino, pg)
    common = dict(objects=objects, extractor=_splitter(), publish_dir=f"{root}/in")
    run_feed(spark, f"{root}/in", f"{root}/s", f"{root}/ck1", keys=["ingest_inode"], **common)
    others = [k for k in schemas.ROUTING_KEYS if k != "ingest_inode"]
    run_feed(spark, f"{root}/in", f"{root}/s", f"{root}/ck2", keys=others, objects=objects)
    assert _state(two)[:2] == _state(one)[:2]
    more = spark.createDataFrame([_message(50, "ingest_inode", 4)], schemas.FEED)
    more.coalesce(1).write.json(f"{root}/more")
    run_feed(spark, f"{root}/more", f"{root}/s", f"{root}/ck3", objects=objects, extractor=_splitter())
    assert {"4_0", "4_1"} <= {d for d, _ in rows(two.read("docs"), "doc_id", "contents")}


def test_every_external_call_is_made_once(spark):
    ino, pg, objects = _world(spark)
    log = tempfile.mkdtemp(prefix="feedc-", dir="/tmp")

    def note(kind, n):
        with open(os.path.join(log, kind), "a") as f:
            f.write(f"{n}\n")

    def extract(raw):
        note("extract", len(raw))
        if b"page 3" in raw:
            raise ValueError("cannot read")
        return raw.decode()[8:].split("|")

    def embed(texts):
        note("embed", len(texts))
        if any("page 4" in t for t in texts):
            raise RuntimeError("busy")
        return [[0.5] * 64 for _ in texts]

    root = tempfile.mkdtemp(prefix="feedc-", dir="/tmp")
    write_feed(spark.createDataFrame([_message(i, "ingest_inode", i) for i in (2, 3, 4)], schemas.FEED), f"{root}/in", files=1)
    store = FeedTables(spark, f"{root}/s")
    seed_store(store, ino, pg)
    run_feed(spark, f"{root}/in", f"{root}/s", f"{root}/ck", objects=objects, extractor=extract, embedder=embed)
    count = {k: len(open(os.path.join(log, k)).read().split()) for k in ("extract", "embed")}
    assert count == {"extract": 3, "embed": 2}
    flags = {r["id"]: r["is_embedded"] for r in store.read("inodes").collect()}
    vectors = {r["inode_id"] for r in store.read("pages").where("embedding is not null").collect()}
    assert flags[2] and not flags[4] and vectors == {2}
    assert (4, "embedding_failed") in rows(store.output("dead_letters"), "seq", "reason")


def test_corrupted_files_and_page_counts_of_a_supplied_extractor(spark):
    ino, pg, objects = _world(spark)

    def count(raw):
        if b"page 2" in raw:
            raise OSError("broken")
        return 7

    def extract(raw):
        if b"page 3" in raw:
            raise ValueError("cannot read")
        return raw.decode()[8:].split("|")

    store = FeedTables(spark, tempfile.mkdtemp(prefix="feedp-", dir="/tmp"))
    seed_store(store, ino, pg)
    apply_batch(store, spark.createDataFrame([_message(i, "ingest_inode", i) for i in (2, 3, 4)], schemas.FEED), 0,
                objects=objects, extractor=extract, page_count=count)
    got = rows(store.read("inodes").where("id between 2 and 4"), "id", "error", "to_page", "is_ingested")
    assert got == [(2, "corrupted_file", None, True), (3, None, 7, True), (4, None, 7, True)]


def test_registered_feed_ingests_embeds_and_indexes_objects(spark, monkeypatch):
    from pagewright.plans.catalog import QUERIES
    from pagewright.sources import TestTables
    from pagewright.sources.feed import read_feed
    from pagewright.streaming import feed as worker
    from conftest import SF_SMALL

    # The registered query's own store, feed and objects; the ingest messages in one batch.
    def ingests(spark, feed_dir, store_root, checkpoint, objects=None, **_):
        apply_batch(FeedTables(spark, store_root), read_feed(spark, feed_dir).where("routing_key = 'ingest_inode'"), 0, objects=objects)

    monkeypatch.setattr(worker, "run_feed", ingests)
    out = [(r["kind"], r["detail"].split(" ")[0]) for r in QUERIES["run_feed"](spark, SF_SMALL).select("kind", "detail").collect()]
    assert {d for k, d in out if k == "dead_letter"} >= {"missing_inode"} and ("dead_letter", "no_object_source") not in out
    pdfs = {r["id"] + 1_000_000 for r in TestTables(spark, SF_SMALL).fx_objects.where("content like '%PDF-%'").select("id").collect()}
    paged = {int(d.split("_")[0]) for k, d in out if k == "doc" and "_" in d}
    assert paged and paged <= pdfs and paged <= {int(d) for k, d in out if k == "doc" and "_" not in d}
    assert {"embed_inode", "index_inode"} <= {d for k, d in out if k == "followup"}
