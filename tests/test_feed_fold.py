"""The folded worker against a plain walk through the messages, one by one."""

import random
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators.tables import apply_defaults
from pagewright.streaming import fold
from pagewright.streaming.feed import FeedTables, apply_batch, compact, seed_store, write_feed

from conftest import rows
from test_feed import _message, _splitter

PATHS = {1: "/d", 2: "/d/2.pdf", 3: "/old/3.pdf", 4: "/d/4.pdf", 5: "/old/5.pdf", 6: "/d/sub", 7: "/d/sub/7.pdf", 8: "/d/8.pdf", 9: "/d/9.pdf"}
NAMES = {i: p.rsplit("/", 1)[1] for i, p in PATHS.items()} | {1: "d", 6: "sub"}
PARENTS = {1: None, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 6, 8: 1, 9: 1}
FILES = {2: "one|two", 3: "three", 4: None, 5: "a||c", 7: "seven"}        # 4 is no PDF; 8 and 9 have no object
PAGES = [(80, 8, 0, "old eight", None), (81, 8, 1, "", None), (90, 9, 0, "nine", [0.1] * 64), (91, 9, 5, "beyond", None),
         (20, 2, 0, "was here", None), (21, 2, 4, "left over", [0.2] * 64)]
TO_PAGE = {8: 2, 9: 1, 2: 1}
ERRORS = {5: "corrupted_file"}


def world(spark):
    ino = apply_defaults(spark.createDataFrame(
        [(i, PARENTS[i], "u", "folder" if i in (1, 6) else "file", NAMES[i], PATHS[i], TO_PAGE.get(i), ERRORS.get(i), True, i % 2 == 0)
         for i in PATHS], "id long, parent_id long, owner_id string, type string, name string, path string, to_page int, error string, "
                          "is_uploaded boolean, is_public boolean"), "inodes")
    objects = [(f"users/u{PATHS[i]}", bytearray((f"%PDF-1.7{t}" if t is not None else "plain text").encode())) for i, t in FILES.items()]
    return ino, spark.createDataFrame(PAGES, schemas.PAGES), spark.createDataFrame(objects, "key string, content binary")


def full_path(i):
    return "" if i is None else full_path(PARENTS[i]) + "/" + NAMES[i]


def walk(batches):
    """docs, inode flags and outputs after the batches, message by message."""
    ino = {i: dict(path=PATHS[i], to=TO_PAGE.get(i), error=ERRORS.get(i), ing=False, emb=False, idx=False) for i in PATHS}
    pages = {(p[1], p[2]): [p[3], p[4] is not None] for p in PAGES}
    docs, outs = {}, {"followups": [], "notifications": [], "dead_letters": []}

    def below(i):
        return {i} | {x for c, p in PARENTS.items() if p == i for x in below(c)}

    for batch in batches:
        at_start = {i: f"users/u{r['path']}" for i, r in ino.items()}
        have = {f"users/u{PATHS[i]}": t for i, t in FILES.items()}

        def note(seq, i, task):
            r = ino[i]
            if (r["ing"] and r["emb"] and r["idx"]) or r["error"]:
                outs["notifications"].append((seq, "public" if i % 2 == 0 else "user-u", f'{{"id":{i},"task":"{task}"}}'))

        def run(seq, task, i):
            letter = lambda reason: outs["dead_letters"].append((seq, task, reason))
            if task == "delete_inode":
                for x in below(i):
                    ino.pop(x, None)
                    for key in [k for k in pages if k[0] == x]:
                        pages.pop(key)
                    for d in [d for d in docs if d.split("_")[0] == str(x)]:
                        docs.pop(d)
                return
            if i not in ino:
                return letter("missing_inode")
            r = ino[i]
            if task == "ingest_inode":
                if at_start[i] not in have:
                    return letter("missing_object")
                text = have[at_start[i]]
                if text is None:
                    r["error"] = "unsupported_file_type"
                else:
                    parts = text.split("|")
                    r["to"] = r["to"] or len(parts)
                    for k, part in enumerate(parts):
                        pages[(i, k)] = [part, pages.get((i, k), [0, False])[1]]
                r["ing"] = True
                outs["followups"].append((seq, "embed_inode"))
                note(seq, i, task)
                run(seq, "embed_inode", i)
            elif task == "embed_inode":
                if r["error"]:
                    return letter("errored_inode")
                for (x, k), page in pages.items():
                    if x == i and r["to"] is not None and 0 <= k < r["to"] and page[0]:
                        page[1] = True
                r["emb"] = True
                outs["followups"].append((seq, "index_inode"))
                note(seq, i, task)
                run(seq, "index_inode", i)
            elif task == "move_inode":
                if r["path"] != full_path(i):
                    r["path"] = full_path(i)
                    outs["followups"].append((seq, "index_inode"))
                    run(seq, "index_inode", i)
            elif task == "share_inode":
                outs["followups"].append((seq, "index_inode"))
                run(seq, "index_inode", i)
            else:
                docs[str(i)] = (r["path"], None)
                own = {k: page for (x, k), page in pages.items() if x == i and page[0]}
                docs.update({f"{i}_{k}": (None, page[0]) for k, page in own.items() if page[1]})
                if not all(page[1] for page in own.values()):
                    return letter("missing_embedding")
                r["idx"] = True
                note(seq, i, task)

        for seq, task, i in batch:
            run(seq, task, i)
    flags = {(i, r["path"], r["to"], r["error"], r["ing"], r["emb"], r["idx"]) for i, r in ino.items()}
    return {(d, p, c) for d, (p, c) in docs.items()}, flags, {k: Counter(v) for k, v in outs.items()}


def state(store):
    docs = {tuple(r) for r in store.read("docs").select("doc_id", "path", "contents").collect()}
    flags = {tuple(r) for r in store.read("inodes").select("id", "path", "to_page", "error", "is_ingested", "is_embedded", "is_indexed").collect()}
    outs = {"followups": ("seq", "routing_key"), "notifications": ("seq", "channel", "body"), "dead_letters": ("seq", "routing_key", "reason")}
    return docs, flags, {k: Counter(tuple(r) for r in store.output(k).select(*cols).collect()) for k, cols in outs.items()}


def random_batches(seed, n):
    rng = random.Random(seed)
    tasks = ["ingest_inode", "embed_inode", "index_inode", "move_inode", "share_inode"]
    made = [(s, "delete_inode" if rng.random() < 0.03 else rng.choice(tasks), rng.choice([*range(1, 10), 2, 8, 99])) for s in range(n)]
    cut = rng.randrange(n)
    return [made[:cut], made[cut:]]


def test_fold_equals_the_walk_and_replays_change_nothing(spark):
    ino, pg, objects = world(spark)
    for seed, n in ((1, 60), (2, 140)):
        batches = random_batches(seed, n)
        store = FeedTables(spark, tempfile.mkdtemp(prefix="fold-", dir="/tmp"))
        seed_store(store, ino, pg, rows_per_bucket=4)
        for b, batch in enumerate(batches):
            feed = spark.createDataFrame([_message(s, k, i) for s, k, i in batch], schemas.FEED)
            assert apply_batch(store, feed, b, objects=objects, extractor=_splitter())
        want = walk(batches)
        got = state(store)
        assert got[0] == want[0] and got[1] == want[1]
        assert got[2] == want[2]
        if seed == 1:       # the same feed again, under another query, and a store made from this one
            pages = rows(store.read("pages"), "id", "inode_id", "index", "contents")
            feed = spark.createDataFrame([_message(s, k, i) for s, k, i in batches[0] + batches[1]], schemas.FEED)
            apply_batch(store, feed, 0, objects=objects, extractor=_splitter(), query_id="again")
            docs = {tuple(r) for r in store.read("docs").select("doc_id", "contents").collect()}
            assert docs == {(d, c) for d, _, c in want[0]} and rows(store.read("pages"), "id", "inode_id", "index", "contents") == pages
            smaller = compact(store, tempfile.mkdtemp(prefix="fold-", dir="/tmp"))
            assert rows(smaller.read("pages"), "id", "inode_id", "index", "contents") == pages


def test_a_batch_that_broke_off_runs_again_over_its_own_partitions(spark):
    ino, pg, objects = world(spark)
    feed = spark.createDataFrame([_message(s, k, i) for s, k, i in [(0, "ingest_inode", 2), (1, "delete_inode", 9), (2, "index_inode", 9)]], schemas.FEED)
    store = FeedTables(spark, tempfile.mkdtemp(prefix="broke-", dir="/tmp"))
    seed_store(store, ino, pg)
    finish, store.finish = store.finish, lambda *_: None        # the tables are written, the batch is not whole
    apply_batch(store, feed, 0, objects=objects, extractor=_splitter())
    first, store.finish = state(store), finish
    assert apply_batch(store, feed, 0, objects=objects, extractor=_splitter()) and state(store) == first
    assert not apply_batch(store, feed, 0, objects=objects, extractor=_splitter())
    assert first[2]["dead_letters"][(2, "index_inode", "missing_inode")] == 1


def test_deletes_reach_what_is_below(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)], "id long, parent_id long")
    gone = spark.createDataFrame([(2, 50), (4, 10), (4, 70), (6, 5), (77, 1)], "id long, end long")
    assert rows(fold.subtree_ends(edges, gone), "id", "end") == [(2, 50), (3, 50), (4, 10), (6, 5), (77, 1)]


def test_feed_files_grow_with_the_rows(spark):
    feed = spark.range(100).select(F.col("id").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit("k").alias("routing_key"), F.lit("b").alias("body"))
    root = tempfile.mkdtemp(prefix="feedw-", dir="/tmp")
    assert write_feed(feed, f"{root}/a", files=2) == 1
    assert write_feed(feed, f"{root}/b", files=2, rows_per_file=10) == 5
    assert spark.read.json(f"{root}/b").count() == 100 and len(spark.read.json(f"{root}/b").inputFiles()) == 10


def _indexed_world(spark):
    """A store whose pages are far larger than anything else, and index messages for all of them."""
    rng = random.Random(4)
    ino = apply_defaults(spark.createDataFrame([(i, "u", "file", f"{i}.pdf", f"/{i}.pdf") for i in range(1, 41)],
                                               "id long, owner_id string, type string, name string, path string"), "inodes")
    pg = spark.createDataFrame([(i * 10 + k, i, k, rng.randbytes(20_000).hex(), [0.5] * 64) for i in range(1, 41) for k in range(3)], schemas.PAGES)
    store = FeedTables(spark, tempfile.mkdtemp(prefix="light-", dir="/tmp"))
    feed = spark.createDataFrame([_message(i, "index_inode", i) for i in range(1, 41)], schemas.FEED)
    return store, ino, pg, feed


def test_texts_of_pages_are_not_copied_on_the_way_to_the_index(spark):
    from pathlib import Path
    from pagewright.session import ensure_checkpoint_dir
    store, ino, pg, feed = _indexed_world(spark)
    size = (lambda root: sum(p.stat().st_size for p in Path(root).rglob("*.parquet")))
    scratch = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = size(scratch)
    seed_store(store, ino, pg)
    apply_batch(store, feed, 0)
    assert store.read("docs").where("contents is not null").count() == 120
    assert size(scratch) - before < size(f"{store.root}/pages") / 2


def test_texts_are_shuffled_once_where_ids_are_not_broadcast(spark, monkeypatch):
    from pagewright.plans.catalog import _feed_docs
    from pagewright.streaming import change_log
    store, ino, pg, feed = _indexed_world(spark)
    seed_store(store, ino, pg)
    apply_batch(store, feed.unionByName(spark.createDataFrame([_message(90, "delete_inode", 7)], schemas.FEED)), 0)
    touched = spark.createDataFrame([(i,) for i in (3, 7, 8, 8, 99)], "id bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, shuffles in ((change_log.FEW_IDS, 1), (0, 2)):      # the ids' own besides
            monkeypatch.setattr(change_log, "FEW_IDS", few)
            pages = store.read("pages", touched, list(range(store.buckets)))
            plan = pages._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == shuffles and plan.count("Join") == 1
            assert rows(pages, "id") == [(30,), (31,), (32,), (80,), (81,), (82,)]
        plan = _feed_docs(store)._jdf.queryExecution().executedPlan().toString()
        assert plan[:plan.index("md5(")].count("Exchange") == 2      # for the deleted and for the fold
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_hashed_before_their_changes_are_folded(spark):
    from pagewright.plans.catalog import _feed_docs
    store, ino, pg, feed = _indexed_world(spark)
    seed_store(store, ino, pg)
    apply_batch(store, feed, 0)
    plan = _feed_docs(store)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Exchange") < plan.index("md5(")
