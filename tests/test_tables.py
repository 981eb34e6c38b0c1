"""Keyed writes, ids, batches."""

from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators.ids import assign_batches, assign_ids, latest_by_key
from pagewright.operators.tables import apply_defaults, set_flags, upsert_pages

from conftest import rows


def pages(spark, data):
    return spark.createDataFrame(data, schemas.PAGES)


def test_upsert_keeps_embedding_and_extra_pages(spark):
    cur = pages(spark, [(1, 10, 0, "old a", [1.0]), (2, 10, 1, "old b", [2.0]), (3, 10, 2, "old c", None)])
    inc = spark.createDataFrame([(10, 0, "new a"), (10, 1, "old b"), (11, 0, "fresh")],
                                "inode_id long, index int, contents string")
    out = upsert_pages(cur, inc)
    assert rows(out, "id", "inode_id", "index", "contents") == [
        (1, 10, 0, "new a"), (2, 10, 1, "old b"), (3, 10, 2, "old c"), (4, 11, 0, "fresh")]
    emb = {r.id: r.embedding for r in out.collect()}
    assert emb[1] == [1.0]            # K1: vector kept though text changed
    reset = {r.id: r.embedding for r in upsert_pages(cur, inc, reset_embedding_on_change=True).collect()}
    assert reset[1] is None and reset[2] == [2.0]
    pruned = upsert_pages(cur, inc, prune=True)
    assert 3 not in [r.id for r in pruned.collect()]   # K2 option


def test_upsert_is_idempotent(spark):
    cur = pages(spark, [(1, 10, 0, "a", None)])
    inc = spark.createDataFrame([(10, 0, "b"), (10, 1, "c")], "inode_id long, index int, contents string")
    once = upsert_pages(cur, inc)
    twice = upsert_pages(once, inc)
    assert rows(once, "id", "index", "contents") == rows(twice, "id", "index", "contents")


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    out = assign_ids(df, ["k"], start=5).collect()
    pairs = sorted((r.k, r.id) for r in out)
    assert [i for _, i in pairs] == list(range(5, 1005))


def test_assign_batches_sizes(spark):
    data = []
    for inode, n in [(1, 0), (2, 1), (3, 64), (4, 65), (5, 128)]:
        data += [(inode * 1000 + i, inode, i) for i in range(n)]
    df = spark.createDataFrame(data, "id long, inode_id long, index int").repartition(5)
    out = assign_batches(df, size=64).collect()
    sizes = {}
    for r in out:
        sizes.setdefault((r.inode_id, r.batch), []).append(r["index"])
    assert {k: len(v) for k, v in sizes.items()} == {(2, 0): 1, (3, 0): 64, (4, 0): 64, (4, 1): 1,
                                                      (5, 0): 64, (5, 1): 64}
    for (inode, batch), idx in sizes.items():
        assert sorted(idx) == list(range(batch * 64, batch * 64 + len(idx)))


def test_latest_by_key_hot_key(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("seq"),
                                     (F.col("id") % 10).alias("ts"))
    got = rows(latest_by_key(df, ["k"], ["ts", "seq"]), "k", "seq")
    assert got == [(0, 4999), (1, 4989)]


def test_set_flags_and_defaults(spark):
    ino = spark.createDataFrame([(1, "o", "a", "/a")], "id long, owner_id string, name string, path string")
    full = apply_defaults(ino, "inodes")
    assert full.columns == [f.name for f in schemas.INODES.fields]
    r = full.first()
    assert r.type == "folder" and r.is_indexed is False and r.from_page == 0 and r.created_at is not None
    flagged = set_flags(full, spark.createDataFrame([(1,)], "id long"), is_indexed=True)
    assert flagged.first().is_indexed is True


def test_upsert_reads_texts_and_vectors_once(spark, tmp_path):
    """A pass over the keys finds the new pages; texts and vectors go through one join."""
    data = [(1, 10, 0, "old a", [1.0]), (2, 10, 0, "twin", [2.0]), (3, 10, 2, "old c", None), (4, None, 0, "lost", None)]
    kinds = "id long, inode_id long, index int, contents string, embedding array<float>"
    spark.createDataFrame(data, kinds).write.parquet(str(tmp_path / "pages"))
    inc = spark.createDataFrame([(10, 0, "new a"), (10, 1, "b"), (10, 2, None), (10, 3, "d"), (10, 3, "d"), (None, 0, "x")],
                                "inode_id long, index int, contents string")
    out = upsert_pages(spark.read.parquet(str(tmp_path / "pages")), inc)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("embedding" in line.split("ReadSchema:")[1] for line in plan.splitlines() if "ReadSchema:" in line) == 1
    got = out.select("id", "inode_id", "index", "contents").collect()
    assert sorted((r.id, r.inode_id or 0, r["index"], r.contents) for r in got) == [
        (1, 10, 0, "new a"), (2, 10, 0, "new a"), (3, 10, 2, "old c"), (4, 0, 0, "lost"),
        (5, 0, 0, "x"), (6, 10, 1, "b"), (7, 10, 3, "d"), (8, 10, 3, "d")]
