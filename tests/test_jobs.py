"""Ingest, embed, index, move, share, delete on in-line edge tables."""

from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.operators import embed as E
from pagewright.operators import index as IX
from pagewright.operators.tables import apply_defaults
from pagewright.operators.tree import descendants, resolve_paths, resolve_paths_of
from pagewright.plans import jobs as J

from conftest import rows

HTML = "<html><body><p>Hello &amp; bye</p><script>x()</script></body></html>"


def inodes(spark, data):
    """data: (id, parent_id, type, name, path, from_page, to_page, error, is_public)"""
    df = spark.createDataFrame(data, "id long, parent_id long, type string, name string, path string, "
                                     "from_page int, to_page int, error string, is_public boolean")
    return apply_defaults(df.withColumn("owner_id", F.lit("u1")), "inodes")


def test_ingest_statuses(spark):
    ino = inodes(spark, [
        (1, None, "file", "a.pdf", "/a.pdf", 3, None, None, True),
        (2, None, "file", "b.pdf", "/b.pdf", 0, None, None, False),
        (3, None, "file", "c.pdf", "/c.pdf", 0, 7, None, False),
        (4, None, "file", "d.pdf", "/d.pdf", 0, None, "corrupted_file", False),
        (5, None, "file", "e.pdf", "/e.pdf", 0, None, None, False),
    ])
    objects = spark.createDataFrame([
        ("users/u1/a.pdf", bytearray(b"%PDF-1.7" + HTML.encode())),
        ("users/u1/b.pdf", bytearray(HTML.encode())),
        ("users/u1/c.pdf", bytearray(b"%PDF-1.7<html>cut")),
        ("users/u1/d.pdf", bytearray(b"%PDF-1.7" + HTML.encode())),
    ], "key string, content binary")
    req = spark.createDataFrame([(i, i) for i in range(1, 7)], "seq long, id long")
    empty = spark.createDataFrame([], schemas.PAGES)
    out = J.ingest(req, ino, objects, empty)
    got = {r.id: (r.error, r.to_page, r.is_ingested) for r in out["inodes"].collect()}
    assert got[1] == (None, 1, True)                         # K3: to_page = count; pages from 3
    assert got[2] == ("unsupported_file_type", None, True)
    assert got[3] == ("corrupted_file", 7, True)
    assert got[4] == ("corrupted_file", 1, True)             # K8: old error stays
    assert got[5] == (None, None, False)                      # object missing: not ingested
    assert rows(out["pages"], "inode_id", "index", "contents") == [(1, 3, "Hello & bye"), (4, 0, "Hello & bye")]
    assert rows(out["dead_letters"], "seq", "reason") == [(5, "missing_object"), (6, "missing_inode")]
    assert sorted(r.routing_key for r in out["followups"].collect()) == ["embed_inode"] * 4  # K9
    assert rows(out["tags"], "id", "kind", "tag", "collides") == [(1, "original", "True", True)]      # K7: one object


def test_embed_ranges_and_all_or_nothing(spark):
    ino = inodes(spark, [
        (1, None, "file", "a", "/x/a.pdf", 3, 10, None, False),     # K3: pages 3..9 only
        (2, None, "file", "b", "/x/b.pdf", 0, None, None, False),   # K5: NULL to_page
        (3, None, "file", "c", "/x/c.pdf", 0, 5, "corrupted_file", False),
    ])
    pg = spark.createDataFrame(
        [(1000 + i, 1, i, "word %d" % i, None) for i in range(3, 13)]
        + [(2000, 2, 0, "text", None), (3000, 3, 0, "text", None), (1999, 1, 5, "   ", None)][:2]
        + [(3001, 3, 1, "x", None)], schemas.PAGES)
    req = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "seq long, id long")
    out = J.embed(req, ino, pg)
    filled = {r.id for r in out["pages"].where(F.col("embedding").isNotNull()).collect()}
    assert filled == {1000 + i for i in range(3, 10)}
    flags = {r.id: r.is_embedded for r in out["inodes"].collect()}
    assert flags == {1: True, 2: True, 3: False}
    assert rows(out["dead_letters"], "seq", "reason") == [(3, "errored_inode")]

    def bad(texts):
        raise RuntimeError("model down")
    out2 = J.embed(req, ino, pg, embedder=bad)
    assert out2["pages"].where(F.col("embedding").isNotNull()).count() == 0
    assert {r.id: r.is_embedded for r in out2["inodes"].collect()}[1] is False


def test_native_and_python_embedder_agree(spark):
    texts = ["Hello  world hello", "é  Ü\tß", "   "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    native = {r.id: r.embedding for r in E.hashed_embeddings(df, dim=16).collect()}
    py = E.hashed_embedder(16)(texts)
    for i in range(len(texts)):
        assert [round(x, 6) for x in native[i]] == [round(float(x), 6) for x in py[i]]


def test_index_quarantine_and_modes(spark):
    ino = inodes(spark, [(1, None, "file", "a.pdf", "/d/a.pdf", 2, None, None, True),
                         (2, None, "folder", "d", "/d", 0, None, None, False)])
    pg = spark.createDataFrame([(10, 1, 2, "p0", [0.5]), (11, 1, 3, "p1", None), (12, 1, 4, "", [0.1])],
                               schemas.PAGES)
    req = spark.createDataFrame([(1, 1), (2, 2)], "seq long, id long")
    out = J.index(req, ino, pg)
    assert rows(out["new_docs"], "doc_id", "parent_id", "index") == [("1", None, None), ("1_2", "1", 0),
                                                                     ("2", None, None)]  # K15
    assert rows(out["quarantine"], "doc_id", "reason") == [("1_3", "missing_embedding")]   # K4
    assert {r.id: r.is_indexed for r in out["inodes"].collect()} == {1: False, 2: True}
    # K11: a page gone from the new docs stays in upsert mode, leaves in replace_parent mode
    current = out["docs"].unionByName(out["new_docs"].where(F.col("doc_id") == "1_2")
                                      .withColumn("doc_id", F.lit("1_9")))
    new = out["new_docs"].where(F.col("doc_id") != "1_2")
    assert "1_9" in [r.doc_id for r in IX.write_index(current, new, "upsert").collect()]
    assert "1_9" not in [r.doc_id for r in IX.write_index(current, new, "replace_parent").collect()]
    gone = IX.delete_from_index(current, spark.createDataFrame([(1,), (99,)], "id long"))
    assert rows(gone, "doc_id") == [("2",)]


def test_move_paths_and_manifest(spark):
    ino = inodes(spark, [
        (1, None, "folder", "A", "/A", 0, None, None, False),
        (2, 1, "file", "f.pdf", "/A/f.pdf", 0, None, None, False),       # unchanged
        (3, 1, "file", "g.pdf", "/a/g.pdf", 0, None, None, False),       # K13 case-only change
        (4, 1, "folder", "sub", "/old/sub", 0, None, None, False),       # folder: no objects
        (5, None, "file", "r", "/s", 0, None, None, False),              # K7 root file, no ext
    ])
    req = spark.createDataFrame([(i, i) for i in range(1, 6)], "seq long, id long")
    out = J.move(req, ino)
    assert rows(out["changed"], "id", "new_path") == [(3, "/A/g.pdf"), (4, "/A/sub"), (5, "/r")]
    assert rows(out["manifest"], "id", "kind", "old_key", "new_key") == [
        (3, "optimized", "users/u1/a/g_optimized.pdf", "users/u1/A/g_optimized.pdf"),
        (3, "original", "users/u1/a/g.pdf", "users/u1/A/g.pdf"),
        (5, "original", "users/u1/s", "users/u1/r")]       # K7: one object
    assert {r.id: r.should_move for r in out["inodes"].collect()} == {i: False for i in range(1, 6)}


def test_tree_cycle_orphan_and_descendants(spark):
    import pytest
    ok = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (5, 77, "o")],
                               "id long, parent_id long, name string")
    assert rows(resolve_paths(ok)) == [(1, "/a"), (2, "/a/b"), (3, "/a/b/c"), (4, "/a/b/c/d"), (5, None)]
    assert rows(descendants(ok, spark.createDataFrame([(2,)], "id long"))) == [(2,), (3,), (4,)]
    some = spark.createDataFrame([(4,), (5,), (1,)], "id long")
    assert rows(resolve_paths_of(ok, some)) == [(1, "/a"), (4, "/a/b/c/d"), (5, None)]
    cyc = spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "id long, parent_id long, name string")
    with pytest.raises(ValueError):
        resolve_paths(cyc)
    with pytest.raises(ValueError):
        resolve_paths_of(cyc, spark.createDataFrame([(1,)], "id long"))
    assert rows(descendants(cyc, spark.createDataFrame([(1,)], "id long"))) == [(1,), (2,)]


def test_share_and_delete(spark):
    ino = inodes(spark, [(1, None, "file", "a.pdf", "/x/a.pdf", 0, None, None, True),
                         (2, None, "folder", "x", "/x", 0, None, None, False)])
    req = spark.createDataFrame([(1, 1), (2, 2)], "seq long, id long")
    out = J.share(req, ino)
    assert rows(out["tags"], "object_key", "tag") == [("users/u1/x/a.pdf", "True"),
                                                      ("users/u1/x/a_optimized.pdf", "True")]
    assert out["followups"].count() == 2
    dec = spark.createDataFrame([(7, 1, "file", "u1", "/x/a.pdf"), (8, 2, "folder", "u1", "/x")],
                                "seq long, before_id long, before_type string, before_owner_id string, "
                                "before_path string")
    assert J.delete(dec)["manifest"].count() == 2


def test_should_move_kept_when_path_unchanged(spark):
    """K12: ``should_move`` is reset only for inodes whose path changed."""
    ino = inodes(spark, [(1, None, "folder", "A", "/A", 0, None, None, False),
                         (2, 1, "file", "f.pdf", "/A/f.pdf", 0, None, None, False),
                         (3, 1, "file", "g.pdf", "/B/g.pdf", 0, None, None, False)])
    ino = ino.withColumn("should_move", F.lit(True))
    req = spark.createDataFrame([(1, 2), (2, 3)], "seq long, id long")
    out = J.move(req, ino)
    got = {r.id: (r.path, r.should_move) for r in out["inodes"].collect()}
    assert got == {1: ("/A", True), 2: ("/A/f.pdf", True), 3: ("/A/g.pdf", False)}
    assert rows(out["followups"], "seq") == [(2,)]


def test_blank_page_passes_filter_and_doc_ids(spark):
    """K6: a whitespace-only page has length > 0, so it is embedded and
    indexed; K16: doc field ``id`` is the inode id or the page id."""
    ino = inodes(spark, [(7, None, "file", "a.pdf", "/a.pdf", 0, 5, None, False)])
    pg = spark.createDataFrame([(70, 7, 0, "   ", None), (71, 7, 1, "", None)], schemas.PAGES)
    req = spark.createDataFrame([(1, 7)], "seq long, id long")
    emb = J.embed(req, ino, pg)
    assert rows(emb["pages"].where(F.col("embedding").isNotNull()), "id") == [(70,)]
    idx = J.index(req, emb["inodes"], emb["pages"])
    assert rows(idx["new_docs"], "doc_id", "id") == [("7", 7), ("7_0", 70)]


def test_delete_absent_id_is_noop(spark):
    """K22: deleting an id that is not in the index changes nothing."""
    docs = IX.inode_docs(inodes(spark, [(1, None, "file", "a", "/a", 0, None, None, False)]))
    out = IX.delete_from_index(docs, spark.createDataFrame([(42,)], "id long"))
    assert rows(out, "doc_id") == [("1",)]


def test_supplied_extractor_failure_keeps_error_null(spark):
    """K10: a supplied extractor that fails leaves ``error`` NULL; the inode
    counts as ingested, gets no pages, and the failure is in the status."""
    ino = inodes(spark, [(1, None, "file", "a.pdf", "/a.pdf", 0, None, None, False),
                         (2, None, "file", "b.pdf", "/b.pdf", 0, None, None, False)])
    objects = spark.createDataFrame([("users/u1/a.pdf", bytearray(b"%PDF-1.7 good")),
                                     ("users/u1/b.pdf", bytearray(b"%PDF-1.7 bad"))], "key string, content binary")

    def extractor(raw: bytes):
        if b"bad" in raw:
            raise ValueError("cannot parse")
        return ["page one", "page two"]

    req = spark.createDataFrame([(1, 1), (2, 2)], "seq long, id long")
    out = J.ingest(req, ino, objects, spark.createDataFrame([], schemas.PAGES), extractor=extractor)
    got = {r.id: (r.error, r.to_page, r.is_ingested) for r in out["inodes"].collect()}
    assert got == {1: (None, 2, True), 2: (None, None, True)}
    assert rows(out["pages"], "inode_id", "index") == [(1, 0), (1, 1)]
    failed = {r.id: r.extract_error for r in out["status"].collect()}
    assert failed[1] is None and failed[2].startswith("ValueError")


def test_colliding_keys_give_one_object(spark):
    """A root-level file or one without extension has no optimised key of its own (K7)."""
    ino = spark.createDataFrame([(1, "u", "/a.pdf", "/d/a.pdf", True), (2, "u", "/d/b", "/e/b", False), (3, "u", "/d/c.pdf", "/e/c.pdf", True)],
                                "id long, owner_id string, path string, new_path string, is_public boolean")
    assert rows(J.public_tags(ino), "id", "kind", "object_key", "collides") == [
        (1, "original", "users/u/a.pdf", True), (2, "original", "users/u/d/b", True),
        (3, "optimized", "users/u/d/c_optimized.pdf", False), (3, "original", "users/u/d/c.pdf", False)]
    assert rows(J.move_pairs(ino), "id", "kind", "old_key", "new_key", "collides") == [
        (1, "original", "users/u/a.pdf", "users/u/d/a.pdf", True), (2, "original", "users/u/d/b", "users/u/e/b", True),
        (3, "optimized", "users/u/d/c_optimized.pdf", "users/u/e/c_optimized.pdf", False), (3, "original", "users/u/d/c.pdf", "users/u/e/c.pdf", False)]
    assert rows(J.upload_manifest(ino), "id", "source_key", "object_key", "collides") == [
        (1, "users/u/a.pdf", "users/u/a.pdf", True), (2, "users/u/d/b", "users/u/d/b", True),
        (3, "users/u/d/c.pdf", "users/u/d/c_optimized.pdf", False)]
