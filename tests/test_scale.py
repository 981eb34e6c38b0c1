"""Results at scale: steps whose shuffles, memory or driver traffic grew faster than the input.
Rows are built here."""

import json

import numpy as np
import pandas as pd
import pytest

from pagewright.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables: 130 documents in two sources, 8 vectors, 600 events, 3 objects."""
    root = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(7)
    words = ["alpha", "Beta", "gamma", "delta", "eps1"]
    docs = [(i, " ".join(rng.choice(words, 30 + 60 * (i % 7))), "de" if i % 2 else "en", f"src{i % 2}") for i in range(130)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, rng.random(64).tolist()) for i in range(8)], "vec_id bigint, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    kinds = ["signup", "view", "click", "purchase"]
    events = [(i, i % 5, kinds[i % 4], json.dumps({"k": i % 130})) for i in range(600)]
    (spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string, props string").selectExpr("*", "timestamp'2024-01-01' AS ts")
     .write.parquet(f"{root}/events.parquet"))
    pages = [(i, f"http://x/{i}", f"<html><body>{w} {i}</body></html>") for i, w in enumerate(words[:3])]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "gamma beta")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return root


def test_embed_vectors_can_be_written(spark, tables, tmp_path):
    QUERIES["embed_vectors"](spark, tables).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(out) == out["id"].nunique() > 0


def test_nearest_rows_decided_in_double_precision(spark):
    """Rows that single precision cannot tell apart, ties, and vectors without a distance."""
    from pagewright.operators import knn as K
    rng = np.random.default_rng(3)
    base = rng.random(16)
    V = np.vstack([base + 1e-5 * rng.random((900, 16)), rng.random((300, 16)), np.repeat(base[None], 20, 0)])
    Q = np.vstack([base + 1e-5 * rng.random((5, 16)), rng.random((30, 16)) * 100])
    vectors = pd.DataFrame({"vid": rng.permutation(len(V) + 1), "vvec": [*V, np.full(16, np.nan)]})
    r, v, d = (np.concatenate(x) for x in K._topk_one(10, 64, pd.DataFrame({"qid": np.arange(len(Q)), "qvec": list(Q)}), vectors))
    for n, one in enumerate(Q):
        exact = ((V - one) ** 2).sum(1)
        want = vectors["vid"].to_numpy()[:-1][np.lexsort((vectors["vid"].to_numpy()[:-1], np.round(exact, 9)))[:10]]
        assert v[r == n].tolist() == want.tolist()


def test_coded_search_hands_on_a_bounded_number_of_rows(spark):
    """Per query at most ``rerank`` rows of a block, however many lists it probes."""
    from pagewright.operators import pq as PQ
    rng = np.random.default_rng(5)
    vdf = spark.createDataFrame([(i, rng.random(8).tolist()) for i in range(600)], "id bigint, embedding array<double>")
    qdf = vdf.where("id < 20")
    codec = PQ.fit(vdf, parts=4, cells=6)
    codes = PQ.encode(vdf, codec)
    found, scored = PQ.search(qdf, vdf, codes, codec, k=3, nprobe=6, rerank=600)
    assert scored.count() == 20 * 600 and found.where("rank = 1").select("qid", "vid").where("qid = vid").count() == 20
    points = np.array([r[0] for r in vdf.orderBy("id").select("embedding").collect()])
    decoded = codec.decode(codec.encode(points))
    assert decoded.shape == points.shape and ((decoded - points) ** 2).sum(1).mean() < ((points - points.mean(0)) ** 2).sum(1).mean() / 4


def test_blocks_meet_in_any_number_of_partitions(spark):
    from pagewright.operators import knn as K, pq as PQ
    rng = np.random.default_rng(6)
    vdf = spark.createDataFrame([(i, rng.random(4).tolist()) for i in range(300)], "id bigint, embedding array<double>")
    codec = PQ.fit(vdf, parts=2, cells=4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        exact = K.knn_exact(vdf, vdf, k=5, q_block=40, v_block=50).collect()
        cells = K.knn_approx(vdf, vdf, k=5, cells=3, nprobe=3, q_block=40, v_block=50).collect()
        found, _ = PQ.search(vdf, vdf, PQ.encode(vdf, codec), codec, k=5, nprobe=4, rerank=300)
        coded = found.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(exact) == 1500
    assert sorted((r.qid, r.vid) for r in exact) == sorted((r.qid, r.vid) for r in cells) == sorted((r.qid, r.vid) for r in coded)


def test_words_are_cut_inside_their_documents_row(spark):
    from pagewright.operators import search as S
    docs = spark.createDataFrame([(1, "Ab, cd é12 ab"), (2, ""), (3, None), (4, "  x"), (5, "a b"), (5, "a b"), (None, "z")], "id bigint, contents string")
    tv = S.term_vectors(docs, with_next=True)
    rows = sorted((tuple(r) for r in tv.collect()), key=str)
    assert sorted((r for r in rows if r[0] == 1), key=lambda r: r[2]) == [
        (1, "ab", 0, 0, 2, "cd", 6), (1, "cd", 1, 4, 6, "é12", 10), (1, "é12", 2, 7, 10, "ab", 13), (1, "ab", 3, 11, 13, None, None)]
    assert [r for r in rows if r[0] in (4, None)] == [(4, "x", 0, 2, 3, None, None), (None, "z", 0, 0, 1, None, None)]
    # Rows of one id are counted run by run, as one document.
    assert sorted(r[1:5] for r in rows if r[0] == 5) == [("a", 0, 0, 1), ("a", 1, 1, 2), ("b", 2, 4, 5), ("b", 3, 5, 6)]
    stats = {r.term: (r.df, r.cf) for r in S.term_stats(S.term_rows(docs)).collect()}
    assert stats == {r.term: (r.df, r.cf) for r in S.term_stats(S.term_vectors(docs)).collect()} and stats["ab"] == (1, 2)
    for frame in (S.term_vectors(docs), S.next_words(tv), S.term_rows(docs)):
        assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()


def test_only_documents_that_were_hit_are_cut_for_highlights(spark, tables, monkeypatch):
    from pagewright.plans import catalog
    cut, real = [], catalog.S.term_vectors
    monkeypatch.setattr(catalog.S, "term_vectors", lambda docs, **kw: cut.append(docs.count()) or real(docs, **kw))
    assert QUERIES["highlights"](spark, tables).select("id").distinct().count() == 10
    assert cut == [10]


def test_tree_walk_is_not_sent_through_the_driver(spark, monkeypatch):
    from pagewright.operators import tree
    plans, real = [], tree.materialize

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(tree, "materialize", noted)
    rows = tree.tree_intervals(spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3)], "id bigint, parent_id bigint")).collect()
    assert {r.id: (r.leave - r.enter - 1) // 2 for r in rows} == {1: 3, 2: 0, 3: 1, 4: 0}
    assert sum(p.count("SortMergeJoin") for p in plans) >= 6 and not any("BroadcastHashJoin" in p for p in plans if "_off" not in p)


def test_each_commit_reads_its_own_requests(spark, tmp_path, monkeypatch):
    from pagewright.operators import embed as E
    read, real = [], E.embed_pages
    monkeypatch.setattr(E, "embed_pages", lambda pages, *a: read.append(pages._jdf.queryExecution().optimizedPlan().toString()) or real(pages, *a))
    pages = spark.createDataFrame([(i, i, 0, f"text {i}") for i in range(6)], "id bigint, inode_id bigint, index int, text string")
    out = E.embed_stored(pages, E.hashed_embedder(4), str(tmp_path / "store"), 64, 1).collect()
    assert len(out) == 6 and all(r.status == "ok" for r in out)
    assert len(read) == 6 and not any("xxhash64" in plan for plan in read)     # a partition each, not a filter over all


def test_queries_pass_by_slices_of_postings(spark, monkeypatch):
    """Any number of slices gives the same pages, and no group of queries meets a block as a whole."""
    from pagewright.operators import postings as P
    rng = np.random.default_rng(11)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(list("abcdefgh"), 1 + i % 9))) for i in range(300)], "id bigint, contents string")
    queries = spark.createDataFrame([(i, " ".join(rng.choice(list("abcdefghz"), 3))) for i in range(40)] + [(90, "zz"), (91, None)], "id bigint, query string")
    index = P.bm25_index(docs, pages_per_block=16)
    found = {}
    for slices, postings in ((1, 10_000), (24, 10_000), (1, 60)):
        monkeypatch.setattr(P, "SLICES", slices)
        monkeypatch.setattr(P, "POSTINGS_PER_SLICE", postings)
        out = P.bm25(index, queries, k=5)
        assert "FlatMapCoGroups" not in out._jdf.queryExecution().executedPlan().toString()
        found[slices, postings] = sorted((r.qid, r.rank, r.id, round(r.score, 9)) for r in out.collect())
    assert len(found[1, 10_000]) == 200 and found[1, 10_000] == found[24, 10_000] == found[1, 60]


def test_vectors_are_dealt_out_once_whatever_the_queries(spark):
    """Queries pass by slices of the vectors: no copies of a vector, and any cut gives the same rows."""
    from pagewright.operators import knn as K
    rng = np.random.default_rng(12)
    vdf = spark.createDataFrame([(i, rng.random(6).tolist()) for i in range(400)] + [(7, [0.5] * 6), (401, None), (402, [float("nan")] * 6)], "id bigint, embedding array<float>")
    qdf = spark.createDataFrame([(i, rng.random(6).tolist()) for i in range(90)] + [(99, None)], "id bigint, embedding array<float>")
    whole = K.knn_exact(qdf, vdf, k=4)
    assert "FlatMapCoGroups" not in whole._jdf.queryExecution().executedPlan().toString()
    want = sorted(tuple(r) for r in whole.collect())
    assert len(want) == 360
    for found in (K.knn_exact(qdf, vdf, k=4, q_block=11, v_block=30), K.knn_approx(qdf, vdf.where("id != 402"), k=4, cells=5, nprobe=5, v_block=50)):
        assert "FlatMapCoGroups" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == want


def test_coded_search_shuffles_codes_by_the_thousand(spark):
    """Codes travel packed, and a query hands on one row, not its best of every block."""
    from pagewright.operators import knn as K, pq as PQ
    rng = np.random.default_rng(13)
    vdf = spark.createDataFrame([(i, rng.random(6).tolist()) for i in range(5000)], "id bigint, embedding array<float>").repartition(1)
    qdf = vdf.where("id < 60")
    codec = PQ.fit(vdf, parts=3, cells=4)
    codes = PQ.encode(vdf, codec)
    packed = codes.mapInArrow(PQ._packed, "ids array<bigint>, cells array<int>, codes binary")
    assert packed.count() == 2 and tuple(packed.selectExpr("sum(size(ids))", "sum(length(codes))").first()) == (5000, 15000)
    found, scored = PQ.search(qdf, vdf, codes, codec, k=3, nprobe=4, rerank=5000)
    assert scored.count() == 60 * 5000
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.qid, r.vid, r.rank) for r in found.collect()) == sorted((r.qid, r.vid, r.rank) for r in K.knn_exact(qdf, vdf, k=3).collect())


def test_many_small_objects_are_read_by_few_tasks(spark, tmp_path):
    from pagewright.sources.objects import LISTING, read_objects
    for n in range(120):
        (tmp_path / f"d{n}").mkdir()
        (tmp_path / f"d{n}" / "x.txt").write_bytes(b"%d" % n)
    before = spark.conf.get(LISTING)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        objects = read_objects(spark, str(tmp_path), glob="*.txt")
        assert objects.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism < 120
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.conf.get(LISTING) == before
    assert sorted((r.key, bytes(r.content)) for r in objects.collect()) == sorted((f"d{n}/x.txt", b"%d" % n) for n in range(120))
