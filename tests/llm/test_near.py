"""N-gram join and quality against brute force and held-out labels."""

import zlib

import numpy as np
import pytest

from pagewright.llm import ngram_join, quality
from pagewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc, class, copies' least id, links) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    links, least = [0] * len(rows), []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                group[max(root(i), root(j))] = min(root(i), root(j))
    for i, (d, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        copies = [rows[j][0] for j in range(len(rows)) if sets[j] == sets[i] and rows[j][0] is not None]
        least.append((d, min(same, default=None), min(copies, default=None), links[i]) if sets[i] else (d, d, d, 0))
    return least


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def joined(df, **kw):
    return sorted((tuple(r) for r in ngram_join.jaccard_join(df, **kw).collect()), key=key)


def test_join_equals_brute_force_on_the_table(spark, documents):
    got = sorted((tuple(r) for r in QUERIES["op2_ngram_jaccard"](spark, SF).collect()), key=key)
    assert got == sorted(brute(documents), key=key)
    assert sum(r[3] for r in got) > 0


def test_join_edges(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    base = " ".join(f"b{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "one  two"), (6, "two one"), (None, "one two"), (7, long), (8, long + " x"),
            (8, long + " x"), (9, base), (9, base), (10, base + " tail"), (None, base), (11, "🙂 é b c d e")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, fp string, band int")
    assert joined(df) == sorted(brute(rows), key=key)
    assert joined(df.limit(0)) == []


def test_one_document_of_each_group_stays(spark, documents):
    rows = documents + [(None, documents[0][1]), (5000, None), (5000, None), (5001, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, _id int")
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=lambda r: r[0])
    wanted = {c for d, c, _, _ in brute(rows) if d is not None}
    assert [d for d, _ in got] == sorted(wanted)
    assert all(t == dict(rows)[d] for d, t in got)


def test_join_of_a_dense_group_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "CHUNK", 64)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(90):
        words = list(base)
        for p in rng.choice(120, rng.integers(0, 4), replace=False):
            words[p] = f"z{rng.integers(1000)}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert joined(df) == sorted(brute(rows), key=key)


def test_connected_follows_long_chains(spark):
    edges = spark.range(200).selectExpr("lpad(id, 4, '0') as a", "lpad(id + 1, 4, '0') as b")
    assert {r["label"] for r in ngram_join.connected(edges).collect()} == {"0000"}


def test_bands_reach_the_wanted_recall():
    for rows in (3, 4, 5, 6):
        b = ngram_join.bands_for(0.8, 0.9999, rows)
        assert 1 - (1 - 0.8 ** rows) ** b >= 0.9999 > 1 - (1 - 0.8 ** rows) ** (b - 1)


def test_intersections_equal_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(12)]
    got = ngram_join.intersections(sets, np.arange(5), np.arange(5, 12))
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[5:]] for a in sets[:5]]


# -- quality ----------------------------------------------------------------------

def test_quality_of_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op9_line_crf"](spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = [p for p, y in held if y == 1]
    bad = [p for p, y in held if y == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    emit, move = rng.normal(size=(3, 4, 2)), rng.normal(size=(2, 2))
    lengths = np.array([4, 2, 1])
    good, edges, z = quality.chain(emit, lengths, move)
    want_edges = np.zeros((2, 2))
    for d, n in enumerate(lengths):
        paths = np.array(np.meshgrid(*[[0, 1]] * n, indexing="ij")).reshape(n, -1).T
        score = np.array([sum(emit[d, t, y] for t, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
        p = np.exp(score) / np.exp(score).sum()
        assert z[d] == pytest.approx(np.log(np.exp(score).sum()))
        assert good[d, :n] == pytest.approx([(p * paths[:, t]).sum() for t in range(n)])
        for path, w in zip(paths, p):
            for a, b in zip(path, path[1:]):
                want_edges[a, b] += w
    assert edges == pytest.approx(want_edges)


def test_quality_edges(spark):
    texts = [None, "", "\n\n", "x" * 60000, "a b " * 20000, "🙂\x00́", "same", "same", "\n" * 5000]
    df = spark.createDataFrame([(i if i else None, t, "other", 1.5) for i, t in enumerate(texts)],
                               "doc_id bigint, text string, label string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (4, 1), (4, 0), (5, 1), (6, 0), (9, 7)], "doc_id bigint, quality int")
    for labels in (none, odd):
        model = quality.fit_quality(df, labels)
        rows = quality.score_quality(df, model).collect()
        assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
        assert rows[0].asDict().keys() == {"doc_id", "text", "label", "score"}
    assert quality.score_quality(df.limit(0), model).count() == 0


def test_features_do_not_depend_on_the_batch():
    texts = ["A b!\nC d", "", "x\n\ny y y", "ÀÉ 12 ###"]
    own, size, per_text = quality.line_features(texts)
    alone = [quality.line_features([t]) for t in texts]
    assert np.allclose(own, np.concatenate([a[0] for a in alone]))
    model = quality.LineModel(np.random.default_rng(0).normal(size=3 * quality.OWN + 3), np.array([[.5, -.2], [-.3, .4]]))
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])


def test_line_labels_change_inside_documents():
    """Bad documents whose last lines read like the good ones: the fitted chain tells the two kinds apart."""
    rng = np.random.default_rng(5)
    good = lambda: " ".join(rng.choice(["the", "house", "stood", "quietly", "near", "a", "river"], 9)).capitalize() + "."
    bad = lambda: "".join(rng.choice(list("!!$#@%&*0123456789ABCXYZ"), 40))
    texts = ["\n".join(good() for _ in range(12)) for _ in range(300)] + ["\n".join([bad() for _ in range(10)] + [good() for _ in range(2)]) for _ in range(10)]
    own, size, per_text = quality.line_features(texts)
    label = np.array([1.0] * 300 + [0.0] * 10)
    made = quality.line_labels(quality.with_neighbours(own, per_text), per_text, label).reshape(310, 12)
    assert (made[:300] == 1).all() and (made[300:, :10] == 0).all() and made[300:, 11].mean() > 0.9
    model = quality.fit_lines(own, size, per_text, label)
    halves = np.array(model.good_share(*quality.line_features(["\n".join(bad() for _ in range(4)), "\n".join(good() for _ in range(4)),
                                                               "\n".join([bad() for _ in range(4)] + [good() for _ in range(4)])])))
    assert halves[0] < 0.2 and halves[1] > 0.8 and 0.15 < halves[2] < 0.9


def test_document_score_is_the_weighted_marginals_by_enumeration():
    """Every labelling of every line, weighed: the score of small texts without the recursion."""
    import itertools
    rng = np.random.default_rng(6)
    model = quality.LineModel(rng.normal(size=3 * quality.OWN + 3) / 3, np.array([[.8, -.4], [-.1, .6]]), 1.3, -0.2)
    for text in ("one line", "Two lines.\nHERE 12", "a\n\nb!!\nlonger line of words", "x\ny\nz\n\nw"):
        own, size, per_text = quality.line_features([text])
        emission = quality.with_neighbours(own, per_text) @ model.weights
        weights, goods = [], []
        for ys in itertools.product((0, 1), repeat=len(emission)):
            weights.append(np.exp(sum(e * y for e, y in zip(emission, ys)) + sum(model.move[a, b] for a, b in zip(ys, ys[1:]))))
            goods.append(sum(y * (n + 1.0) for y, n in zip(ys, size)) / (size + 1.0).sum())
        share = np.clip(np.dot(weights, goods) / np.sum(weights), 1e-6, 1 - 1e-6)
        want = 1 / (1 + np.exp(-(model.slope * np.log(share / (1 - share)) + model.shift)))
        assert abs(model.score([text])[0] - want) < 1e-9
