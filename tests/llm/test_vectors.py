"""Exact top-k and learned partitions against brute force."""

import numpy as np
import pytest

from pagewright.llm import exact_topk, learned_partitions
from pagewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, score string, rank int"
NAN, INF = float("nan"), float("inf")


def brute_integer(rows, k, every):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def brute_cosine(rows, k, every):
    ok = [(i, np.array(v, dtype=float)) for i, v, *_ in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            best = sorted((-(a @ b) / np.sqrt((a @ a) * (b @ b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out.setdefault(q, []).extend((i, -s) for s, i in best)
    return out


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    return [(r["vec_id"], list(r["embedding"])) for r in
            spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]


EDGE = [
    (0, [1.0, 0.0, 0.5], "a", 1), (1, [1.0, 0.0, 0.5], "b", 2), (2, [1.0, 0.0, 0.5], None, None), (3, None, "c", 3),
    (4, [NAN, 1.0, 1.0], "", 0), (5, [INF, 1.0, 1.0], "", 0), (6, [None, 1.0, 1.0], "", 0), (7, [0.0, 0.0, 0.0], "", 0),
    (None, [1.0, 1.0, 1.0], "", 0), (8, [-1.0, 0.25, 0.5], "", 0), (9, [2.0, 3.0], "", 0), (10, [1.0, -3.0], "", 0),
    (20, [0.5, 0.5, 0.5], "", 0), (20, [0.5, 0.5, 0.5], "", 0), (30, [], "", 0), (40, [0.3], "", 0),
]


def test_topk_whole_table_equals_brute_force(spark, table):
    assert rows_of(QUERIES["op10_uniform_threshold"](spark, SF)) == brute_integer(table, 5, 50)


@pytest.mark.parametrize("slices", [1, 2, 3, 64])
def test_topk_any_slicing_and_small_blocks(spark, table, slices, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(exact_topk, "VECTOR_BLOCK", 60)
    df = spark.createDataFrame(table[:200], "vec_id bigint, embedding array<double>")
    assert rows_of(exact_topk.uniform_threshold_topk(df, k=3, slices=slices)) == brute_integer(table[:200], 3, 50)


@pytest.mark.parametrize("rows", [EDGE, EDGE[:1], [], [(0, [0.5, 0.5], "", 0)] * 3 + [(7, [0.5, 0.5], "", 0)] * 30])
def test_topk_edges(spark, rows):
    got = rows_of(exact_topk.uniform_threshold_topk(spark.createDataFrame(rows, SCHEMA), k=4, query_every=10))
    assert got == brute_integer(rows, 4, 10)


def whole_numbers(v, scale=256):
    ratios = [float(x).as_integer_ratio() for x in v]
    return [top * scale // bottom for top, bottom in ratios]


def test_topk_of_components_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(exact_topk, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(exact_topk, "QUERY_GROUP", 5)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=2 + i % 2) * rng.choice([1, 1, 1e3, 1e9, 1e30, 1e200], size=2 + i % 2)])
            for i in range(300)]
    rows += [(1000 + i, [-1.0, -1.0, -1.0, 0.5]) for i in range(200)] + [(2000, [1.0, 1.0, 1.0, 0.25])]     # cutoffs below zero
    rows += [(50, [1e30, 1.0]), (301, [1e30, 2.0])]
    made = {}
    for n, (i, v) in enumerate(rows):
        made.setdefault(len(v), []).append((i, whole_numbers(v), n))
    want = []
    for same in made.values():
        for q, a, _ in same:
            if q % 50 == 0:
                best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b, _ in same if i != q)[:5]
                want += [(q, r + 1, i, max(-2 ** 63, min(2 ** 63 - 1, -s))) for r, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert rows_of(exact_topk.uniform_threshold_topk(df)) == sorted(want)


def test_scores_beyond_a_long_keep_their_order():
    values = sorted([0, 5, -5, 2 ** 63 - 1, 2 ** 63, 2 ** 63 + 1, 10 ** 40, 10 ** 40 + 1, -2 ** 63, -2 ** 63 - 1, -10 ** 40, -10 ** 41, -10 ** 41 - 1])
    assert sorted(values, key=exact_topk.told) == values
    assert [exact_topk.read_back(*map(str, exact_topk.told(v))) for v in values] == values


def test_learned_partitions_recall_and_scores(spark, table):
    want = brute_cosine(table, 5, 50)
    got = rows_of(QUERIES["op1_learned_partitions"](spark, SF))
    lists = {}
    for q, rank, i, s in got:
        lists.setdefault(q, []).append(i)
        exact = dict(table)[q], dict(table)[i]
        a, b = map(np.array, exact)
        assert s == pytest.approx((a @ b) / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    hit = sum(len(set(lists[q]) & {i for i, _ in w}) for q, w in want.items())
    assert hit / sum(map(len, want.values())) >= 0.9


def test_learned_partitions_many_parts(spark, table, monkeypatch):
    monkeypatch.setattr(learned_partitions, "ROWS_PER_PART", 60)
    monkeypatch.setattr(learned_partitions, "VECTOR_BLOCK", 25)
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>")
    want = brute_cosine(table, 5, 10)
    lists = {}
    for q, rank, i, s in rows_of(learned_partitions.nearest(df, query_every=10)):
        lists.setdefault(q, []).append((rank, i))
    hit = sum(len({i for _, i in lists[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hit / sum(map(len, want.values())) >= 0.9
    assert all([r for r, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in lists.values())


def test_learned_partitions_visit_few_parts_of_clustered_rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    x = learned_partitions.unit(centres[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 32)))
    router, share = learned_partitions.fit_index(x[:2500], 50, 5, 0.96)
    queries = np.arange(0, 6000, 50)
    order, count = learned_partitions.visits(router, x[queries], share)
    part = router.probabilities(x).argmax(axis=1)
    size = np.bincount(part, minlength=50)
    near = np.argsort(-(x[queries] @ x.T), axis=1)[:, 1:6]
    hit = [np.isin(part[b], o[:c]).mean() for b, o, c in zip(near, order, count)]
    assert np.mean(hit) >= 0.9
    assert np.mean([size[o[:c]].sum() for o, c in zip(order, count)]) < 0.3 * len(x)
    assert size.max() < 3 * size.mean() and count.min() < count.max()


def test_learned_partitions_components_of_any_size(spark):
    rng = np.random.default_rng(2)
    directions = rng.normal(size=(40, 6))
    rows = [(i, [float(c) for c in v * scale]) for i, (v, scale) in enumerate(zip(directions, np.resize([1.0, 1e200, 1e-200, 1e-310], 40)))]
    got = rows_of(learned_partitions.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=3, query_every=10))
    want = sorted((q, i) for q, w in brute_cosine([(i, list(v)) for i, v in enumerate(directions)], 3, 10).items() for i, _ in w)
    assert sorted((q, i) for q, _, i, _ in got) == want and all(-1 <= s <= 1 + 1e-12 for *_, s in got)


@pytest.mark.parametrize("rows", [EDGE, EDGE[:1], []])
def test_learned_partitions_edges(spark, rows):
    got = rows_of(learned_partitions.nearest(spark.createDataFrame(rows, SCHEMA), k=3, query_every=10))
    want = brute_cosine(rows, 3, 10)
    assert [(q, i) for q, _, i, _ in got] == sorted((q, i) for q, w in want.items() for i, _ in w) or \
        sorted((q, i) for q, _, i, _ in got) == sorted((q, i) for q, w in want.items() for i, _ in w)


def test_balanced_parts_have_bounded_sizes():
    rng = np.random.default_rng(0)
    x = learned_partitions.unit(np.concatenate([rng.normal(c, 0.1, (150, 8)) for c in (-1, 0.3, 1)]))
    label = learned_partitions.balanced_parts(x, learned_partitions.neighbours(x, 8), 6)
    assert np.bincount(label, minlength=6).max() <= np.ceil(1.05 * len(x) / 6)
