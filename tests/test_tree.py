"""Intervals of the folder tree, subtrees and cascades against a plain walk."""

import random

from pyspark.sql import functions as F

from pagewright.operators.tree import cascade_delete, descendants, inside, tree_intervals

from conftest import rows


def frame(spark, edges):
    return spark.createDataFrame(edges, "id long, parent_id long")


def below(edges, roots):
    kids = {}
    for i, p in edges:
        kids.setdefault(p, []).append(i)
    out, todo = set(roots), list(roots)
    while todo:
        for c in kids.get(todo.pop(), []):
            if c not in out:
                out.add(c)
                todo.append(c)
    return out


def test_intervals_are_a_walk_through_the_tree(spark):
    rng = random.Random(7)
    edges = [(10 * i, None if rng.random() < 0.05 else 10 * rng.randrange(max(1, i)) if i else None) for i in range(300)]
    edges += [(5000, 9999), (5001, 5000)]                 # a missing parent: a top
    got = {r["id"]: (r["enter"], r["leave"]) for r in tree_intervals(frame(spark, edges)).collect()}
    places = sorted(x for pair in got.values() for x in pair)
    assert places == list(range(2 * len(edges)))
    for i, p in edges:
        assert got[i][0] < got[i][1]
        if p in got:
            assert got[p][0] < got[i][0] and got[i][1] < got[p][1]
    for root in (0, 50, 2990, 5000):
        a, b = got[root]
        assert {i for i, (x, _) in got.items() if a <= x <= b} == below(edges, [root])


def test_descendants_of_many_roots_and_through_cycles(spark):
    rng = random.Random(8)
    edges = [(i, rng.randrange(i) if i and rng.random() < 0.97 else None) for i in range(500)]
    edges += [(1000, 1002), (1001, 1000), (1002, 1001), (1003, 1002), (1004, 1003), (1005, 1005)]     # cycles, and what hangs on one
    df = frame(spark, edges)
    intervals = tree_intervals(df)
    assert {r["id"] for r in intervals.where("enter is null").collect()} == {1000, 1001, 1002, 1003, 1004, 1005}
    for roots in ([3], [3, 4, 40, 499], [1001], [1003, 7], [1005], [77777], []):
        asked = spark.createDataFrame([(r,) for r in roots * 2], "id long")
        assert {r["id"] for r in descendants(df, asked, intervals=intervals).collect()} == below(edges, roots)
    for levels in (0, 1, 3):        # a few levels, then the intervals
        asked = spark.createDataFrame([(3,), (1001,)], "id long")
        assert {r["id"] for r in descendants(df, asked, levels=levels).collect()} == below(edges, [3, 1001])
    asked = spark.createDataFrame([(3,), (4,), (40,)], "id long")
    small = inside(intervals, asked, block=16)
    assert {r["id"] for r in small.collect()} == below(edges, [3, 4, 40])
    assert rows(descendants(df.limit(0), asked)) == [(3,), (4,), (40,)]


def test_a_chain_of_many_folders_takes_few_rounds(spark, monkeypatch):
    from pagewright.operators import tree
    n, rounds = 100_000, []
    write = tree.materialize
    monkeypatch.setattr(tree, "materialize", lambda df, name="tmp": (rounds.append(name), write(df, name))[1])
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = tree_intervals(chain)
    assert got.where((F.col("enter") != F.col("id")) | (F.col("leave") != 2 * n - 1 - F.col("id"))).count() == 0
    assert rounds.count("walk") <= 20
    asked = spark.createDataFrame([(n - 1000,), (n - 10,)], "id long")
    assert descendants(chain, asked, intervals=got).count() == 1000


def test_cascade_uses_the_subtree(spark):
    ino = frame(spark, [(1, None), (2, 1), (3, 2), (4, None)])
    pages = spark.createDataFrame([(30, 3), (40, 4)], "id long, inode_id long")
    links = spark.createDataFrame([(7, 2), (7, 4)], "conversation_id long, inode_id long")
    gone = spark.createDataFrame([(1,), (99,)], "id long")
    sources = spark.createDataFrame([(5, 30), (5, 40)], "prompt_id long, page_id long")
    got = {tuple(r) for r in cascade_delete(ino, pages, links, gone, sources=sources).select("kind", "key1", "key2").collect()}
    assert got == {("inode", 1, None), ("inode", 2, None), ("inode", 3, None), ("page", 30, None), ("conversation_link", 7, 2), ("source", 5, 30)}
