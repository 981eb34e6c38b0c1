"""Scalar functions against the Python semantics they mirror."""

import re
from pathlib import PurePosixPath

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagewright.functions import (obfuscate_email, optimized_path, parent_folder, path_ancestors, public_tag,
                                  squash_ws, strip_nul, truncate_tokens, fill_to_page, in_page_range)

# The whitespace code points of Python's str.split().
PY_WS = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", " "] + \
    [chr(c) for c in range(0x2000, 0x200B)] + [" ", " ", " ", " ", "　"]


def one_col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_whitespace_class_is_complete():
    assert len(PY_WS) == 29
    assert all(c.isspace() for c in PY_WS)
    assert not any(chr(c).isspace() for c in range(0x10000) if chr(c) not in PY_WS)


def test_squash_ws_every_code_point(spark):
    values = [f"{c}a{c}{c}b{c}" for c in PY_WS] + ["", "   ", "\x0c", "x​y"]
    assert one_col(spark, values, squash_ws) == [" ".join(v.split()) for v in values]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(PY_WS + list("ab é​")), max_size=12), min_size=1, max_size=20))
def test_squash_ws_property(spark, values):
    assert one_col(spark, values, squash_ws) == [" ".join(v.split()) for v in values]


def test_strip_nul(spark):
    assert one_col(spark, ["a\x00b\x00", "x"], strip_nul) == ["ab", "x"]


def test_truncate_tokens(spark):
    vals = ["a  b\tc d", "", "one"]
    assert one_col(spark, vals, lambda c: truncate_tokens(c, 2)) == [" ".join(v.split()[:2]) for v in vals]


# Edge paths of FIXTURES.md §3.
PATHS = ["/file.pdf", "/x/file.pdf", "/x/report.v1.pdf", "/x/.hidden.pdf", "/x/y/.hidden.pdf", "/x/noext",
         "/x/a.b/c", "/a.b/c.pdf", "/x/trail.", "/x/f.pdf/", "/x/y z/é.PDF"]


def py_optimized(p):
    return re.sub(r"(.+)(/[^/.]+)(\..+)$", r"\1\2_optimized\3", p)


def test_optimized_path_edges(spark):
    assert one_col(spark, PATHS, optimized_path) == [py_optimized(p) for p in PATHS]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("/.ab_é")), max_size=10), min_size=1, max_size=20))
def test_optimized_path_property(spark, values):
    assert one_col(spark, values, optimized_path) == [py_optimized(p) for p in values]


def test_parent_folder_edges(spark):
    vals = ["/a/b.pdf", "/a", "/", "/a/b/", "//a/b", "/a//b", "/a/./b", "a", "/a/b/.."]
    assert one_col(spark, vals, parent_folder) == ["/a", "/", "/", "/a", "//a", "/a", "/a", ".", "/a/b"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("/.ab")), min_size=1, max_size=10), min_size=1, max_size=20))
def test_parent_folder_property(spark, values):
    assert one_col(spark, values, parent_folder) == [str(PurePosixPath(v).parent) for v in values]


def test_obfuscate_email_edges(spark):
    vals = ["jo.han@x.org", "a@b@c", "noat", "@x", "é€@x", "ab\nc@c", None]
    assert one_col(spark, vals, obfuscate_email) == ["******@x.org", "*@b", "****@", "@x", "**@x", "****@c", None]


def test_path_ancestors(spark):
    got = one_col(spark, ["/a/b/c", "/", "/a"], path_ancestors)
    assert got == [["/a", "/a/b", "/a/b/c"], ["/"], ["/a"]]


def test_public_tag_and_ranges(spark):
    df = spark.createDataFrame([(True, 5, 0, 3, None), (False, 1, 3, 3, 10)],
                               "b boolean, idx int, lo int, hi int, tp int")
    got = df.select(public_tag("b"), in_page_range("idx", "lo", "hi"), fill_to_page("tp", F.lit(7))).collect()
    assert [tuple(r) for r in got] == [("True", False, 7), ("False", False, 10)]
