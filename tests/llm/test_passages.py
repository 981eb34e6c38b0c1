"""Winnowing, conversation trie and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagewright.llm import conversation_trie, periodic_runs, winnowing
from pagewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- winnowing --------------------------------------------------------------------

def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute_hits(text, items, window=10):
    words = words_of(text)
    hit, names = set(), set()
    for name, other in items:
        own = words_of(other)
        span = min(len(own), window)
        parts = {tuple(own[i:i + span]) for i in range(len(own) - span + 1)} if own else set()
        for i in range(len(words) - span + 1 if own else 0):
            if tuple(words[i:i + span]) in parts:
                hit.update(range(i, i + span))
                if name is not None:
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def leaky(rng):
    vocabulary = ["a", "Be", "see", "d1", "é", "ñandú", "日本", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 7, 9, 10, 11, 25])))) for i in range(12)]
    items += [(3, items[7][1]), (None, "never seen by any item at all 1 2 3 4 5"), (40, None), (41, ""), (10, "...")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(own) - 10))
            parts.insert(rng.randint(0, 2), rng.choice([", ", "\n"]).join(own[a:a + rng.choice([9, 10, 14])]).upper())
        docs.append((rng.choice([i, i, 5, None]), " - ".join(parts)))
    return items, docs + [(900, None), (901, ""), (902, "!"), (903, "NEVER seen-by any item, at ALL 1 2 3 4 5 6")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontaminate_equals_brute_force(spark, monkeypatch, broadcast):
    items, docs = leaky(random.Random(3))
    monkeypatch.setattr(winnowing, "BLOCK", 64)         # many blocks, whole words
    if not broadcast:
        monkeypatch.setattr(winnowing, "BROADCAST_BYTES", -1)
    d = spark.createDataFrame([(i, t, i, "r") for i, t in docs], "doc_id bigint, text string, row bigint, words string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, wid int")
    got = winnowing.decontaminate(d, b).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == Counter(
        (i, n, h, tuple(names)) for i, t in docs for n, h, names in [brute_hits(t, items)])
    for r in got:
        flat = [(s["start"], s["end"]) for s in r["spans"]]
        assert flat == sorted(flat) and all(a[1] < b[0] for a, b in zip(flat, flat[1:]))
        assert sum(e - s for s, e in flat) == r["n_hit"]


def test_decontaminate_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert [(r["n_hit"], r["items"]) for r in winnowing.decontaminate(d, b.limit(0)).collect()] == [(0, [])]
    assert winnowing.decontaminate(d.limit(0), b).count() == 0
    assert [r["n_hit"] for r in winnowing.decontaminate(d, b).collect()] == [2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aZ é9!\n", max_size=40), min_size=1, max_size=5))
def test_words_and_their_hashes(texts):
    found = winnowing.winnowed([t.encode() for t in texts], [1], None)
    got = [(n, [w.decode() for _, _, _, w in ws]) for n, ws in found]
    assert got == [(len(words_of(t)), words_of(t)) for t in texts]
    _, _, hashes = winnowing.word_spans("\n".join(texts).encode())
    words = words_of("\n".join(texts))
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def test_equal_windows_have_equal_fingerprints():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for span in (1, 2, 3, 7, 10):
        whole = winnowing.fingerprints(words, span)
        assert all(winnowing.fingerprints(words[i:i + span], span)[0] == whole[i] for i in range(200 - span + 1))


# -- conversation trie --------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha(f"{len(role)}:{role}:{text}")
            own[c].append(((turn is not None, turn or 0, role, digest[:32]), role, text))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == len(p))) for p, cs in members.items()}
    return Counter((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], sha(ends[p]))
                   for p, cs in members.items())


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("id", F.lit(1)).withColumn("key", F.lit("k"))
    return Counter(tuple(r) for r in conversation_trie.conversation_trie(df).collect())


def test_trie_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 40), 100, 101, 117, 199, 205, 206, 300, 301]:
        if c == 200:
            continue
        first = rng.choice(["hello", "hi"])
        rows += [(c, t, rng.choice(["user", "assistant"]), first if t == 0 else rng.choice(["yes", "no", "é" * t]))
                 for t in range(rng.choice([1, 2, 4, 7]))]
    rows += [(7, None, "user", "first of all"), (7, 2, None, None), (7, 2, None, None), (8, 0, "user", ""), (None, 0, "user", "lost")]
    # One conversation holds most rows: it is spread over partitions.
    rows += [(150, t, "user", f"turn {t % 5}") for t in range(900)]
    rng.shuffle(rows)
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_whose_root_has_turnless_members(spark):
    short = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 >= 2]      # conversation 0 is missing
    rows = [(c, t, "user", "x") for c in short for t in range(2)]
    got = trie_of(spark, rows)
    assert got == brute_trie(rows) and len(got) == 1
    assert trie_of(spark, []) == Counter()


def test_subtree_totals_on_any_tree(spark):
    rng = random.Random(2)
    shapes = [[(i, None if i == 0 else i - 1) for i in range(300)],                     # a chain
              [(i, None if i == 0 else 0) for i in range(200)],                         # a star
              [(i, None if i % 97 == 0 else rng.randrange(i - i % 97, i)) for i in range(400)]]   # several trees
    for edges in shapes:
        weight = {i: rng.randint(0, 9) for i, _ in edges}
        total, kids = Counter(weight), Counter(p for _, p in edges if p is not None)
        for i, p in reversed(edges):
            if p is not None:
                total[p] += total[i]
        df = spark.createDataFrame([(i, p, weight[i]) for i, p in edges], "id bigint, parent bigint, w bigint")
        got = conversation_trie.subtree_totals(df, {"w": F.col("w")}).collect()
        assert {(r["id"], r["n_children"], r["w"]) for r in got} == {(i, kids[i], total[i]) for i, _ in edges}
        assert len(got) == len(edges)


# -- periodic runs -------------------------------------------------------------------

def brute_runs(words, least=12):
    """All maximal stretches per period, smaller periods first."""
    codes = np.unique(np.array([w.hex() for w in words] or [""]), return_inverse=True)[1][:len(words)]
    n, out = len(codes), {}
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + q >= max(least, 2 * q):
                out.setdefault((a, b + q), q)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab c"), max_size=50), max_size=3), st.integers(1, 7), st.integers(0, 40))
def test_runs_of_any_words(texts, period, length):
    texts = [[w.encode() for w in t] for t in texts]
    texts = [t + (t[-period:] * (length + 1))[:length] + t[:3] for t in texts]
    assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]


def test_long_texts_of_one_word_or_line():
    line = b"all rights of this page are with its maker".split()
    assert periodic_runs.runs_of([[b"a"] * 30000, line * 2000 + [b"end"], line]) == [
        [(0, 30000, 1)], [(0, 2000 * len(line), len(line))], []]
    rng = random.Random(1)
    parted = [w for _ in range(300) for w in [*line, b"%d" % rng.randrange(4)]]
    assert periodic_runs.runs_of([parted]) == [brute_runs(parted)]


def whole_row(doc_id, text):
    words = periodic_runs.repeated_tail((text or "").encode().split(), None if doc_id is None else str(doc_id))
    found = brute_runs(words)
    out = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), hashlib.sha256(b" ".join(out)).hexdigest())


def test_runs_query_on_the_whole_table(spark, documents):
    df = QUERIES["op13_maximal_pairs"](spark, SF)
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r) for r in df.collect()}
    assert len(got) == len(documents)
    rewritten = [i for i, _ in documents if zlib.crc32(str(i).encode()) % 10 == 0]
    chosen = set(rewritten) | {i for i, t in documents if len(t or "") < 4000}
    for i, text in documents:
        if i in chosen:
            assert got[i] == whole_row(i, text)
    assert sum(got[i][1] > 0 for i in rewritten) > len(rewritten) / 2        # a tail may be too short for a run


def test_repeated_tail_follows_its_definition():
    for i in range(300):
        words = [b"%d" % k for k in range(i % 40)]
        h = zlib.crc32(str(i).encode())
        got = periodic_runs.repeated_tail(words, str(i))
        if h % 10 or not words:
            assert got == words
            continue
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        assert got == [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_runs_edges(spark):
    texts = [None, "", " \t ", "one", "a " * 12, "a " * 11, "x\xa0y " * 20, "Ünïcode 日本 " * 9 + "end", "same " * 30, "same " * 30]
    rows = [(i if i != 3 else None, t, "n", i) for i, t in enumerate(texts)] + [(2 ** 53 + 1, "b c " * 8, "n", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, _id int")
    got = periodic_runs.find_runs(df).collect()
    assert Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got) == Counter(
        (i, len((t or "").encode().split()), tuple(brute_runs((t or "").encode().split())),
         {4: "a", 6: "x\xa0y", 7: "Ünïcode 日本 end", 8: "same", 9: "same", 2 ** 53 + 1: "b c"}.get(i, " ".join((t or "").split(" ")).strip() if i != 2 else ""))
        for i, t, _, _ in rows)
    digests = periodic_runs.find_runs(df, digests_only=True)
    assert Counter(tuple(r) for r in digests.drop("n_words").collect()) == Counter(
        (i, *whole_row(None, t)[1:]) for i, t, _, _ in rows)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
