"""N-gram Jaccard self-join: MinHash bands find candidates, full n-gram sets decide.

1. Every text becomes its set of hashed word n-grams; equal sets make a class
   (exact copies are one class), and only class representatives go on.
2. Classes are grouped by band hashes.  Buckets with the same members in
   several bands are kept once.  Only classes in some bucket have their texts
   read again for the full sets.
3. Buckets are cut into cells of two bounded blocks, so a bucket of any size
   is many tasks.  A cell intersects full sets by matrix products and tells,
   per class, how many documents it is linked to, and a tree of linked classes
   for the connected groups; pairs are counted in their first common bucket
   and are never written out.
"""

from __future__ import annotations

import hashlib
import math
import sys
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .bpe import bounded

N = 5
SIMILARITY = 0.8
ROWS = 5                # MinHash values per band
RECALL = 0.9999         # wanted chance that a pair at the threshold shares a band
BLOCK = 256             # classes of a bucket in one block; a cell holds two blocks
CHUNK = 4096            # n-grams in one matrix product
KNOWN_WORDS = 150_000   # remembered word hashes per Python worker
BROADCAST_KEYS = 500_000    # (id, text hash) pairs that may be broadcast: some 32 MB
SEED = 0x9E3779B97F4A7C15


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Fewest bands with which a pair at ``similarity`` shares one with chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash
    known = sys.__dict__.setdefault("_ngram_word_hashes", {})
    if len(known) > KNOWN_WORDS:
        known.clear()
    digest = xxhash.xxh64_intdigest
    for w in set(words).difference(known):
        known[w] = digest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def ngram_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams.

    Words are what stands between white space.  A text of fewer than n words
    is one n-gram of all its words; a text without words has none.
    """
    split = [t.split() for t in texts]
    hashes = word_hashes([w for ws in split for w in ws])
    out, at = [], 0
    for ws in split:
        h = hashes[at:at + len(ws)]
        at += len(ws)
        if not len(h):
            out.append(h)
            continue
        width = min(n, len(h))
        grams = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for j in range(width):
            grams = grams * np.uint64(SEED) + h[j:len(h) - width + 1 + j]
        out.append(np.unique(mixed(grams + np.uint64(width))))
    return out


def fingerprint(grams: np.ndarray) -> str | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest() if len(grams) else None


class Bands:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, bands) of int64; sets must not be empty."""
        out = np.empty((len(sets), self.bands), dtype=np.int64)
        at = 0
        while at < len(sets):           # about 64k n-grams at a time stay in the processor's cache
            end, held = at + 1, len(sets[at])
            while end < len(sets) and held + len(sets[end]) <= 1 << 16:
                held += len(sets[end])
                end += 1
            part = np.concatenate(sets[at:end])
            starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
            for b in range(self.bands):
                h = np.full(end - at, b + 1, dtype=np.uint64)
                for k in range(b * self.rows, (b + 1) * self.rows):
                    low = np.minimum.reduceat((part * self.times[k] + self.plus[k]) >> np.uint64(20), starts)
                    h = mixed(h * np.uint64(SEED) + low)
                out[at:end, b] = h.view(np.int64)
            at = end
        return out


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` (rows) and ``right`` (columns)."""
    if len(left) == 1 and len(right) == 1:
        return np.array([[len(np.intersect1d(sets[left[0]], sets[right[0]], assume_unique=True))]], dtype=np.float32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[gram] > 1
    owner, gram = owner[shared], gram[shared]
    _, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int(gram[-1]) + 1 if len(gram) else 0, CHUNK):
        a, b = np.searchsorted(gram, [first, first + CHUNK])
        held = np.zeros((len(sets), CHUNK), dtype=np.float32)
        held[owner[a:b], gram[a:b] - first] = 1
        out += held[left] @ held[right].T
    return out


def cell_links(sets: list[np.ndarray], buckets: np.ndarray, band: int, left: np.ndarray, right: np.ndarray,
               similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked (left, right) indices whose first common bucket is this cell's."""
    size = np.array([len(s) for s in sets], dtype=np.float32)
    common = intersections(sets, left, right)
    linked = common >= similarity * (size[left][:, None] + size[right][None, :] - common) - 1e-6
    if left is right:
        linked &= np.triu(np.ones_like(linked), 1)
    i, j = np.nonzero(linked)
    a, b = left[i], right[j]
    earlier = ((buckets[a, :band] == buckets[b, :band]) & (buckets[a, :band] != 0)).any(axis=1)
    return a[~earlier], b[~earlier]


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: Bands, n: int) -> DataFrame:
    """id, text hash, fingerprint and band hashes of every row."""
    kind = next(f.dataType.simpleString() for f in docs.schema.fields if f.name == id_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [s for part in bounded(f.pop("_text").tolist()) for s in ngram_sets(part, n)]
            f["fp"] = [fingerprint(s) for s in sets]
            filled = [k for k, s in enumerate(sets) if len(s)]
            made = bands([sets[k] for k in filled])
            hashes: list = [None] * len(sets)
            for row, k in enumerate(filled):
                hashes[k] = made[row]
            f["bands"] = hashes
            yield f

    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    return given.mapInPandas(run, f"_id {kind}, _th bigint, fp string, bands array<bigint>")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node connected to each node of ``edges`` (a, b).

    Every round hooks each node to its smallest neighbour, follows the hooks to
    their ends and replaces the edges by those between different ends, so a
    group's edges are gone after a round or two and are not joined again.
    """
    def ordered(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                           .where(F.col("a") != F.col("b")).distinct(), "edges")

    left, total = ordered(edges), None
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = materialize(both.groupBy("a").agg(F.min("b").alias("m"))
                             .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
        moved = True
        while moved:        # pointer jumping: about log(depth) times
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
            nexts = materialize(labels.join(up, "label").select("node", F.col("label").alias("old"), F.col("far").alias("label")), "labels")
            moved = nexts.where(F.col("label") != F.col("old")).limit(1).count() > 0
            labels = nexts.select("node", "label")
        ends = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        total = labels if total is None else materialize(
            total.join(ends, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "total")
        left = ordered(left.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
                       .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
                       .select(F.col("la").alias("a"), F.col("lb").alias("b")))
        if left.limit(1).count() == 0:
            return total


def cut_cells(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys from sorted frames."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        k = f[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(f)]
        for a, b in zip(cuts, cuts[1:]):
            if held and (held[0][keys].to_numpy()[0] != k[a]).any():
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(f.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def small(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast when a count shows that they are few; more
    of them are joined by shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def linked_classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, n: int, rows: int, recall: float,
                   pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, classes (fp, copies, least id), and links of
    classes: (a, b, links) with per-class counts (b null) and tree edges, or
    with ``pairs`` every linked pair of classes instead."""
    n_bands = bands_for(similarity, recall, rows)
    signed = materialize(signatures(docs, id_col, text_col, Bands(n_bands, rows), n), "signatures")
    classes = materialize(signed.where(F.col("fp").isNotNull()).groupBy("fp").agg(
        F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("_id", "_th"), F.struct(F.col("_id").isNull(), "_id", "_th")).alias("rep"), F.min("_id").alias("least"),
        F.first("bands").alias("bands")), "classes")
    each = classes.select("fp", F.posexplode("bands").alias("band", "bucket"))
    whole = (each.groupBy("band", "bucket")
             .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"))
             .where(F.col("n") > 1))
    kept = (whole.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("k"))
            .select(F.col("k.band").alias("band"), F.col("k.bucket").alias("bucket"), "n"))
    held = (each.join(kept, ["band", "bucket"])
            .groupBy("fp").agg(F.collect_list(F.struct("band", "bucket", "n")).alias("held")))      # one entry per band at most
    wanted = materialize(classes.join(held, "fp").select("fp", "copies", "held", F.col("rep._id").alias("_rep"),
                                                         F.col("rep._th").alias("_rth")), "wanted")

    def full(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = [s for part in bounded(f["_text"].tolist()) for s in ngram_sets(part, n)]
            yield pd.DataFrame({"fp": [fingerprint(s) for s in sets], "grams": [s.view(np.int64) for s in sets]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    keys = wanted.select("_rep", "_rth")
    match = F.col("_id").eqNullSafe(F.col("_rep")) & (F.col("_th") == F.col("_rth"))
    sets = texts.join(small(keys), match, "left_semi").mapInPandas(full, "fp string, grams array<bigint>")
    # A row that is repeated with its id and text comes more than once.
    sets = sets.groupBy("fp").agg(F.first("grams").alias("grams"))
    sets = materialize(sets.join(wanted.select("fp", "copies", "held"), "fp"), "sets")

    blocks = F.ceil(F.col("h.n") / BLOCK).cast("int")
    cells = (sets.select("fp", "copies", "grams", "held", F.explode("held").alias("h"))
             .select("fp", "copies", "grams", F.transform("held", lambda x: x["band"]).alias("at"),
                     F.transform("held", lambda x: x["bucket"]).alias("in"), F.col("h.band").alias("band"),
                     F.col("h.bucket").alias("bucket"), F.pmod(F.xxhash64("fp", "h.band"), blocks).cast("int").alias("own"),
                     F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
             .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other"))
    keys = ["band", "bucket", "low", "high"]

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in cut_cells(frames, keys):
            own, low, high = f["own"].to_numpy(), int(f["low"].iloc[0]), int(f["high"].iloc[0])
            left = np.flatnonzero(own == low)
            right = left if low == high else np.flatnonzero(own == high)
            if len(f) < 2 or not len(left) or not len(right):
                continue
            buckets = np.zeros((len(f), n_bands), dtype=np.int64)
            for i, (at, inside) in enumerate(zip(f["at"], f["in"])):
                buckets[i, at] = inside
            sets = [np.asarray(g, dtype=np.int64).view(np.uint64) for g in f["grams"]]
            a, b = cell_links(sets, buckets, int(f["band"].iloc[0]), left, right, similarity)
            if not len(a):
                continue
            fp, copies = f["fp"].to_numpy(), f["copies"].to_numpy()
            if pairs:
                yield pd.DataFrame({"a": fp[a], "b": fp[b], "links": 1})
                continue
            count = np.zeros(len(f), dtype=np.int64)
            np.add.at(count, a, copies[b])
            np.add.at(count, b, copies[a])
            root = np.arange(len(f))
            while True:         # least index reachable in this cell
                low_root = root.copy()
                np.minimum.at(low_root, a, root[b])
                np.minimum.at(low_root, b, root[a])
                low_root = low_root[low_root]
                if (low_root == root).all():
                    break
                root = low_root
            some = np.flatnonzero(count)
            out = [(fp[i], None, int(count[i])) for i in some]
            for r in np.unique(root[some]):
                group = np.flatnonzero(root == r)
                # A binary tree: no class gets more than three edges from a cell.
                out += [(fp[group[i]], fp[group[(i - 1) // 2]], 0) for i in range(1, len(group))]
            yield pd.DataFrame(out, columns=["a", "b", "links"])

    found = cells.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(links, "a string, b string, links bigint")
    return signed, classes, materialize(found, "links")


def class_groups(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, label) of every class; a class without links is its own group."""
    groups = connected(found.where(F.col("b").isNotNull())).select(F.col("node").alias("fp"), "label")
    return classes.select("fp").join(groups, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                 n: int = N, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """One row per document: id, ``class_id`` (least id of its connected group of
    linked documents), ``copy_id`` (least id of the documents with the same
    n-gram set) and ``n_links`` (how many other documents have n-gram sets of
    Jaccard similarity ``similarity`` or more with its own).

    Null, empty and white texts have no n-grams: no links, and their own id as
    class.  Texts under n words are one n-gram.  Repeated rows and ids each
    count as a document; a null id stays null unless its class has another;
    an empty table gives no rows; other columns are ignored.
    """
    signed, classes, found = linked_classes(docs, id_col, text_col, similarity, n, rows, recall)
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    told = (classes.select("fp", "copies", "least").join(counts, "fp", "left")
            .join(class_groups(classes, found), "fp"))
    least = told.groupBy("label").agg(F.min("least").alias("class_id"))
    told = told.join(least, "label").select("fp", "class_id", F.col("least").alias("copy_id"),
                                            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lone = signed.where(F.col("fp").isNull()).select(F.col("_id").alias(id_col), F.col("_id").alias("class_id"),
                                                     F.col("_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return (signed.where(F.col("fp").isNotNull()).select("_id", "fp").join(told, "fp")
            .select(F.col("_id").alias(id_col), "class_id", "copy_id", "n_links").union(lone))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                     n: int = N, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each connected group: the one of least id
    (nulls last), then text hash.

    Texts without n-grams all stay.  Rows that repeat both id and text are the
    same document and stay once.  All columns stay, whatever their names; an empty
    table gives no rows.
    """
    names = docs.columns
    plain = docs.toDF(*[f"u{i}" for i in range(len(names))])       # no name of the caller's can clash with one of ours
    kept = _one_of_each(plain, f"u{names.index(id_col)}", f"u{names.index(text_col)}", similarity, n, rows, recall)
    return kept.toDF(*names)


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, similarity: float, n: int, rows: int, recall: float) -> DataFrame:
    signed, classes, found = linked_classes(docs, id_col, text_col, similarity, n, rows, recall)
    best = (classes.select("fp", F.struct(F.col("rep._id").isNull().alias("last"), F.col("rep._id").alias("id"), F.col("rep._th").alias("th")).alias("k"))
            .join(class_groups(classes, found), "fp").groupBy("label").agg(F.min("k").alias("k")))
    chosen = best.select(F.col("k.id").alias("_cid"), F.col("k.th").alias("_cth"))
    rows_of = signed.groupBy("_id", "_th").agg(F.count(F.lit(1)).alias("_n"), F.max("fp").alias("_fp"))
    same = F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_th") == F.col("_cth"))
    gone = materialize(rows_of.where(F.col("_fp").isNotNull()).join(chosen, same, "left_anti")
                       .select(F.col("_id").alias("_gid"), F.col("_th").alias("_gth")), "gone")
    twice = materialize(rows_of.where(F.col("_n") > 1).select(F.col("_id").alias("_tid"), F.col("_th").alias("_tth")), "twice")
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = hashed.join(small(gone), hashed[id_col].eqNullSafe(F.col("_gid")) & (F.col("_hash") == F.col("_gth")), "left_anti")
    if twice.limit(1).count():      # rows that repeat id and text: the others need no shuffle
        again = kept[id_col].eqNullSafe(F.col("_tid")) & (F.col("_hash") == F.col("_tth"))
        kept = (kept.join(small(twice), again, "left_anti")
                .unionByName(kept.join(small(twice), again, "left_semi").dropDuplicates([id_col, "_hash"])))
    return kept.drop("_hash")
