"""Document quality from a linear-chain conditional random field over lines.

Every line of a text has features of its own characters and words and those of
the lines beside it.  A two-label chain (bad, good) gives each line its
forward-backward marginal; marginals weighted by line length make the
document's share of good text, and a fitted logistic curve turns that share
into a probability.  Labels are known per document only: a line's label in the fit is
its document's, unless a line classifier learned from all documents clearly says
otherwise (see ``line_labels``).  So labels change inside documents and the chain
learns where they do.
"""

from __future__ import annotations

from itertools import accumulate
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .bpe import bounded

FIT_DOCS = 2500         # labelled documents in the fit, at most
FIT_LINES = 400_000     # lines of all of them, at most (whole documents, in hash order)
KEPT = 0.75             # of a document's lines keep its label in the fit, at least
MARGIN = 2.0            # log-odds against its document's label from which a line changes it
THRESHOLD = 0.7
CLASSES = 8             # upper, lower, digit, space, stop marks, exclamation, symbols, other
OWN = 17                # features of a line by itself


def character_classes() -> np.ndarray:
    """Class of each code point below 0x250; the last entry stands for the rest."""
    table = np.full(0x251, 7, dtype=np.uint8)
    for c in range(0x250):
        ch = chr(c)
        table[c] = (0 if ch.isupper() else 1 if ch.isalpha() else 2 if ch.isdigit() else 3 if ch.isspace()
                    else 4 if ch in ".,;:'\"?-()" else 5 if ch == "!" else 6 if ch.isprintable() else 7)
    table[0x250] = 1
    return table


TABLE = character_classes()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x OWN), characters per line and lines per text.

    An empty text is one empty line.
    """
    split = [t.split("\n") for t in texts]
    per_text = np.array([len(s) for s in split], dtype=np.int64)
    lines = [line for s in split for line in s]
    size = np.array([len(line) for line in lines], dtype=np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = TABLE[np.minimum(points, 0x250)].astype(np.int64)
    where = np.repeat(np.arange(len(lines)) * CLASSES, size)
    counts = np.bincount(where + kinds, minlength=len(lines) * CLASSES).reshape(-1, CLASSES)
    words, distinct, repeated = [], [], []
    for s in split:
        seen = set()
        for line in s:
            own = line.split()
            words.append(len(own))
            distinct.append(len(set(own)))
            repeated.append(line in seen)
            seen.add(line)
    n = np.maximum(size, 1)
    words, distinct = np.array(words, dtype=np.float64), np.array(distinct, dtype=np.float64)
    share = counts / n[:, None]
    # Distinct words fall with length by themselves; compare with a usual curve.
    usual = np.maximum(words, 1) ** 0.92
    variety = distinct / np.maximum(usual, 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    out = np.column_stack([
        np.log1p(size) / 8, share, variety, np.minimum(words / n * 6, 3), np.array(repeated, dtype=np.float64),
        counts[:, 0] / letters > 0.5, share[:, 6] > 0.04, share[:, 5] > 0.04, (variety < 0.5) & (words > 6), size == 0])
    return out.astype(np.float64), size, per_text


def with_neighbours(own: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same text, and edge flags."""
    n = len(own)
    ends = np.cumsum(per_text)
    first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    first[ends - per_text] = True
    last[ends - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last, np.ones(n)])


def chain(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray):
    """Marginals of the good label, summed edge marginals and log partition of
    padded chains: emit (documents, lines, 2), move (2, 2)."""
    docs, steps, _ = emit.shape
    fore, back = np.zeros_like(emit), np.zeros_like(emit)
    fore[:, 0] = emit[:, 0]
    for t in range(1, steps):
        fore[:, t] = emit[:, t] + np.logaddexp(fore[:, t - 1, :1] + move[0], fore[:, t - 1, 1:] + move[1])
    for t in range(steps - 2, -1, -1):
        follow = emit[:, t + 1] + back[:, t + 1]
        value = np.stack([np.logaddexp(move[0, 0] + follow[:, 0], move[0, 1] + follow[:, 1]),
                          np.logaddexp(move[1, 0] + follow[:, 0], move[1, 1] + follow[:, 1])], axis=1)
        back[:, t] = np.where((t + 1 < lengths)[:, None], value, 0)
    final = fore[np.arange(docs), lengths - 1]
    z = np.logaddexp(final[:, 0], final[:, 1])
    good = np.exp(fore[:, :, 1] + back[:, :, 1] - z[:, None])
    edges = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            pair = np.exp(fore[:, :-1, a] + move[a, b] + emit[:, 1:, b] + back[:, 1:, b] - z[:, None])
            edges[a, b] = np.where(np.arange(1, steps)[None, :] < lengths[:, None], pair, 0).sum()
    return good, edges, z


class LineModel:
    """Weights of the field and of the curve from good share to probability."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.move, self.slope, self.shift = weights, move, slope, shift

    def good_share(self, own: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' good marginals, per text."""
        emission = with_neighbours(own, per_text) @ self.weights        # good against bad
        starts = np.cumsum(per_text) - per_text
        out = np.zeros(len(per_text))
        bucket = np.ceil(np.log2(np.maximum(per_text, 1))).astype(int)
        for b in np.unique(bucket):
            docs = np.flatnonzero(bucket == b)
            steps = int(per_text[docs].max())
            for at in range(0, len(docs), max(1, (1 << 18) // steps)):
                part = docs[at:at + max(1, (1 << 18) // steps)]
                index = np.minimum(starts[part, None] + np.arange(steps), len(emission) - 1)
                inside = np.arange(steps) < per_text[part, None]
                emit = np.zeros((len(part), steps, 2))
                emit[:, :, 1] = np.where(inside, emission[index], 0)
                good, _, _ = chain(emit, per_text[part], self.move)
                weight = np.where(inside, size[index] + 1.0, 0)
                out[part] = (good * weight).sum(axis=1) / weight.sum(axis=1)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        share = np.clip(self.good_share(*line_features(texts)), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(share / (1 - share)) + self.shift, -40, 40)))


def line_labels(x: np.ndarray, per_text: np.ndarray, label: np.ndarray, rounds: int = 60, rate: float = 0.2) -> np.ndarray:
    """0 or 1 per line: the document's label, but for lines that a logistic line classifier
    holds to be of the other kind by ``MARGIN``.  The ``KEPT`` share of a document's lines
    that are most like its label keep it; so do all lines of a document most of whose lines
    do not show its label by themselves (what makes it good or bad lies between lines)."""
    truth, weight = np.repeat(label, per_text), np.repeat(1.0 / per_text, per_text) / len(per_text)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, rounds + 1):
        g = x.T @ ((1 / (1 + np.exp(-np.clip(x @ w, -40, 40))) - truth) * weight) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    alike = np.where(truth == 1, x @ w, -(x @ w))       # with the document's label
    owner = np.repeat(np.arange(len(per_text)), per_text)
    order = np.lexsort((-alike, owner))
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.arange(len(x)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    agree = np.bincount(owner, weights=alike > 0, minlength=len(per_text)) / np.maximum(per_text, 1)
    own = (alike > -MARGIN) | (place < np.ceil(KEPT * per_text)[owner]) | (agree < KEPT)[owner]
    return np.where(own, truth, 1 - truth)


def fit_lines(own: np.ndarray, size: np.ndarray, per_text: np.ndarray, label: np.ndarray, rounds: int = 80,
              rate: float = 0.1, ridge: float = 1e-3) -> LineModel:
    """Maximum likelihood by Adam, then the curve from share to probability."""
    x = with_neighbours(own, per_text)
    starts = np.cumsum(per_text) - per_text
    lines_of = line_labels(x, per_text, label)
    batches = []                    # texts with about as many lines, padded to the longest
    order = np.argsort(per_text, kind="stable")
    for docs in np.array_split(order, 8):
        if len(docs):
            steps = int(per_text[docs].max())
            inside = np.arange(steps) < per_text[docs, None]
            index = np.minimum(starts[docs, None] + np.arange(steps), len(x) - 1)
            batches.append((index, inside, per_text[docs], lines_of[index]))
    owner = np.repeat(np.arange(len(per_text)), per_text)
    beside = owner[1:] == owner[:-1]
    pairs = np.bincount((2 * lines_of[:-1] + lines_of[1:])[beside].astype(np.int64), minlength=4).reshape(2, 2).astype(np.float64)
    p = [np.zeros(x.shape[1]), np.zeros((2, 2))]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    lines = len(x)
    for step in range(1, rounds + 1):
        emission, miss, edges = x @ p[0], np.zeros(lines), np.zeros((2, 2))
        for index, inside, held, truth in batches:
            emit = np.zeros((*inside.shape, 2))
            emit[:, :, 1] = np.where(inside, emission[index], 0)
            good, own_edges, _ = chain(emit, held, p[1])
            miss[index[inside]] = (good - truth)[inside]
            edges += own_edges
        for j, g in enumerate((x.T @ miss / lines + ridge * p[0], (edges - pairs) / lines + ridge * p[1])):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            p[j] = p[j] - rate * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.999 ** step)) + 1e-8)
    model = LineModel(p[0], p[1])
    share = np.clip(model.good_share(own, size, per_text), 1e-6, 1 - 1e-6)
    z = np.column_stack([np.log(share / (1 - share)), np.ones(len(share))])
    w = np.array([1.0, 0.0])
    for _ in range(30):             # Newton on the two-parameter logistic
        q = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        hessian = (z * (q * (1 - q))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, z.T @ (q - label) + 1e-3 * (w - np.array([1.0, 0.0])))
    model.slope, model.shift = max(float(w[0]), 1e-3), float(w[1])
    return model


def held_out(key: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_lines_at_most: int = FIT_LINES) -> LineModel:
    """Fit on a sample of labelled documents that are not held out: those with the smallest
    hashes, at most ``fit_docs`` and at most ``fit_lines_at_most`` lines in all, each whole.

    Rows with a null id or label are not learned from; of rows that repeat an id one
    is (that of the smallest text hash); without labels of both kinds the model calls
    everything good.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
             .groupBy(id_col).agg(F.min(label_col).alias("label"))
             .orderBy(F.xxhash64(id_col), id_col).limit(fit_docs))           # at most fit_docs rows: broadcast

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own, size, per_text = line_features(f["_text"].tolist())
            ends = np.cumsum(per_text)
            yield pd.DataFrame({"at": f["at"], "label": f["label"].astype("float64"), "lines": per_text,
                                "own": [own[e - n:e].ravel() for e, n in zip(ends, per_text)],
                                "size": [size[e - n:e] for e, n in zip(ends, per_text)]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    one = (texts.join(F.broadcast(known), F.col("_id") == F.col(id_col))
           .groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.first("label").alias("label"))
           .withColumn("at", F.xxhash64("_id")))
    made = materialize(one.select("at", "_text", "label").mapInPandas(
        run, "at bigint, label double, lines bigint, own array<double>, size array<bigint>"), "labelled")
    sizes = made.select("at", "lines").orderBy("at").collect()              # fit_docs rows at most
    upto = [r["at"] for r, total in zip(sizes, accumulate(r["lines"] for r in sizes)) if total <= fit_lines_at_most]
    held = made.where(F.col("at") <= upto[-1]).orderBy("at").collect() if upto else []
    label = np.array([r["label"] for r in held])
    if len(set(label.tolist())) < 2:
        width = 3 * OWN + 3
        return LineModel(np.zeros(width), np.zeros((2, 2)), 1.0, 4.0)
    per_text = np.array([len(r["size"]) for r in held], dtype=np.int64)
    own = np.concatenate([np.array(r["own"]).reshape(-1, OWN) for r in held])
    return fit_lines(own, np.concatenate([np.array(r["size"]) for r in held]), per_text, label)


def score_quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability that the document is good.

    Null and empty texts are one empty line; every row is scored on its whole
    text and repeated rows stay; all columns stay, except that one already
    called ``score`` is replaced; an empty table gives no rows.
    """
    kept = [f for f in docs.schema.fields if f.name != "score"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t or "" for t in f[text_col]]
            f["score"] = np.concatenate([model.score(part) for part in bounded(texts)]) if texts else np.zeros(0)
            yield f

    given = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return given.mapInPandas(run, f"{fields}, score double")
