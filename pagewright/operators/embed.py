"""Vectors for pages: selection, request batches, embedders, attach."""

from __future__ import annotations

import hashlib
from typing import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions import in_page_range, needs_embedding, non_empty, squash_ws, truncate_tokens
from ..session import materialize, work_dir
from .ids import assign_batches


def embeddable(inodes: DataFrame):
    """Split inodes into (ok, rejected): an errored inode is never embedded."""
    return inodes.where(F.col("error").isNull()), inodes.where(F.col("error").isNotNull())


def embed_selection(inodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages to embed: in ``[from_page, to_page)``, no vector yet, non-empty,
    under an inode without error.  Inodes carry one row per id, so the join
    adds no rows; AQE splits a document with very many pages."""
    ino = inodes.select(F.col("id").alias("inode_id"), "from_page", "to_page", "error")
    return (pages.join(ino, "inode_id")
            .where(in_page_range("index", "from_page", "to_page")
                   & needs_embedding("embedding") & non_empty("contents")
                   & F.col("error").isNull())
            .select(pages.columns))


def truncate_pages(pages: DataFrame, make_tokenizer: Callable, n: int = schemas.MAX_TOKENS, text_col: str = "contents") -> DataFrame:
    """``text`` (squashed) cut to its first ``n`` tokens of a supplied tokenizer, and
    ``n_tokens`` kept.  ``make_tokenizer()`` returns an object with ``encode(text) -> list``
    and ``decode(list) -> text``; it is called once per task, not per page.

    A tokenizer may give back a part of a character at the cut (byte-level ones do); what
    does not decode to a prefix of the text loses its last token until it does.  Null text
    counts as empty."""
    def run(frames):
        tokenizer = make_tokenizer()
        for texts in frames:
            kept, counts = [], []
            for text in texts:
                text = text or ""
                ids = list(tokenizer.encode(text))
                cut, out = len(ids), text
                if len(ids) > n:
                    cut, out = n, tokenizer.decode(ids[:n])
                    while cut and not text.startswith(out):
                        cut -= 1
                        out = tokenizer.decode(ids[:cut])
                kept.append(out)
                counts.append(cut)
            yield pd.DataFrame({"text": kept, "n_tokens": counts})

    made = F.pandas_udf(run, "text string, n_tokens int", functionType=F.PandasUDFType.SCALAR_ITER)
    return pages.withColumn("_cut", made(squash_ws(text_col))).withColumn("text", F.col("_cut.text")).withColumn("n_tokens", F.col("_cut.n_tokens")).drop("_cut")


def embed_input(pages: DataFrame, max_tokens: int = schemas.MAX_TOKENS) -> DataFrame:
    """Text sent to the model: whitespace squashed, cut to ``max_tokens``."""
    return pages.withColumn("text", truncate_tokens(squash_ws("contents"), max_tokens))


# -- the default test embedder -------------------------------------------------
# Hashed bag of words: each lower-cased whitespace token adds +1 or -1 to one
# of ``dim`` buckets, chosen by its md5; the vector is then L2-normalised.
# The same numbers come out of the native form and the Python form.

def hashed_embeddings(df: DataFrame, id_col: str = "id", text_col: str = "text",
                      dim: int = 64) -> DataFrame:
    """Native form: (id, embedding array<float>) for every row of ``df``."""
    toks = (df.select(F.col(id_col).alias("_id"),
                      F.explode(F.split(F.lower(squash_ws(text_col)), " ")).alias("tok"))
            .where(F.col("tok") != "")
            .withColumn("_h", F.md5(F.col("tok")))
            .select("_id",
                    (F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") % dim).cast("int").alias("b"),
                    F.when(F.substring("_h", 9, 1).isin("0", "1", "2", "3", "4", "5", "6", "7"), 1)
                    .otherwise(-1).alias("s")))
    cells = toks.groupBy("_id", "b").agg(F.sum("s").cast("double").alias("v"))
    per_doc = cells.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    norm = F.sqrt(F.aggregate(F.col("_d"), F.lit(0.0), lambda acc, x: acc + x * x))
    vec = F.transform(F.col("_d"), lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))
    out = per_doc.select(F.col("_id").alias(id_col), dense.alias("_d")).select(id_col, vec.alias("embedding"))
    # Rows without any token get the zero vector.
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (df.select(id_col).join(out, id_col, "left")
            .select(id_col, F.coalesce(F.col("embedding"), zero).alias("embedding")))


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Python form of the same embedder, for :func:`embed_pages`."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for tok in " ".join((text or "").split()).lower().split(" "):
                if not tok:
                    continue
                h = hashlib.md5(tok.encode("utf-8")).hexdigest()
                v[int(h[:8], 16) % dim] += 1 if h[8] in "01234567" else -1
            n = np.sqrt((v * v).sum())
            out.append(list((v / n if n > 0 else v).astype(np.float32)))
        return out
    return embed


def whole_requests(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    """The same rows, cut so that no (inode_id, batch) is split over two frames."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(pdf):
            last = (pdf["inode_id"] == pdf["inode_id"].iloc[-1]) & (pdf["batch"] == pdf["batch"].iloc[-1])
            held = pdf[last].reset_index(drop=True)
            yield pdf[~last].reset_index(drop=True)
    if held is not None:
        yield held


def embed_pages(pages: DataFrame, embedder: Callable[[list[str]], list[list[float]]],
                batch: int = schemas.EMBED_BATCH, text_col: str = "text") -> DataFrame:
    """Call ``embedder`` on requests of at most ``batch`` texts.

    Input rows carry ``id``, ``inode_id``, ``batch`` (see
    :func:`request_batches`) and ``text``.  Rows are clustered by
    (inode_id, batch), so one request never spans documents.  Output:
    (id, inode_id, embedding, status); a failed request gives NULL vectors
    with status 'failed'.  The call may be retried by Spark, so the embedder
    must be idempotent; its reply count must equal the request count.
    """
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("inode_id", T.LongType()),
        T.StructField("embedding", schemas.VECTOR), T.StructField("status", T.StringType()),
    ])

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in whole_requests(batches):
            if pdf.empty:
                continue
            vecs, status = [None] * len(pdf), ["ok"] * len(pdf)
            for _, grp in pdf.groupby(["inode_id", "batch"], sort=False):
                rows = list(grp.index)
                for start in range(0, len(rows), batch):
                    part = rows[start:start + batch]
                    try:
                        reply = embedder([pdf.at[r, text_col] for r in part])
                        if len(reply) != len(part):
                            raise ValueError("reply count differs from request count")
                        for r, v in zip(part, reply):
                            vecs[pdf.index.get_loc(r)] = [float(x) for x in v]
                    except Exception:
                        for r in part:
                            status[pdf.index.get_loc(r)] = "failed"
            yield pd.DataFrame({"id": pdf["id"].values, "inode_id": pdf["inode_id"].values,
                                "embedding": vecs, "status": status})

    # Hash on (inode_id, batch): a document with very many pages spreads over
    # tasks, and each request's rows stay together.
    clustered = pages.repartition("inode_id", "batch").sortWithinPartitions("inode_id", "batch", "index")
    return clustered.select("id", "inode_id", "batch", "index", text_col).mapInPandas(run, schema)


def embed_stored(pages: DataFrame, embedder: Callable[[list[str]], list[list[float]]], store: str,
                 batch: int = schemas.EMBED_BATCH, per_commit: int = 4096) -> DataFrame:
    """Like :func:`embed_pages` over ``pages`` (id, inode_id, index, text), with the
    replies kept in the folder ``store``: (id, inode_id, embedding, status, run).

    Requests are sent ``per_commit`` at a time, each time one write that is whole or not
    there; a run that breaks off loses at most that many.  A later run (``run``
    counts from 0) sends only pages without a vector for their present text, so what
    was stored is never asked for again and only failed requests are repeated."""
    spark = pages.sparkSession
    asked = pages.select("id", "inode_id", "index", "text").withColumn("text_md5", F.md5("text"))
    held = stored_vectors(spark, store)
    last = held.agg(F.max("run")).first()[0]
    run = 0 if last is None else last + 1
    good = held.where(F.col("status") == "ok").select("id", "text_md5")
    todo = request_batches(asked.join(good, ["id", "text_md5"], "left_anti"), batch)
    todo = materialize(todo.select("id", "inode_id", "index", "text", "batch", "text_md5"), "requests")
    requests = todo.select("inode_id", "batch").distinct().count()
    commits = -(-requests // per_commit)
    if commits > 1:     # written by commit, so that each reads its own requests only
        path = work_dir(spark, "commits")
        (todo.withColumn("at", F.pmod(F.xxhash64("inode_id", "batch"), F.lit(commits)).cast("int"))
         .repartition("at").write.partitionBy("at").parquet(path))
        todo = spark.read.parquet(path)
    else:
        todo = todo.withColumn("at", F.lit(0))
    for at in range(commits):
        part = todo.where(F.col("at") == at).drop("at")
        replies = embed_pages(part, embedder, batch).join(part.select("id", "text_md5"), "id")
        replies.write.mode("overwrite").parquet(f"{store.rstrip('/')}/run={run}/commit={at}")
    # A page's newest reply for its present text: the vector, once there is one.
    mine = stored_vectors(spark, store).join(asked.select("id", "text_md5"), ["id", "text_md5"], "left_semi")
    newest = F.max_by(F.struct("inode_id", "embedding", "status", "run"), F.struct(F.col("status") == "ok", "run"))
    return mine.groupBy("id").agg(newest.alias("_r")).select("id", "_r.*")


def stored_vectors(spark: SparkSession, store: str) -> DataFrame:
    """All replies that ``store`` holds; none if there is no such folder yet."""
    schema = "id bigint, inode_id bigint, embedding array<float>, status string, text_md5 string, run int, commit int"
    try:
        return spark.read.schema(schema).parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def request_batches(selection: DataFrame, size: int = schemas.EMBED_BATCH) -> DataFrame:
    """Per document, in page order, requests of at most ``size`` pages."""
    return assign_batches(selection, key="inode_id", order="index", size=size)


def attach_embeddings(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Put vectors on pages by page id (never by position); a page that has
    a vector keeps it."""
    v = vectors.select(F.col("id"), F.col("embedding").alias("_v"))
    return (pages.join(v, "id", "left")
            .withColumn("embedding", F.coalesce(F.col("embedding"), F.col("_v")))
            .drop("_v"))
