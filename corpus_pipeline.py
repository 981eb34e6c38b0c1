"""Corpus pipeline: quality, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame over all rows
that its predecessor kept; all but the last return the columns of
``documents``.  Quality drops rejected documents, the n-gram join leaves one
document of each group of near copies, the secret scan masks secrets inside
texts, and packing places every document that is left in sequences.

Stages read the columns of ``documents`` by name; other columns, whatever they are
called, go.  An empty table passes through all stages as an empty one.  Stages set
the session's Arrow batch to ``ARROW_ROWS`` rows and leave it so: their results are
lazy, and the setting must hold when they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import credentials, ngram_join, packing, quality
from pagewright.llm.queries import tokenizer_file
from pagewright.session import ensure_checkpoint_dir, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Rows of an Arrow batch: whole texts are long, and a worker holds a batch several times over.
ARROW_ROWS = 2000
# A learned model and packing have no SQL form; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, whole rows.

    A null or empty text is scored as one empty line and stays or goes by that; repeated
    rows stay or go together; without labels of both kinds all stay."""
    short_batches(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model)
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near copies, whole rows: the least id (nulls last),
    then text hash.

    Texts without words, null ones among them, all stay; rows that repeat id and text stay once."""
    short_batches(spark)
    return ngram_join.keep_one_of_each(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret that is not a widely copied example replaced by a mark;
    ``n_chars`` is the new length (null for a null text).

    Null and empty texts stay as they are, and so do repeated rows; a null source or language
    counts as no owner or repository."""
    short_batches(spark)
    masked = credentials.redact_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of 4096 tokens, one row per piece (see ``packing.pack_documents``).

    A null text is packed as an empty one (the end id alone); repeated rows are packed each."""
    short_batches(spark)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json").decode())


STAGES = [("quality", keep_good), ("ngram_join", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
