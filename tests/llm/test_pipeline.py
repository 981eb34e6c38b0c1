"""Every stage of the pipeline against brute force on its own input."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pagewright.llm import credentials, ngram_join

from test_near import brute
from test_texts import base_secrets, check_packed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        out.append(rows.collect())
        if name != "packing":
            assert tuple(rows.columns) == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_quality_keeps_whole_rows_and_drops_bad_ones(spark, outputs):
    before = {r["doc_id"]: r for r in outputs[0]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in outputs[1]}
    assert all(r == before[r["doc_id"]] for r in outputs[1])
    assert all(i in kept for i, y in labels.items() if y == 1)
    assert sum(i in kept for i, y in labels.items() if y == 0) <= 0.2 * sum(y == 0 for y in labels.values())


def test_one_of_each_group_stays(outputs):
    told = brute([(r["doc_id"], r["text"]) for r in outputs[1]])
    assert sorted(r["doc_id"] for r in outputs[2]) == sorted({c for _, c, _, _ in told})


def test_secrets_are_masked_and_nothing_else(outputs):
    after = {r["doc_id"]: r for r in outputs[3]}
    assert len(after) == len(outputs[2])
    for r in outputs[2]:
        masked = after[r["doc_id"]]
        assert masked["n_chars"] == len(masked["text"])
        if not base_secrets(r["text"]):
            assert masked["text"] == r["text"]
        elif masked["text"] != r["text"]:
            pieces = [re.escape(p) for p in masked["text"].split("[SECRET]")]
            assert re.fullmatch(".*".join(pieces), r["text"], re.S)


def test_packing_holds_every_document(outputs):
    used, least = check_packed(outputs[4], [(r["doc_id"], r["text"]) for r in outputs[3]], 4096)
    assert used <= least + 1


def test_run_gives_the_stages_rows(spark, outputs):
    got = {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in outputs[4]}


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    good = "The river ran past the old mill and the people of the town came down to see it in the evening light. " * 3
    rows = [(1, good, "en", "s1", 5), (2, good, "en", "s2", 5), (2, good, "en", "s2", 5), (None, good + "And more.", None, None, None),
            (4, None, "en", "s1", None), (5, "", "en", "s1", 0), (6, "password = hunter2secret99 and nothing else here", "en", "s1", 3)]
    extra = ("_row", "_hash", "_found", "_owner", "_repo", "secrets", "_gid", "_gth", "u0", "_n", "score", "_text")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, clashing = (sorted(map(str, stage(spark, d, SF).collect())) for d in (docs, wide))
        assert plain == clashing, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert tuple(stage(spark, wide, SF).columns) == corpus_pipeline.COLUMNS
    assert corpus_pipeline.pack(spark, wide, SF).select("doc_id").distinct().count() == 6
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
    kept = ngram_join.keep_one_of_each(wide)
    assert kept.columns == wide.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 4, 5, 6]
    masked = credentials.redact_secrets(wide)
    assert masked.columns == wide.columns and masked.count() == len(rows)
    got = {r["doc_id"]: r for r in masked.collect()}
    assert got[6]["text"] == "password = hunter2secret99 and nothing else here".replace("password = hunter2secret99", "[SECRET]")
    assert got[4]["text"] is None and [got[1][c] for c in extra] == list(range(len(extra)))
