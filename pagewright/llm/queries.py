"""Registered queries: one ``opN_<name>`` per operator, over whole tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe, chat, conversation_trie, credentials, exact_topk, learned_partitions, ngram_join, packing, periodic_runs,
               pii, quality, sharding, winnowing)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    """A public vocabulary file, read by the driver and sent with the tasks."""
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query("op1_learned_partitions")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.nearest(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


@query("op3_linear_grouping")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  tokenizer_file("word_bpe_49k.json").decode(), capacity=4096, end_id=1)


# The body is escaped where it holds a control string; a turn adds 15 characters to role and body.
OP4_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(15 + length(url_encode(role)) + length(replace(replace(text, '### ', '\### '), '</turn>', '\</turn>'))) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""


@query("op4_chat_round_trip", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(conflict).alias("text"))
    made = chat.format_conversations(rows.unionByName(extra))
    back = made.withColumn("_turns", chat.parse(F.col("formatted"))).withColumn(
        "_loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    turns_text = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("_turns").cast("long").alias("n_turns"),
                       F.sha2(turns_text, 256).alias("turns_sha256"),
                       F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@query("op5_segment_tree_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"),
                                public_tokenizers.PATTERN, digests_only=True)


@query("op8_prefix_sum_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


OP10_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""


@query("op10_uniform_threshold", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.uniform_threshold_topk(table(spark, sf_dir, "embeddings"), k=5, query_every=50, scale=256)


def joined_spans(items) -> "F.Column":
    """kind:start:end, comma-joined, of an array of structs."""
    return F.concat_ws(",", F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_of(items: str, field: str, value: str) -> "F.Column":
    return F.size(F.filter(items, lambda s: s[field] == value)).cast("long")


@query("op7_ownership_frequency")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(table(spark, sf_dir, "documents"), repo=F.concat_ws("/", "source", "lang"),
                                     owner=F.col("source"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*credentials.BASE_KINDS))
    counts = [count_of("secrets", "kind", k).alias(f"n_{k}") for k in credentials.BASE_KINDS]
    classes = [count_of("secrets", "class", c).alias(f"n_{c}") for c in ("live", "example", "unclear")]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"),
                        joined_spans("secrets").alias("spans"), *classes)


@query("op6_candidate_boosting")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = [count_of("base", "kind", k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    everything = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(joined_spans("base"), 256).alias("base_sha256"),
                        joined_spans(everything).alias("spans"), F.size("added").cast("long").alias("n_added"))


OP2_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS c FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, k = nx.c AND k = ny.c AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 5 * k >= 4 * (nx.c + ny.c - k)),
r(doc_id, d) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.d),
m AS (SELECT doc_id, min(d) AS class_id FROM r GROUP BY doc_id),
t AS (SELECT x, count(*) AS links, min(y) FILTER (WHERE same) AS copy FROM l GROUP BY x)
SELECT m.doc_id, m.class_id, least(m.doc_id, coalesce(t.copy, m.doc_id)) AS copy_id, CAST(coalesce(t.links, 0) AS BIGINT) AS n_links
FROM m LEFT JOIN t ON t.x = m.doc_id"""


@query("op2_ngram_jaccard", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


@query("op9_line_crf")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select(
        "doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


# Words of texts and items; every window of a text that is some item's window.
OP11_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(ws), 10) AS span, array_to_string(list_slice(ws, i, i + 9), ' ') AS words
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
h AS (SELECT doc_id, i, span, words FROM (SELECT doc_id, i, span, array_to_string(list_slice(ws, i, i + span - 1), ' ') AS words
  FROM (SELECT doc_id, ws, span, unnest(range(1, len(ws) - span + 2)) AS i FROM w JOIN (SELECT DISTINCT span FROM v) ON len(ws) >= span))
  SEMI JOIN v USING (span, words)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h JOIN v USING (span, words)) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id"""


@query("op11_winnowing", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


# Paths as text (lengths make them unambiguous); a node's subtree is what has it on its own path.
OP12_SQL = r"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, c - c % 100 AS b, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(s) + 1),
    lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
r AS (SELECT k.c, 0 AS own, p, role, text FROM k JOIN t ON t.c = b AND p <= h
  UNION ALL SELECT k.c, 1, p, role, text FROM k JOIN t ON t.c = k.c AND p > h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, length(text) AS n,
  length(role) || ':' || role || length(text) || ':' || text AS turn FROM r),
x AS (SELECT c, d, n, string_agg(turn, '') OVER (PARTITION BY c ORDER BY d) AS path FROM o UNION ALL SELECT c, 0, 0, '' FROM k),
g AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n FROM x GROUP BY d, path),
e AS (SELECT d, path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM x
  JOIN (SELECT c, max(d) AS d FROM x GROUP BY c) USING (c, d) GROUP BY d, path),
u AS (SELECT g.d, g.path, q.conv_id AS up_conv, x.path AS up FROM g JOIN x ON x.c = g.conv_id AND x.d = g.d - 1 JOIN g q ON q.d = x.d AND q.path = x.path),
n AS (SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM u GROUP BY ALL),
s AS (SELECT x.d, x.path, count(*) FILTER (WHERE n.n_children IS NULL) AS n_leaves, sum((g.n_convs - 1) * g.n) AS saved
  FROM g LEFT JOIN n ON n.d = g.d AND n.path = g.path JOIN x ON x.c = g.conv_id AND x.d <= g.d GROUP BY x.d, x.path)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, u.up_conv AS parent_conv_id, g.n_convs, coalesce(n.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM g JOIN s ON s.d = g.d AND s.path = g.path LEFT JOIN u ON u.d = g.d AND u.path = g.path
LEFT JOIN n ON n.d = g.d AND n.path = g.path LEFT JOIN e ON e.d = g.d AND e.path = g.path"""


@query("op12_tree_contraction", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_maximal_pairs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(table(spark, sf_dir, "documents"), rewrite=periodic_runs.repeated_tail,
                                   digests_only=True).drop("n_words")
