"""Registered queries: one per operator of the inventory.

``QUERIES[name]`` is ``(spark, sf_dir) -> DataFrame`` over the test tables
(whole tables, nothing sampled); ``ORACLE[name]`` is the same result in
DuckDB SQL over the base tables.  Result columns are flat and named alike on
both sides; floats are rounded to 6 digits, ranks break ties by id.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import (fill_to_page, in_page_range, is_pdf, is_ready, needs_embedding, non_empty,
                         obfuscate_email, object_path, optimized_object_path, parent_folder, path_ancestors,
                         path_changed, squash_ws, strip_nul, truncate_tokens)
from ..operators import audit as A
from ..operators import embed as E
from ..operators import extract as X
from ..operators import index as IX
from ..operators import knn as K
from ..operators import pq as PQ
from ..operators import relations as R
from ..operators import messages as M
from ..operators import search as S
from ..operators.ids import assign_batches, assign_ids, global_positions, latest_by_key
from ..operators.tables import apply_defaults, lookup_inodes, page_counts, set_flags, upsert_pages
from ..operators.retrieval import retrieve_sources
from ..operators.tree import cascade_delete, resolve_paths, tree_intervals
from ..session import materialize, work_dir
from ..sources import TestTables, decode_messages
from ..sources.fixtures import _sql
from . import jobs as J
from . import oracle_views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(TestTables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


# -- shared pieces ---------------------------------------------------------------

def _decoded(t) -> DataFrame:
    return decode_messages(t.fx_messages)


def _requests(t, keys) -> DataFrame:
    return _decoded(t).where(F.col("routing_key").isin(keys)).select("seq", "routing_key", "id")


AFTER_KEYS = ["ingest_inode", "embed_inode", "index_inode", "move_inode", "share_inode"]


def _rebuild_docs(t) -> DataFrame:
    return J.rebuild_index(t.fx_inodes, t.fx_pages)["docs"]


def _flat_inode_docs(docs: DataFrame) -> DataFrame:
    return IX.flat_docs(docs)


# -- 2.1 sources / sinks ----------------------------------------------------------

LOOKUP_REQ = f"""req AS (SELECT seq, routing_key, after_id AS id FROM msgs WHERE routing_key IN {V.KEYS_AFTER})"""


@query("lookup_found", V.with_views("msgs", "fx_inodes", extra=LOOKUP_REQ) + """
SELECT r.seq, r.routing_key, r.id, CAST(i.owner_id AS VARCHAR) AS owner_id, i.type, i.path
FROM req r JOIN fx_inodes i ON i.id = r.id""")
def q_lookup_found(t):
    found, _ = lookup_inodes(_requests(t, AFTER_KEYS), t.fx_inodes)
    return found.select("seq", "routing_key", "id", F.col("owner_id").cast("string").alias("owner_id"), "type", "path")


@query("lookup_missing", V.with_views("msgs", "fx_inodes", extra=LOOKUP_REQ) + """
SELECT r.seq, r.routing_key, r.id FROM req r WHERE NOT EXISTS (SELECT 1 FROM fx_inodes i WHERE i.id = r.id)""")
def q_lookup_missing(t):
    _, missing = lookup_inodes(_requests(t, AFTER_KEYS), t.fx_inodes)
    return missing.select("seq", "routing_key", "id")


@query("non_empty_pages", V.with_views("fx_pages") + """
SELECT id, inode_id, index FROM fx_pages WHERE length(contents) > 0""")
def q_non_empty_pages(t):
    return t.fx_pages.where(non_empty("contents")).select("id", "inode_id", "index")


@query("all_inode_ids", V.with_views("fx_inodes") + "SELECT id FROM fx_inodes")
def q_all_inode_ids(t):
    from ..operators.tables import all_inode_ids
    return all_inode_ids(t.fx_inodes)


@query("upload_manifest", V.with_views("fx_inodes") + f"""
SELECT id, 'optimized' AS kind, {V.object_path('owner_id', 'path')} AS source_key, {V.optimized_object_path('owner_id', 'path')} AS object_key,
  {V.optimized_object_path('owner_id', 'path')} = {V.object_path('owner_id', 'path')} AS collides
FROM fx_inodes WHERE type = 'file' AND error IS NULL""")
def q_upload_manifest(t):
    f = t.fx_inodes.where((F.col("type") == "file") & F.col("error").isNull())
    return J.upload_manifest(f)


INC900 = """inc AS (SELECT i.id AS inode_id, CAST(i.from_page + d.k AS INTEGER) AS index,
  replace(substr(d.text, d.k * 900 + 1, 900), chr(0), '') AS contents
  FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text)/900) AS INT))) AS k FROM documents) d
  JOIN fx_inodes i ON i.id = 1000 + d.doc_id)"""


def _incoming(t, size: int) -> DataFrame:
    files = t.fx_inodes.where(F.col("type") == "file").select("id", "from_page")
    docs = t.documents.select((F.col("doc_id") + 1000).alias("id"), X.chunk_texts("text", size).alias("texts"))
    return X.number_pages(docs.join(files, "id"), texts="texts")


@query("upsert_pages", V.with_views("fx_inodes", "fx_pages", extra=INC900 + """,
j AS (SELECT c.id, coalesce(c.inode_id, n.inode_id) AS inode_id, coalesce(c.index, n.index) AS index,
  coalesce(n.contents, c.contents) AS contents, c.embedding
  FROM fx_pages c FULL OUTER JOIN inc n ON c.inode_id = n.inode_id AND c.index = n.index),
allp AS (SELECT id, inode_id, index, contents, embedding FROM j WHERE id IS NOT NULL
  UNION ALL SELECT (SELECT max(id) FROM fx_pages) + row_number() OVER (ORDER BY inode_id, index),
  inode_id, index, contents, embedding FROM j WHERE id IS NULL)""") + """
SELECT id, inode_id, index, md5(contents) AS contents_md5, embedding IS NOT NULL AS has_embedding FROM allp""")
def q_upsert_pages(t):
    out = upsert_pages(t.fx_pages, _incoming(t, 900))
    return out.select("id", "inode_id", "index", F.md5("contents").alias("contents_md5"),
                      F.col("embedding").isNotNull().alias("has_embedding"))


@query("set_flags", V.with_views("msgs", "fx_inodes") + """
SELECT id, is_indexed, is_indexed AND is_uploaded AND is_ingested AND is_embedded AS is_ready FROM (
  SELECT id, CASE WHEN id IN (SELECT after_id FROM msgs WHERE routing_key = 'index_inode' AND after_id IS NOT NULL)
    THEN true ELSE is_indexed END AS is_indexed, is_uploaded, is_ingested, is_embedded FROM fx_inodes)""")
def q_set_flags(t):
    ids = _requests(t, ["index_inode"]).where(F.col("id").isNotNull())
    out = set_flags(t.fx_inodes, ids, is_indexed=True)
    return out.select("id", "is_indexed", is_ready().alias("is_ready"))


DOCS_ALL = V.docs_cte()


@query("write_index", V.with_views("msgs", "fx_inodes", "fx_pages", recursive=True, extra=V.resolved_cte() + ",\n" + DOCS_ALL + """,
moved AS (SELECT i.id, i.parent_id, i.owner_id, i.type, i.name, coalesce(r.path, i.path) AS path, i.is_public,
  i.from_page FROM fx_inodes i LEFT JOIN resolved r ON r.id = i.id),
tgt AS (SELECT * FROM moved WHERE id IN (SELECT after_id FROM msgs WHERE routing_key = 'index_inode'))""" + ",\n"
          + V.docs_cte("tgt", "fx_pages", "newdocs") + """,
alld AS (SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM newdocs) UNION ALL SELECT * FROM newdocs)""") + """
SELECT doc_id, parent_id, kind, id, path, folder, is_public, index, emb_first FROM alld""")
def q_write_index(t):
    from ..session import materialize, work_dir
    current = materialize(_rebuild_docs(t), "index")      # the index as stored
    resolved = resolve_paths(t.fx_inodes)
    moved = (t.fx_inodes.join(resolved.withColumnRenamed("path", "_rp"), "id", "left")
             .withColumn("path", F.coalesce("_rp", "path")).drop("_rp"))
    out = J.index(_requests(t, ["index_inode"]), moved, t.fx_pages, current, mode="upsert")
    return IX.flat_docs(out["docs"]).select("doc_id", "parent_id", "kind", "id", "path", "folder", "is_public",
                                            "index", "emb_first")


DEL_IDS = """del AS (SELECT DISTINCT CAST(before_id AS VARCHAR) AS root FROM msgs
  WHERE routing_key = 'delete_inode' AND before_id IS NOT NULL)"""


@query("delete_from_index", V.with_views("msgs", "fx_inodes", "fx_pages", extra=DOCS_ALL + ",\n" + DEL_IDS) + """
SELECT doc_id, parent_id, kind FROM docs d
WHERE NOT EXISTS (SELECT 1 FROM del WHERE del.root = coalesce(d.parent_id, d.doc_id))""")
def q_delete_from_index(t):
    out = J.delete(_decoded(t).where(F.col("routing_key") == "delete_inode"), _rebuild_docs(t))
    return out["docs"].select("doc_id", "parent_id", "kind")


@query("children_of", V.with_views("msgs", "fx_inodes", "fx_pages", extra=DOCS_ALL + ",\n" + DEL_IDS) + """
SELECT doc_id, parent_id FROM docs d WHERE kind = 'page' AND parent_id IN (SELECT root FROM del)""")
def q_children_of(t):
    parents = _decoded(t).where(F.col("routing_key") == "delete_inode").select(F.col("before_id").alias("id"))
    return IX.children_of(_rebuild_docs(t), parents.where(F.col("id").isNotNull())).select("doc_id", "parent_id")


@query("route", V.with_views("msgs") + f"""
SELECT seq, CASE WHEN routing_key IN {V.KEYS_ALL} THEN routing_key END AS task,
  CASE WHEN routing_key NOT IN {V.KEYS_ALL} THEN 'unknown_key'
       WHEN routing_key = 'delete_inode' AND before_id IS NULL THEN 'bad_body'
       WHEN routing_key <> 'delete_inode' AND after_id IS NULL THEN 'bad_body'
       ELSE 'ok' END AS status,
  coalesce(after_id, before_id) AS id
FROM msgs""")
def q_route(t):
    return M.route(_decoded(t)).select("seq", "task", "status", "id")


@query("message_bodies", V.with_views("msgs") + """
SELECT seq, after_id, before_id, before_type, before_owner_id, before_path,
  CASE WHEN after_id IS NOT NULL THEN to_json({'after': {'id': after_id}}) END AS encoded
FROM msgs""")
def q_message_bodies(t):
    from ..sources.feed import encode_after
    d = _decoded(t)
    return d.select("seq", "after_id", "before_id", "before_type", "before_owner_id", "before_path",
                    F.when(F.col("after_id").isNotNull(), encode_after("after_id")).alias("encoded"))


# Stateless dispatch over the whole feed: every message is applied to the
# fixture tables as they are (messages do not see each other's effects).
DISPATCH = V.resolved_cte() + """,
found AS (SELECT m.seq, m.routing_key, m.after_id AS id, i.error, i.path, r.path AS new_path, i.is_public,
  i.owner_id, i.is_indexed, i.is_uploaded, i.is_ingested, i.is_embedded
  FROM msgs m JOIN fx_inodes i ON i.id = m.after_id LEFT JOIN resolved r ON r.id = i.id
  WHERE m.routing_key IN ('ingest_inode', 'embed_inode', 'index_inode', 'move_inode', 'share_inode'))"""


def _found(t) -> DataFrame:
    found, _ = lookup_inodes(_requests(t, AFTER_KEYS), t.fx_inodes)
    return found


@query("followups", V.with_views("msgs", "fx_inodes", recursive=True, extra=DISPATCH) + """
SELECT seq, CASE routing_key WHEN 'ingest_inode' THEN 'embed_inode' ELSE 'index_inode' END AS routing_key,
  to_json({'after': {'id': id}}) AS body
FROM found
WHERE routing_key = 'ingest_inode' OR routing_key = 'share_inode'
   OR (routing_key = 'embed_inode' AND error IS NULL)
   OR (routing_key = 'move_inode' AND new_path IS NOT NULL AND new_path IS DISTINCT FROM path)""")
def q_followups(t):
    f = _found(t)
    resolved = resolve_paths(t.fx_inodes).withColumnRenamed("path", "new_path")
    ing = M.followups(f.where(F.col("routing_key") == "ingest_inode"), "ingest_inode")
    emb = M.followups(f.where((F.col("routing_key") == "embed_inode") & F.col("error").isNull()), "embed_inode")
    mv = f.where(F.col("routing_key") == "move_inode").join(resolved, "id", "left")
    mov = M.followups(mv.where(F.col("new_path").isNotNull() & path_changed("new_path", "path")), "move_inode")
    sh = M.followups(f.where(F.col("routing_key") == "share_inode"), "share_inode")
    return ing.unionByName(emb).unionByName(mov).unionByName(sh)


@query("notifications", V.with_views("msgs", "fx_inodes", recursive=True, extra=DISPATCH) + """,
after AS (SELECT seq, routing_key, id, error, is_public, owner_id,
  (is_indexed OR routing_key = 'index_inode') AND is_uploaded AND (is_ingested OR routing_key = 'ingest_inode')
  AND (is_embedded OR routing_key = 'embed_inode') AS is_ready
  FROM found WHERE routing_key IN ('ingest_inode', 'index_inode')
     OR (routing_key = 'embed_inode' AND error IS NULL))
SELECT seq, id, CASE WHEN is_public THEN 'public' ELSE 'user-' || CAST(owner_id AS VARCHAR) END AS channel,
  to_json({'id': id, 'task': routing_key}) AS body
FROM after WHERE coalesce(is_ready, false) OR coalesce(error, '') <> ''""")
def q_notifications(t):
    f = _found(t)
    parts = []
    for task, flag in [("ingest_inode", "is_ingested"), ("embed_inode", "is_embedded"), ("index_inode", "is_indexed")]:
        d = f.where(F.col("routing_key") == task)
        if task == "embed_inode":
            d = d.where(F.col("error").isNull())
        d = d.withColumn(flag, F.lit(True)).withColumn("is_ready", is_ready())
        parts.append(M.notifications(d, task))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dead_letters", V.with_views("msgs", "fx_inodes") + f"""
SELECT seq, routing_key, 'unknown_key' AS reason FROM msgs WHERE routing_key NOT IN {V.KEYS_ALL}
UNION ALL
SELECT seq, routing_key, 'missing_inode' FROM msgs m
  WHERE routing_key IN {V.KEYS_AFTER} AND NOT EXISTS (SELECT 1 FROM fx_inodes i WHERE i.id = m.after_id)
UNION ALL
SELECT m.seq, m.routing_key, 'errored_inode' FROM msgs m JOIN fx_inodes i ON i.id = m.after_id
  WHERE m.routing_key = 'embed_inode' AND i.error IS NOT NULL""")
def q_dead_letters(t):
    routed = M.route(_decoded(t))
    unknown = routed.where(F.col("status") == "unknown_key").select("seq", "routing_key",
                                                                   F.lit("unknown_key").alias("reason"))
    _, missing = lookup_inodes(_requests(t, AFTER_KEYS), t.fx_inodes)
    miss = missing.select("seq", "routing_key", F.lit("missing_inode").alias("reason"))
    f = _found(t)
    _, rejected = E.embeddable(f.where(F.col("routing_key") == "embed_inode"))
    err = rejected.select("seq", "routing_key", F.lit("errored_inode").alias("reason"))
    return M.dead_letters(unknown, miss, err)


# -- 2.2 filters ---------------------------------------------------------------

@query("page_range", V.with_views("fx_inodes", "fx_pages") + """
SELECT p.id, p.inode_id, p.index FROM fx_pages p JOIN fx_inodes i ON i.id = p.inode_id
WHERE p.index >= i.from_page AND p.index < i.to_page""")
def q_page_range(t):
    ino = t.fx_inodes.select(F.col("id").alias("inode_id"), "from_page", "to_page")
    return (t.fx_pages.join(ino, "inode_id").where(in_page_range("index", "from_page", "to_page"))
            .select("id", "inode_id", "index"))


@query("needs_embedding", V.with_views("fx_pages") + "SELECT id, inode_id FROM fx_pages WHERE embedding IS NULL")
def q_needs_embedding(t):
    return t.fx_pages.where(needs_embedding("embedding")).select("id", "inode_id")


@query("is_pdf", V.with_views("fx_objects") + "SELECT id, path, starts_with(content, '%PDF-') AS is_pdf FROM fx_objects")
def q_is_pdf(t):
    return t.fx_objects.select("id", "path", is_pdf("content").alias("is_pdf"))


@query("embeddable", V.with_views("msgs", "fx_inodes") + """
SELECT DISTINCT i.id, i.error IS NULL AS embeddable FROM msgs m JOIN fx_inodes i ON i.id = m.after_id
WHERE m.routing_key = 'embed_inode'""")
def q_embeddable(t):
    f = _found(t).where(F.col("routing_key") == "embed_inode").select("id", "error").distinct()
    ok, bad = E.embeddable(f)
    return ok.select("id", F.lit(True).alias("embeddable")).unionByName(bad.select("id", F.lit(False).alias("embeddable")))


@query("path_changed", V.with_views("fx_inodes", recursive=True, extra=V.resolved_cte()) + """
SELECT i.id, r.path IS DISTINCT FROM i.path AS changed FROM fx_inodes i JOIN resolved r ON r.id = i.id""")
def q_path_changed(t):
    r = resolve_paths(t.fx_inodes).withColumnRenamed("path", "new_path")
    return t.fx_inodes.join(r, "id").select("id", path_changed("new_path", "path").alias("changed"))


@query("visible_to", V.with_views("fx_inodes", "fx_pages", extra=DOCS_ALL) + """
SELECT doc_id, kind FROM docs WHERE is_public OR readable_by = '3'""")
def q_visible_to(t):
    return IX.visible_to(_rebuild_docs(t), "3").select("doc_id", "kind")


# -- 2.3 projections ---------------------------------------------------------------

@query("page_numbering", V.with_views("fx_inodes") + """
SELECT i.id AS inode_id, CAST(i.from_page + d.k AS INTEGER) AS index,
  md5(replace(substr(d.text, d.k * 1000 + 1, 1000), chr(0), '')) AS contents_md5,
  CAST(length(replace(substr(d.text, d.k * 1000 + 1, 1000), chr(0), '')) AS INTEGER) AS n_chars
FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text)/1000) AS INT))) AS k FROM documents) d
JOIN fx_inodes i ON i.id = 1000 + d.doc_id""")
def q_page_numbering(t):
    p = _incoming(t, 1000)
    return p.select("inode_id", "index", F.md5("contents").alias("contents_md5"),
                    F.length("contents").alias("n_chars"))


@query("strip_nul", "SELECT doc_id, md5(replace(text, chr(0), '')) AS text_md5 FROM documents")
def q_strip_nul(t):
    return t.documents.select("doc_id", F.md5(strip_nul("text")).alias("text_md5"))


@query("squash_ws", f"""
SELECT doc_id, md5({V.squash('text')}) AS text_md5, CAST(length({V.squash('text')}) AS INTEGER) AS n_chars
FROM documents""")
def q_squash_ws(t):
    s = squash_ws("text")
    return t.documents.select("doc_id", F.md5(s).alias("text_md5"), F.length(s).alias("n_chars"))


@query("truncate_tokens", f"""
SELECT doc_id, md5(array_to_string(list_slice(string_split({V.squash('text')}, ' '), 1, {schemas.MAX_TOKENS}), ' ')) AS text_md5,
  CAST(len(list_slice(string_split({V.squash('text')}, ' '), 1, {schemas.MAX_TOKENS})) AS INTEGER) AS n_tokens
FROM documents""")
def q_truncate_tokens(t):
    s = truncate_tokens("text", schemas.MAX_TOKENS)
    return t.documents.select("doc_id", F.md5(s).alias("text_md5"), F.size(F.split(s, " ")).alias("n_tokens"))


@query("object_path", V.with_views("fx_inodes") + f"SELECT id, {V.object_path('owner_id', 'path')} AS object_key FROM fx_inodes")
def q_object_path(t):
    return t.fx_inodes.select("id", object_path("owner_id", "path").alias("object_key"))


@query("optimized_path", V.with_views("fx_inodes") +
       f"SELECT id, {V.optimized_object_path('owner_id', 'path')} AS object_key FROM fx_inodes")
def q_optimized_path(t):
    return t.fx_inodes.select("id", optimized_object_path("owner_id", "path").alias("object_key"))


@query("parent_folder", V.with_views("fx_inodes") + f"SELECT id, {V.parent_folder('path')} AS folder FROM fx_inodes")
def q_parent_folder(t):
    return t.fx_inodes.select("id", parent_folder("path").alias("folder"))


@query("obfuscate_email", V.with_views("fx_users") + """
SELECT id, regexp_replace(split_part(email, '@', 1), '(?s).', '*', 'g') || '@' || split_part(email, '@', 2)
  AS obfuscated_email FROM fx_users""")
def q_obfuscate_email(t):
    return t.fx_users.select("id", obfuscate_email("email").alias("obfuscated_email"))


@query("is_ready", V.with_views("fx_inodes") +
       "SELECT id, is_indexed AND is_uploaded AND is_ingested AND is_embedded AS is_ready FROM fx_inodes")
def q_is_ready(t):
    return t.fx_inodes.select("id", is_ready().alias("is_ready"))


TAGS = """SELECT id, 'original' AS kind, {op} AS object_key, CASE WHEN is_public THEN 'True' ELSE 'False' END AS tag, {op} = {oo} AS collides
FROM {src} UNION ALL
SELECT id, 'optimized', {oo}, CASE WHEN is_public THEN 'True' ELSE 'False' END, false FROM {src} WHERE {op} <> {oo}"""


@query("public_tags", V.with_views("fx_inodes", extra="pub AS (SELECT * FROM fx_inodes WHERE type = 'file' AND is_public)")
       + TAGS.format(op=V.object_path("owner_id", "path"), oo=V.optimized_object_path("owner_id", "path"), src="pub"))
def q_public_tags(t):
    return J.public_tags(t.fx_inodes.where((F.col("type") == "file") & F.col("is_public")))


NOW = dt.datetime(2024, 1, 1, 0, 0, 0)


@query("apply_defaults", V.with_views("fx_inodes") + """
SELECT id, CAST(owner_id AS VARCHAR) AS owner_id, 'folder' AS type, name, path, false AS is_indexed,
  false AS is_public, false AS is_uploaded, false AS is_ingested, false AS is_embedded, 0 AS from_page,
  false AS should_move, parent_id, '2024-01-01 00:00:00' AS created_at, '2024-01-01 00:00:00' AS updated_at,
  to_page, error FROM fx_inodes""")
def q_apply_defaults(t):
    src = t.fx_inodes.select("id", "owner_id", "name", "path", "parent_id", "to_page", "error")
    out = apply_defaults(src, "inodes", now=NOW)
    return (out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
            .withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")))


INODE_DOC_COLS = "doc_id, parent_id, kind, id, owner_id, is_public, readable_by, path, type, folder, filename"
PAGE_DOC_COLS = "doc_id, parent_id, kind, id, owner_id, is_public, readable_by, index, contents_md5, emb_dim, emb_first"


@query("inode_docs", V.with_views("fx_inodes", "fx_pages", extra=DOCS_ALL) +
       f"SELECT {INODE_DOC_COLS} FROM docs WHERE kind = 'inode'")
def q_inode_docs(t):
    return IX.flat_docs(IX.inode_docs(t.fx_inodes)).select(*INODE_DOC_COLS.split(", "))


@query("page_docs", V.with_views("fx_inodes", "fx_pages", extra=DOCS_ALL) +
       f"SELECT {PAGE_DOC_COLS} FROM docs WHERE kind = 'page'")
def q_page_docs(t):
    docs, _ = IX.page_docs(t.fx_inodes, t.fx_pages)
    return IX.flat_docs(docs).select(*PAGE_DOC_COLS.split(", "))


@query("fill_to_page", V.with_views("fx_inodes", "fx_pages") + """
SELECT i.id, CAST(coalesce(nullif(i.to_page, 0), c.n) AS INTEGER) AS to_page
FROM fx_inodes i LEFT JOIN (SELECT inode_id, count(*) AS n FROM fx_pages GROUP BY inode_id) c ON c.inode_id = i.id
WHERE i.type = 'file'""")
def q_fill_to_page(t):
    counts = page_counts(t.fx_pages).withColumnRenamed("inode_id", "id")
    f = t.fx_inodes.where(F.col("type") == "file").join(counts, "id", "left")
    return f.select("id", fill_to_page("to_page", "n_pages").alias("to_page"))


@query("path_ancestors", V.with_views("fx_inodes", extra=f"fo AS (SELECT id, {V.parent_folder('path')} AS folder FROM fx_inodes)")
       + f"SELECT id, array_to_string({V.ancestors('folder')}, '|') AS ancestors FROM fo")
def q_path_ancestors(t):
    return t.fx_inodes.select("id", F.array_join(path_ancestors(parent_folder("path")), "|").alias("ancestors"))


@query("html_text", "SELECT page_id, md5(HTML) AS text_md5, CAST(length(HTML) AS INTEGER) AS n_chars FROM pages")
def q_html_text(t):
    txt = X.html_text("html")
    return t.pages.select("page_id", F.md5(txt).alias("text_md5"), F.length(txt).alias("n_chars"))


def _html_sql(col: str) -> str:
    s = col
    for pattern in X.HTML_DROP:
        s = f"regexp_replace({s}, '{pattern}', ' ', 'g')"
    s = f"regexp_replace({s}, '{X.HTML_TAG}', ' ', 'g')"
    for entity, char in X.HTML_ENTITIES:
        s = f"replace({s}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return V.squash(s)


ORACLE["html_text"] = ORACLE["html_text"].replace("HTML", _html_sql("html"))


@query("ingest_status", V.with_views("fx_objects") + """
SELECT id, CASE WHEN NOT starts_with(content, '%PDF-') THEN 'unsupported_file_type'
  WHEN NOT contains(lower(content), '</html>') THEN 'corrupted_file' END AS status FROM fx_objects""")
def q_ingest_status(t):
    o = X.builtin_extract(t.fx_objects)
    return o.select("id", X.ingest_status(is_pdf("content"), F.col("extract_error")).alias("status"))


# -- 2.4 joins -----------------------------------------------------------------

@query("resolve_paths", V.with_views("fx_inodes", recursive=True, extra=V.resolved_cte()) + "SELECT id, path FROM resolved")
def q_resolve_paths(t):
    return resolve_paths(t.fx_inodes)


@query("move_manifest", V.with_views("msgs", "fx_inodes", recursive=True, extra=V.resolved_cte() + """,
ch AS (SELECT DISTINCT i.id, i.owner_id, i.path, r.path AS new_path FROM msgs m JOIN fx_inodes i ON i.id = m.after_id
  JOIN resolved r ON r.id = i.id
  WHERE m.routing_key = 'move_inode' AND i.type = 'file' AND r.path IS NOT NULL
    AND r.path IS DISTINCT FROM i.path),""" + f"""
ck AS (SELECT id, {V.object_path('owner_id', 'path')} AS o, {V.optimized_object_path('owner_id', 'path')} AS oo,
  {V.object_path('owner_id', 'new_path')} AS n, {V.optimized_object_path('owner_id', 'new_path')} AS no FROM ch)""") + """
SELECT id, 'original' AS kind, o AS old_key, n AS new_key, o = oo OR n = no AS collides FROM ck
UNION ALL SELECT id, 'optimized', oo, no, false FROM ck WHERE o <> oo AND n <> no""")
def q_move_manifest(t):
    return J.move(_requests(t, ["move_inode"]), t.fx_inodes)["manifest"]


@query("share_tags", V.with_views("msgs", "fx_inodes", extra="""sh AS (SELECT * FROM fx_inodes
  WHERE type = 'file' AND id IN (SELECT after_id FROM msgs WHERE routing_key = 'share_inode'))""")
       + TAGS.format(op=V.object_path("owner_id", "path"), oo=V.optimized_object_path("owner_id", "path"), src="sh"))
def q_share_tags(t):
    return J.share(_requests(t, ["share_inode"]), t.fx_inodes)["tags"]


@query("delete_manifest", V.with_views("msgs", extra="""dl AS (SELECT seq, before_id AS id, before_owner_id AS owner_id,
  before_path AS path FROM msgs WHERE routing_key = 'delete_inode' AND before_type = 'file')""") + f"""
SELECT seq, id, 'original' AS kind, {V.object_path('owner_id', 'path')} AS object_key,
  {V.object_path('owner_id', 'path')} = {V.optimized_object_path('owner_id', 'path')} AS collides FROM dl
UNION ALL SELECT seq, id, 'optimized', {V.optimized_object_path('owner_id', 'path')}, false FROM dl
  WHERE {V.object_path('owner_id', 'path')} <> {V.optimized_object_path('owner_id', 'path')}""")
def q_delete_manifest(t):
    return J.delete(_decoded(t).where(F.col("routing_key") == "delete_inode"))["manifest"]


@query("cascade_delete", V.with_views("msgs", "fx_inodes", "fx_pages", "fx_conversations_inodes", recursive=True,
                                      extra="""d(id) AS (SELECT before_id FROM msgs WHERE routing_key = 'delete_inode'
    AND before_id IS NOT NULL
  UNION SELECT c.id FROM fx_inodes c JOIN d ON c.parent_id = d.id),
ex AS (SELECT DISTINCT id FROM d WHERE id IN (SELECT id FROM fx_inodes))""") + """
SELECT 'inode' AS kind, id AS key1, CAST(NULL AS BIGINT) AS key2 FROM ex
UNION ALL SELECT 'page', p.id, CAST(NULL AS BIGINT) FROM fx_pages p WHERE p.inode_id IN (SELECT id FROM ex)
UNION ALL SELECT 'conversation_link', l.conversation_id, l.inode_id FROM fx_conversations_inodes l
  WHERE l.inode_id IN (SELECT id FROM ex)""")
def q_cascade_delete(t):
    deleted = _decoded(t).where(F.col("routing_key") == "delete_inode").select(F.col("before_id").alias("id"))
    return cascade_delete(t.fx_inodes, t.fx_pages, t.fx_conversations_inodes, deleted)


@query("conversation_scope", V.with_views("fx_pages", "fx_conversations_inodes") + """
SELECT l.conversation_id, p.id AS page_id FROM fx_conversations_inodes l JOIN fx_pages p ON p.inode_id = l.inode_id
WHERE length(p.contents) > 0""")
def q_conversation_scope(t):
    pages = t.fx_pages.where(non_empty("contents")).select(F.col("id").alias("page_id"), "inode_id")
    return t.fx_conversations_inodes.join(pages, "inode_id").select("conversation_id", "page_id")


@query("conversation_files", V.with_views("fx_inodes", "fx_conversations_inodes") + """
SELECT l.conversation_id, i.id AS inode_id, i.path FROM fx_conversations_inodes l JOIN fx_inodes i ON i.id = l.inode_id""")
def q_conversation_files(t):
    ino = t.fx_inodes.select(F.col("id").alias("inode_id"), "path")
    return t.fx_conversations_inodes.join(ino, "inode_id").select("conversation_id", "inode_id", "path")


# -- 2.5 aggregations ---------------------------------------------------------------

@query("page_counts", V.with_views("fx_pages") + "SELECT inode_id, count(*) AS n_pages FROM fx_pages GROUP BY inode_id")
def q_page_counts(t):
    return page_counts(t.fx_pages)


@query("folder_facets", V.with_views("fx_inodes", extra=f"fo AS (SELECT {V.parent_folder('path')} AS folder FROM fx_inodes)")
       + f"""SELECT tok AS folder_token, count(*) AS n_docs
FROM (SELECT unnest({V.ancestors('folder')}) AS tok FROM fo) GROUP BY tok""")
def q_folder_facets(t):
    return IX.folder_facets(IX.inode_docs(t.fx_inodes))


TV = V.term_vectors_cte()


def _tv(t) -> DataFrame:
    return S.term_vectors(t.fx_pages.where(non_empty("contents")))


@query("term_vectors", V.with_views("fx_pages", extra=TV) + "SELECT id, term, position, start_offset, end_offset FROM tv")
def q_term_vectors(t):
    return _tv(t)


@query("term_stats", V.with_views("fx_pages", extra=TV) + """
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT id, term, count(*) AS tf FROM tv GROUP BY 1, 2)
GROUP BY term""")
def q_term_stats(t):
    return S.term_stats(S.term_rows(t.fx_pages.where(non_empty("contents"))))


@query("doc_lengths", V.with_views("fx_pages", extra=TV) + """,
dl AS (SELECT id, count(*) AS dl FROM tv GROUP BY id)
SELECT id, dl, round(dl / (SELECT avg(dl) FROM dl), 6) AS share_of_mean FROM dl""")
def q_doc_lengths(t):
    tv = materialize(_tv(t).select("id"), "words")
    mean = S.length_stats(tv).first()["mean_length"]
    return S.doc_lengths(tv).select("id", "dl", F.round(F.col("dl") / F.lit(mean), 6).alias("share_of_mean"))


@query("length_stats", V.with_views("fx_pages", extra=TV) + """,
dl AS (SELECT id, count(*) AS dl FROM tv GROUP BY id)
SELECT count(*) AS n_docs, CAST(sum(dl) AS BIGINT) AS n_terms, round(avg(dl), 6) AS mean_length FROM dl""")
def q_length_stats(t):
    return S.length_stats(_tv(t)).withColumn("mean_length", F.round("mean_length", 6))


# -- 2.6 windows ---------------------------------------------------------------------

@query("assign_batches", V.with_views("fx_pages") + """
SELECT id, inode_id, index, CAST((rn - 1) // 64 AS INTEGER) AS batch, CAST((rn - 1) % 64 AS INTEGER) AS pos_in_batch
FROM (SELECT id, inode_id, index, row_number() OVER (PARTITION BY inode_id ORDER BY index, id) AS rn
      FROM fx_pages WHERE length(contents) > 0)""")
def q_assign_batches(t):
    p = t.fx_pages.where(non_empty("contents")).select("id", "inode_id", "index")
    return assign_batches(p, size=schemas.EMBED_BATCH).select("id", "inode_id", "index", "batch", "pos_in_batch")


@query("assign_ids", V.with_views("fx_inodes") + """
SELECT row_number() OVER (ORDER BY i.id, d.k) AS id, i.id AS inode_id, CAST(i.from_page + d.k AS INTEGER) AS index
FROM (SELECT doc_id, unnest(range(0, CAST(ceil(length(text)/1000) AS INT))) AS k FROM documents) d
JOIN fx_inodes i ON i.id = 1000 + d.doc_id""")
def q_assign_ids(t):
    return assign_ids(_incoming(t, 1000).select("inode_id", "index"), ["inode_id", "index"], start=1) \
        .select("id", "inode_id", "index")


@query("latest_by_key", V.with_views("msgs") + """
SELECT id, seq, routing_key FROM (
  SELECT coalesce(after_id, before_id) AS id, seq, routing_key,
    row_number() OVER (PARTITION BY coalesce(after_id, before_id) ORDER BY ts DESC, seq DESC) AS rn
  FROM msgs WHERE coalesce(after_id, before_id) IS NOT NULL) WHERE rn = 1""")
def q_latest_by_key(t):
    d = _decoded(t).where(F.col("id").isNotNull()).select("id", "ts", "seq", "routing_key")
    return latest_by_key(d, ["id"], ["ts", "seq"]).select("id", "seq", "routing_key")


SELECTION = """sel AS (SELECT p.id, p.inode_id, p.index, p.contents AS text FROM fx_pages p JOIN fx_inodes i ON i.id = p.inode_id
  WHERE p.index >= i.from_page AND p.index < i.to_page AND p.embedding IS NULL AND length(p.contents) > 0
    AND i.error IS NULL)"""


@query("attach_embeddings", V.with_views("fx_inodes", "fx_pages", extra=SELECTION + ",\n" + V.hashed_cte("sel")) + """
SELECT s.id, CAST(64 AS INTEGER) AS emb_dim,
  round(coalesce((SELECT x FROM hv WHERE hv.id = s.id AND hv.b = 0), 0.0), 6) AS emb_first,
  round(coalesce((SELECT sum(x) FROM hv WHERE hv.id = s.id), 0.0), 6) AS emb_sum
FROM sel s""")
def q_attach_embeddings(t):
    sel = E.embed_selection(t.fx_inodes, t.fx_pages)
    vec = E.hashed_embeddings(E.embed_input(sel), "id", "text", 64)
    out = E.attach_embeddings(sel, vec)
    return out.select("id", F.size("embedding").alias("emb_dim"),
                      F.round(F.col("embedding")[0].cast("double"), 6).alias("emb_first"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
                      .alias("emb_sum"))


# -- 2.7 top-k -----------------------------------------------------------------------

KNN = """pv AS (SELECT id, embedding FROM fx_pages WHERE embedding IS NOT NULL),
pd AS (SELECT q.id AS qid, p.id, list_sum(list_transform(range(1, len(q.embedding) + 1),
  lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(p.embedding[i] AS DOUBLE)) ** 2)) AS d2
  FROM fx_prompts q, pv p WHERE q.embedding IS NOT NULL)"""


@query("knn_exact", V.with_views("fx_pages", "fx_prompts", extra=KNN) + """
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(sqrt(d2), 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 9), id) AS rank FROM pd) WHERE rank <= 10""")
def q_knn_exact(t):
    out = K.knn_exact(t.fx_prompts, t.fx_pages, k=10)
    return out.select("qid", F.col("vid").alias("id"), F.col("rank").cast("int").alias("rank"),
                      F.round("distance", 6).alias("distance"))


SCOPED = """sc AS (SELECT q.id AS qid, p.id, list_sum(list_transform(range(1, len(q.embedding) + 1),
  lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(p.embedding[i] AS DOUBLE)) ** 2)) AS d2
  FROM fx_prompts q JOIN fx_conversations_inodes l ON l.conversation_id = q.conversation_id
  JOIN fx_pages p ON p.inode_id = l.inode_id
  WHERE q.embedding IS NOT NULL AND p.embedding IS NOT NULL AND length(p.contents) > 0),
src AS (SELECT qid AS prompt_id, id AS page_id, CAST(rank AS INTEGER) AS rank, 1.0 / (1.0 + d2) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 9), id) AS rank FROM sc) WHERE rank <= 5)"""


def _sources(t) -> DataFrame:
    """O-R3 without visibility: the conversation's own files."""
    return retrieve_sources(t.fx_prompts, t.fx_pages, t.fx_conversations_inodes)


@query("retrieve_sources", V.with_views("fx_pages", "fx_prompts", "fx_conversations_inodes", extra=SCOPED) + """
SELECT prompt_id, page_id, rank, round(similarity, 6) AS similarity FROM src""")
def q_retrieve_sources(t):
    return _sources(t).withColumn("similarity", F.round("similarity", 6))


@query("prompt_sources", V.with_views("fx_inodes", "fx_pages", "fx_prompts", "fx_conversations_inodes", extra=SCOPED) + """
SELECT s.prompt_id, s.page_id, p.inode_id, i.path, round(s.similarity, 6) AS similarity
FROM src s JOIN fx_pages p ON p.id = s.page_id JOIN fx_inodes i ON i.id = p.inode_id""")
def q_prompt_sources(t):
    s = _sources(t)
    pages = t.fx_pages.select(F.col("id").alias("page_id"), "inode_id")
    ino = t.fx_inodes.select(F.col("id").alias("inode_id"), "path")
    return (s.join(pages, "page_id").join(ino, "inode_id")
            .select("prompt_id", "page_id", "inode_id", "path", F.round("similarity", 6).alias("similarity")))


# -- 2.11 retrieval -----------------------------------------------------------------

BM25 = TV + """,
post AS (SELECT id, term, count(*) AS tf FROM tv GROUP BY 1, 2),
dl AS (SELECT id, count(*) AS dl FROM tv GROUP BY 1),
coll AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
st AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT DISTINCT qid, term FROM (SELECT id AS qid, unnest(regexp_extract_all(lower(query), 'WORD')) AS term
  FROM fx_prompts)),
sc AS (SELECT qt.qid, post.id, sum(ln(1 + (coll.n - st.df + 0.5) / (st.df + 0.5)) * post.tf
  / (post.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / coll.avgdl))) AS score
  FROM qt JOIN st ON st.term = qt.term JOIN post ON post.term = qt.term JOIN dl ON dl.id = post.id CROSS JOIN coll
  GROUP BY 1, 2),
top AS (SELECT qid, id, CAST(rank AS INTEGER) AS rank, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc) WHERE rank <= 10)
""".replace("WORD", V.WORD)


def _bm25(t):
    index = S.bm25_index(t.fx_pages.where(non_empty("contents")))
    return S.bm25(index, t.fx_prompts, k=10, qid="id", text="query")


@query("bm25", V.with_views("fx_pages", "fx_prompts", extra=BM25) + "SELECT qid, id, rank, round(score, 6) AS score FROM top")
def q_bm25(t):
    return _bm25(t).select("qid", "id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query("highlights", V.with_views("fx_pages", "fx_prompts", extra=BM25) + """
SELECT h.qid, h.id, tv.term, tv.position, tv.start_offset, tv.end_offset
FROM (SELECT qid, id FROM top) h JOIN qt ON qt.qid = h.qid JOIN tv ON tv.id = h.id AND tv.term = qt.term""")
def q_highlights(t):
    hits = materialize(_bm25(t).select("qid", "id"), "hits")
    # Only documents that were hit are cut into words.
    pages = t.fx_pages.where(non_empty("contents")).join(hits.select("id").distinct(), "id", "left_semi")
    return S.highlights(S.term_vectors(pages), hits, S.query_terms(t.fx_prompts, "id", "query"))


@query("phrase", V.with_views("fx_pages", extra=TV + """,
pt AS (SELECT pid, unnest(toks) AS term, unnest(generate_series(0, len(toks) - 1)) AS i, len(toks) AS n
  FROM (SELECT item_id AS pid, regexp_extract_all(lower(text), 'WORD') AS toks FROM benchmark)),
pm AS (SELECT pt.pid, tv.id, tv.position - pt.i AS start, count(*) AS hits, min(tv.start_offset) AS so,
  max(tv.end_offset) AS eo, any_value(pt.n) AS n FROM pt JOIN tv ON tv.term = pt.term GROUP BY 1, 2, 3)""".replace("WORD", V.WORD))
       + """SELECT pid, id, CAST(start AS INTEGER) AS start_position, CAST(so AS INTEGER) AS start_offset,
  CAST(eo AS INTEGER) AS end_offset FROM pm WHERE hits = n""")
def q_phrase(t):
    return S.phrase(S.term_vectors(t.fx_pages.where(non_empty("contents")), with_next=True), t.benchmark, pid="item_id", text="text")


@query("in_folder", V.with_views("fx_inodes", "fx_pages", extra=DOCS_ALL) + f"""
SELECT doc_id, kind FROM docs WHERE kind = 'inode' AND list_contains({V.ancestors('folder')}, '/src1')
UNION ALL SELECT doc_id, kind FROM docs WHERE kind = 'page' AND parent_id IN (
  SELECT doc_id FROM docs WHERE kind = 'inode' AND list_contains({V.ancestors('folder')}, '/src1'))""")
def q_in_folder(t):
    return IX.in_folder(_rebuild_docs(t), "/src1").select("doc_id", "kind")


# -- 2.12 audits ----------------------------------------------------------------------

@query("audit_duplicate_keys", V.with_views("fx_inodes_bad", "fx_pages_bad", "fx_links_bad") + """
SELECT 'inodes' AS tbl, CAST(id AS VARCHAR) AS key, count(*) AS n FROM fx_inodes_bad GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'pages', CAST(id AS VARCHAR), count(*) FROM fx_pages_bad GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'pages_inode_index', CAST(inode_id AS VARCHAR) || '/' || CAST(index AS VARCHAR), count(*)
  FROM fx_pages_bad GROUP BY inode_id, index HAVING count(*) > 1
UNION ALL SELECT 'conversations_inodes', CAST(conversation_id AS VARCHAR) || '/' || CAST(inode_id AS VARCHAR), count(*)
  FROM fx_links_bad GROUP BY conversation_id, inode_id HAVING count(*) > 1""")
def q_audit_duplicate_keys(t):
    parts = [
        A.duplicate_keys(t.fx_inodes_bad, ["id"]).select(F.lit("inodes").alias("tbl"), F.col("id").cast("string").alias("key"), "n"),
        A.duplicate_keys(t.fx_pages_bad, ["id"]).select(F.lit("pages").alias("tbl"), F.col("id").cast("string").alias("key"), "n"),
        A.duplicate_keys(t.fx_pages_bad, ["inode_id", "index"]).select(
            F.lit("pages_inode_index").alias("tbl"), F.concat_ws("/", "inode_id", "index").alias("key"), "n"),
        A.duplicate_keys(t.fx_links_bad, ["conversation_id", "inode_id"]).select(
            F.lit("conversations_inodes").alias("tbl"), F.concat_ws("/", "conversation_id", "inode_id").alias("key"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("audit_duplicate_paths", V.with_views("fx_inodes_bad") + """
SELECT owner_id, lower(path) AS lpath, count(*) AS n FROM fx_inodes_bad GROUP BY owner_id, lower(path) HAVING count(*) > 1""")
def q_audit_duplicate_paths(t):
    return A.duplicate_paths(t.fx_inodes_bad)


@query("audit_blank_names", V.with_views("fx_inodes_bad") + "SELECT id, name FROM fx_inodes_bad WHERE trim(name) = ''")
def q_audit_blank_names(t):
    return A.blank_names(t.fx_inodes_bad)


@query("audit_orphans", V.with_views("fx_inodes_bad", "fx_pages_bad", "fx_links_bad") + """
SELECT 'pages.inode_id' AS fk, id AS key FROM fx_pages_bad p WHERE NOT EXISTS (SELECT 1 FROM fx_inodes_bad i WHERE i.id = p.inode_id)
UNION ALL SELECT 'inodes.parent_id', id FROM fx_inodes_bad c WHERE parent_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM fx_inodes_bad i WHERE i.id = c.parent_id)
UNION ALL SELECT 'conversations_inodes.inode_id', conversation_id FROM fx_links_bad l
  WHERE NOT EXISTS (SELECT 1 FROM fx_inodes_bad i WHERE i.id = l.inode_id)""")
def q_audit_orphans(t):
    ino = t.fx_inodes_bad
    return (A.orphans(t.fx_pages_bad, ino, "inode_id").select(F.lit("pages.inode_id").alias("fk"), F.col("id").alias("key"))
            .unionByName(A.orphans(ino, ino, "parent_id").select(F.lit("inodes.parent_id").alias("fk"),
                                                                  F.col("id").alias("key")))
            .unionByName(A.orphans(t.fx_links_bad, ino, "inode_id").select(
                F.lit("conversations_inodes.inode_id").alias("fk"), F.col("conversation_id").alias("key"))))


@query("audit_enums", V.with_views("fx_inodes_bad") + f"""
SELECT id, 'type' AS col, type AS value FROM fx_inodes_bad WHERE type NOT IN ('folder', 'file')
UNION ALL SELECT id, 'error', error FROM fx_inodes_bad WHERE error IS NOT NULL
  AND error NOT IN ('unsupported_file_type', 'corrupted_file')""")
def q_audit_enums(t):
    ino = t.fx_inodes_bad
    return (A.bad_enum(ino, "type", schemas.INODE_TYPES).select("id", F.lit("type").alias("col"), F.col("type").alias("value"))
            .unionByName(A.bad_enum(ino, "error", schemas.FILE_ERRORS).select("id", F.lit("error").alias("col"),
                                                                              F.col("error").alias("value"))))


NN_INODES = ["owner_id", "type", "name", "path", "is_indexed", "is_public", "is_uploaded", "is_ingested",
             "is_embedded", "from_page"]
NN_PAGES = ["inode_id", "index", "contents"]


@query("audit_nulls", V.with_views("fx_inodes_bad", "fx_pages_bad") + " UNION ALL ".join(
    [f"SELECT 'inodes' AS tbl, id, '{c}' AS col FROM fx_inodes_bad WHERE {c} IS NULL" for c in NN_INODES]
    + [f"SELECT 'pages', id, '{c}' FROM fx_pages_bad WHERE {c} IS NULL" for c in NN_PAGES]))
def q_audit_nulls(t):
    a = A.null_violations(t.fx_inodes_bad, NN_INODES).select(F.lit("inodes").alias("tbl"), "id", F.col("column").alias("col"))
    b = A.null_violations(t.fx_pages_bad, NN_PAGES).select(F.lit("pages").alias("tbl"), "id", F.col("column").alias("col"))
    return a.unionByName(b)


FIXTURE_DIM = 64       # width of the test vectors


@query("audit_dimension", V.with_views("fx_pages_bad", "fx_prompts") + f"""
SELECT 'pages' AS tbl, id, CAST(len(embedding) AS INTEGER) AS dim FROM fx_pages_bad
  WHERE embedding IS NOT NULL AND len(embedding) <> {FIXTURE_DIM}
UNION ALL SELECT 'prompts', id, CAST(len(embedding) AS INTEGER) FROM fx_prompts
  WHERE embedding IS NOT NULL AND len(embedding) <> {FIXTURE_DIM}""")
def q_audit_dimension(t):
    a = A.bad_dimension(t.fx_pages_bad, FIXTURE_DIM).select(F.lit("pages").alias("tbl"), "id",
                                                                  F.size("embedding").alias("dim"))
    b = A.bad_dimension(t.fx_prompts, FIXTURE_DIM).select(F.lit("prompts").alias("tbl"), "id",
                                                                    F.size("embedding").alias("dim"))
    return a.unionByName(b)


# -- 2.13 jobs ---------------------------------------------------------------------------

def _object_table(t) -> DataFrame:
    o = t.fx_objects
    return o.select(object_path("owner_id", "path").alias("key"), F.col("content").cast("binary").alias("content"))


def _object_inodes(t) -> DataFrame:
    return t.spark.sql(V.FX["fx_object_inodes"].split(" AS (", 1)[1].rsplit(")", 1)[0]
                       .replace("fx_objects", "{fx_objects}"), fx_objects=t.fx_objects)


@query("ingest_job", V.with_views("fx_object_inodes", extra="""st AS (
  SELECT i.id, i.to_page, i.error, i.from_page,
    CASE WHEN NOT starts_with(o.content, '%PDF-') THEN 'unsupported_file_type'
         WHEN NOT contains(lower(o.content), '</html>') THEN 'corrupted_file' END AS new_error
  FROM fx_object_inodes i JOIN fx_objects o ON 500000 + o.id = i.id)""") + """
SELECT id, coalesce(new_error, error) AS error,
  CAST(CASE WHEN new_error IS NULL THEN coalesce(nullif(to_page, 0), 1) ELSE to_page END AS INTEGER) AS to_page,
  true AS is_ingested, CAST(CASE WHEN new_error IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_pages FROM st""")
def q_ingest_job(t):
    inodes = _object_inodes(t)
    requests = inodes.select(F.col("id").alias("seq"), "id")
    empty = t.spark.createDataFrame([], schemas.PAGES)
    out = J.ingest(requests, inodes, _object_table(t), empty)
    counts = page_counts(out["pages"]).withColumnRenamed("inode_id", "id")
    return (out["inodes"].join(counts, "id", "left")
            .select("id", "error", "to_page", "is_ingested",
                    F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages")))


@query("ingest_pages", V.with_views("fx_object_inodes") + f"""
SELECT i.id AS inode_id, CAST(coalesce(i.from_page, 0) AS INTEGER) AS index, md5({_html_sql("substr(o.content, 9)")}) AS contents_md5
FROM fx_object_inodes i JOIN fx_objects o ON 500000 + o.id = i.id
WHERE starts_with(o.content, '%PDF-') AND contains(lower(o.content), '</html>')""")
def q_ingest_pages(t):
    """The pages that the ingest job writes, with their contents."""
    inodes = _object_inodes(t)
    out = J.ingest(inodes.select(F.col("id").alias("seq"), "id"), inodes, _object_table(t), t.spark.createDataFrame([], schemas.PAGES))
    return out["pages"].select("inode_id", "index", F.md5("contents").alias("contents_md5"))


@query("index_job", V.with_views("msgs", "fx_inodes", "fx_pages", extra="""tgt AS (SELECT * FROM fx_inodes
  WHERE id IN (SELECT after_id FROM msgs WHERE routing_key = 'index_inode'))""" + ",\n" + V.docs_cte("tgt", "fx_pages", "nd"))
       + "SELECT doc_id, parent_id, kind, id, path, folder, index, emb_first FROM nd")
def q_index_job(t):
    out = J.index(_requests(t, ["index_inode"]), t.fx_inodes, t.fx_pages)
    return IX.flat_docs(out["new_docs"]).select("doc_id", "parent_id", "kind", "id", "path", "folder", "index",
                                                "emb_first")


@query("index_quarantine", V.with_views("msgs", "fx_inodes", "fx_pages") + """
SELECT CAST(p.inode_id AS VARCHAR) || '_' || CAST(p.index AS VARCHAR) AS doc_id, p.id AS page_id,
  'missing_embedding' AS reason
FROM fx_pages p WHERE length(p.contents) > 0 AND p.embedding IS NULL
  AND p.inode_id IN (SELECT after_id FROM msgs WHERE routing_key = 'index_inode')""")
def q_index_quarantine(t):
    out = J.index(_requests(t, ["index_inode"]), t.fx_inodes, t.fx_pages)
    return out["quarantine"].select("doc_id", "page_id", "reason")


@query("embed_job", V.with_views("msgs", "fx_inodes", "fx_pages", extra="""req AS (SELECT DISTINCT after_id AS id FROM msgs
  WHERE routing_key = 'embed_inode'),
sel AS (SELECT p.id FROM fx_pages p JOIN fx_inodes i ON i.id = p.inode_id
  WHERE i.id IN (SELECT id FROM req) AND p.index >= i.from_page AND p.index < i.to_page AND p.embedding IS NULL
    AND length(p.contents) > 0 AND i.error IS NULL)""") + """
SELECT i.id, i.is_embedded OR (i.id IN (SELECT id FROM req) AND i.error IS NULL) AS is_embedded,
  CAST((SELECT count(*) FROM sel JOIN fx_pages p ON p.id = sel.id WHERE p.inode_id = i.id) AS BIGINT) AS n_embedded
FROM fx_inodes i""")
def q_embed_job(t):
    out = J.embed(_requests(t, ["embed_inode"]), t.fx_inodes, t.fx_pages)
    filled = (out["vectors"].join(t.fx_pages.select("id", "inode_id"), "id")
              .groupBy(F.col("inode_id").alias("id")).agg(F.count(F.lit(1)).alias("n_embedded")))
    return (out["inodes"].join(filled, "id", "left")
            .select("id", "is_embedded", F.coalesce("n_embedded", F.lit(0)).cast("bigint").alias("n_embedded")))


REQUESTED = """req AS (SELECT DISTINCT after_id AS id FROM msgs WHERE routing_key = 'embed_inode'),
sel AS (SELECT p.id, p.inode_id, p.contents AS text,
    (row_number() OVER (PARTITION BY p.inode_id ORDER BY p.index, p.id) - 1) // 64 AS batch
  FROM fx_pages p JOIN fx_inodes i ON i.id = p.inode_id
  WHERE i.id IN (SELECT id FROM req) AND p.index >= i.from_page AND p.index < i.to_page AND p.embedding IS NULL
    AND length(p.contents) > 0 AND i.error IS NULL)"""
VECTOR_DIGEST = """round(coalesce((SELECT x FROM hv WHERE hv.id = s.id AND hv.b = 0), 0.0), 6) AS emb_first,
  round(coalesce((SELECT sum(x) FROM hv WHERE hv.id = s.id), 0.0), 6) AS emb_sum"""


def _vector_digest() -> list:
    return [F.round(F.col("embedding")[0].cast("double"), 6).alias("emb_first"),
            F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("emb_sum")]


@query("embed_vectors", V.with_views("msgs", "fx_inodes", "fx_pages", extra=REQUESTED + ",\n" + V.hashed_cte("sel"))
       + f"SELECT s.id, s.inode_id, {VECTOR_DIGEST} FROM sel s")
def q_embed_vectors(t):
    """The vectors that the embed job puts on pages."""
    out = J.embed(_requests(t, ["embed_inode"]), t.fx_inodes, t.fx_pages)
    new = t.fx_pages.where(needs_embedding("embedding")).select("id")
    return out["pages"].join(new, "id", "left_semi").where(F.col("embedding").isNotNull()).select("id", "inode_id", *_vector_digest())


def _odd_requests_fail(texts: list[str]) -> list[list[float]]:
    if len(texts) % 2:
        raise ConnectionError("no reply")
    return E.hashed_embedder(64)(texts)


@query("embed_stored", V.with_views("msgs", "fx_inodes", "fx_pages", extra=REQUESTED + ",\n" + V.hashed_cte("sel")) + f"""
SELECT s.id, s.inode_id, CAST(count(*) OVER (PARTITION BY s.inode_id, s.batch) % 2 AS INTEGER) AS run, {VECTOR_DIGEST} FROM sel s""")
def q_embed_stored(t):
    """Requests of an odd number of pages fail in the first run; the second
    sends only these, and every document gets its vectors."""
    store = work_dir(t.spark, "replies")
    J.embed(_requests(t, ["embed_inode"]), t.fx_inodes, t.fx_pages, embedder=_odd_requests_fail, store=store)
    J.embed(_requests(t, ["embed_inode"]), t.fx_inodes, t.fx_pages, embedder=E.hashed_embedder(64), store=store)
    return E.stored_vectors(t.spark, store).where(F.col("status") == "ok").select("id", "inode_id", "run", *_vector_digest())


@query("rebuild_index", V.with_views("fx_inodes", "fx_pages", extra=DOCS_ALL) + """
SELECT doc_id, parent_id, kind, id, owner_id, is_public, readable_by, path, type, folder, filename, index,
  contents_md5, emb_dim, emb_first FROM docs""")
def q_rebuild_index(t):
    return IX.flat_docs(_rebuild_docs(t))


# -- rows-only entries (no SQL equivalent) -----------------------------------------

@query("embed_udf", V.with_views("fx_inodes", "fx_pages", extra=SELECTION + ",\n" + V.hashed_cte("sel")) + """
SELECT s.id, s.inode_id, 'ok' AS status, CAST(64 AS INTEGER) AS emb_dim,
  round(coalesce((SELECT x FROM hv WHERE hv.id = s.id AND hv.b = 0), 0.0), 6) AS emb_first,
  round(coalesce((SELECT sum(x) FROM hv WHERE hv.id = s.id), 0.0), 6) AS emb_sum
FROM sel s""")
def q_embed_udf(t):
    """Python embedder through mapInPandas, 64 texts per request."""
    sel = E.embed_input(E.embed_selection(t.fx_inodes, t.fx_pages))
    out = E.embed_pages(E.request_batches(sel), E.hashed_embedder(64))
    return out.select("id", "inode_id", "status", F.size("embedding").alias("emb_dim"),
                      F.round(F.col("embedding")[0].cast("double"), 6).alias("emb_first"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
                      .alias("emb_sum"))


@query("extract_udf", V.with_views("fx_objects") + f"""
SELECT {V.object_path('owner_id', 'path')} AS key, CASE WHEN good THEN 1 END AS n_pages,
  CASE WHEN good THEN md5({_html_sql("substr(content, 9)")}) END AS text_md5,
  CASE WHEN NOT good THEN 'ValueError: ' || (CASE WHEN starts_with(content, '%PDF-') THEN 'truncated' ELSE 'not a PDF' END)
  END AS extract_error FROM (SELECT *, starts_with(content, '%PDF-') AND contains(lower(content), '</html>') AS good FROM fx_objects)""")
def q_extract_udf(t):
    """A supplied Python extractor over the object bytes (mapInPandas)."""
    out = X.extract_pages(_object_table(t), _python_html_extractor)
    return out.select("key", F.col("n_pages"), F.md5(F.col("texts")[0]).alias("text_md5"), "extract_error")


def _python_html_extractor(raw: bytes) -> list[str]:
    import html as _html
    import re as _re
    text = raw.decode("utf-8", "replace")
    if not text.startswith("%PDF-"):
        raise ValueError("not a PDF")
    if "</html>" not in text.lower():
        raise ValueError("truncated")
    body = _re.sub(r"(?is)<(script|style)[^>]*>.*?</\1\s*>|<!--.*?-->", " ", text[8:])
    return [" ".join(_html.unescape(_re.sub(r"<[^>]*>", " ", body)).split())]


@query("knn_approx", V.with_views("fx_pages", "fx_prompts", extra=KNN) + """
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(sqrt(d2), 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 9), id) AS rank FROM pd) WHERE rank <= 10""")
def q_knn_approx(t):
    """Cell search that probes every cell, so its result is the exact one
    (fewer probes trade recall for work; see the recall test)."""
    out = K.knn_approx(t.fx_prompts, t.fx_pages, k=10, cells=16, nprobe=16, seed=42)
    return out.select("qid", F.col("vid").alias("id"), F.col("rank").cast("int").alias("rank"),
                      F.round("distance", 6).alias("distance"))


@query("read_objects", V.with_views("fx_objects") + f"""
SELECT {V.object_path('owner_id', 'path')} AS key, CAST(octet_length(encode(content)) AS BIGINT) AS length,
  md5(content) AS content_md5 FROM fx_objects""")
def q_read_objects(t):
    """Objects written once as files under their real keys and read back with
    the binaryFile source."""
    from ..session import work_dir
    from ..sources.objects import read_objects
    root = work_dir(t.spark, "objects")
    # One folder per key; Spark escapes the key in its name and ends the text with a line break.
    (_object_table(t).select(F.col("key").alias("k"), F.col("content").cast("string").alias("value"))
     .write.partitionBy("k").text(root))
    bytes_ = F.expr("substring(content, 1, int(length) - 1)")
    return read_objects(t.spark, root, glob="*.txt").select(
        F.url_decode(F.regexp_extract("key", "k=([^/]*)/", 1)).alias("key"), (F.col("length") - 1).alias("length"),
        F.md5(bytes_).alias("content_md5"))


# The feed's net effect in SQL: when each inode is ingested, moved, embedded and indexed
# for the first time, and what every message finds at its place in the feed.
FEED_CTE = V.resolved_cte() + """,
o AS (SELECT id, content, row_number() OVER (ORDER BY id) - 1 AS at, count(*) OVER () AS n FROM fx_objects),
f AS (SELECT greatest(999999, max(id)) + 1 AS first FROM fx_inodes),
i AS (SELECT id, owner_id, type, path, is_public, is_uploaded, is_ingested, is_embedded, is_indexed, from_page, to_page, error,
    CAST(NULL AS VARCHAR) AS content FROM fx_inodes
  UNION ALL SELECT x.id - 500000 + first, x.owner_id, type, path, is_public, is_uploaded, is_ingested, is_embedded, is_indexed, from_page,
    to_page, error, content FROM fx_object_inodes x JOIN o ON o.id = x.id - 500000, f),
m AS (SELECT seq, routing_key AS task, CASE WHEN routing_key = 'delete_inode' THEN before_id
    WHEN routing_key = 'ingest_inode' AND after_id <> 999999 THEN first + o.id ELSE after_id END AS id
  FROM msgs LEFT JOIN o ON o.at = (seq * 7919) % o.n, f),
e AS (SELECT id, min(seq) AS gone FROM m WHERE task = 'delete_inode' GROUP BY id),
a AS (SELECT m.*, i.id IS NOT NULL AND (gone IS NULL OR seq < gone) AS alive FROM m LEFT JOIN i ON i.id = m.id LEFT JOIN e ON e.id = m.id),
v AS (SELECT i.id, min(seq) FILTER (WHERE task = 'ingest_inode') AS ingest_at, min(seq) FILTER (WHERE task = 'move_inode'
    AND r.path IS NOT NULL AND r.path IS DISTINCT FROM i.path) AS move_at, any_value(r.path) AS new_path
  FROM i LEFT JOIN resolved r ON r.id = i.id LEFT JOIN a ON a.id = i.id AND alive GROUP BY i.id),
w AS (SELECT i.* EXCLUDE (error, to_page), ingest_at, move_at, new_path, gone,
  CASE WHEN ingest_at IS NULL THEN error WHEN NOT starts_with(content, '%PDF-') THEN 'unsupported_file_type'
    WHEN NOT contains(lower(content), '</html>') THEN 'corrupted_file' ELSE error END AS error,
  content IS NOT NULL AND ingest_at IS NOT NULL AND starts_with(content, '%PDF-') AND contains(lower(content), '</html>') AS paged,
  CASE WHEN content IS NULL THEN to_page ELSE coalesce(nullif(to_page, 0), 1) END AS to_page
  FROM i JOIN v ON v.id = i.id LEFT JOIN e ON e.id = i.id),
p AS (SELECT inode_id, index, contents, embedding IS NOT NULL AS filled FROM fx_pages WHERE length(contents) > 0
  UNION ALL SELECT * FROM (SELECT id, from_page, HTML AS contents, false FROM (SELECT id, from_page, regexp_replace(content, '^%PDF-[0-9.]*', '') AS body
    FROM w WHERE paged)) WHERE length(contents) > 0),
q AS (SELECT inode_id AS id, bool_or(NOT filled) AS open, bool_or(NOT filled AND NOT coalesce(index >= from_page AND index < to_page, false)) AS open_after
  FROM p JOIN w ON w.id = inode_id GROUP BY inode_id),
b AS (SELECT a.seq, a.id, w.error FROM a JOIN w ON w.id = a.id WHERE alive AND task IN ('embed_inode', 'ingest_inode')),
g AS (SELECT id, min(seq) AS embed_at FROM b WHERE error IS NULL GROUP BY id),
x AS (SELECT seq, id FROM b WHERE error IS NULL UNION ALL SELECT a.seq, a.id FROM a JOIN w ON w.id = a.id
  WHERE alive AND (task IN ('index_inode', 'share_inode') OR task = 'move_inode' AND seq = move_at)),
y AS (SELECT seq, x.id, coalesce(CASE WHEN embed_at <= seq THEN open_after ELSE open END, false) AS open
  FROM x LEFT JOIN q ON q.id = x.id LEFT JOIN g ON g.id = x.id),
h AS (SELECT id, min(seq) AS index_at FROM y WHERE NOT open GROUP BY id),
z AS (SELECT w.*, embed_at, index_at FROM w LEFT JOIN g ON g.id = w.id LEFT JOIN h ON h.id = w.id),
n AS (SELECT seq, 0 AS step, id FROM a WHERE alive AND task = 'ingest_inode' UNION ALL SELECT seq, 1, id FROM b WHERE error IS NULL
  UNION ALL SELECT seq, 2, id FROM y WHERE NOT open),
d AS (SELECT z.*, EXISTS (SELECT 1 FROM x WHERE x.id = z.id) AS seen FROM z WHERE gone IS NULL)
""".replace("HTML", _html_sql("body"))
FEED_DOCS = """SELECT 'doc' AS kind, id, CAST(id AS VARCHAR) || ' ' || CASE WHEN move_at IS NULL THEN path ELSE new_path END AS detail FROM d WHERE seen
UNION ALL SELECT 'doc', id, CAST(id AS VARCHAR) || '_' || CAST(index AS VARCHAR) || ' ' || md5(contents) FROM d JOIN p ON p.inode_id = d.id
  WHERE seen AND (filled OR (embed_at IS NOT NULL AND index >= from_page AND index < to_page))"""


def _feed_world(t, name: str):
    """A seeded store, its feed and objects.  Ingest messages name inodes of the fixture
    objects, which get ids behind all others; those for the missing inode (999999) stay."""
    from ..session import work_dir
    from ..streaming.feed import FeedTables, seed_store
    root = work_dir(t.spark, name)
    missing = 999999
    first = max(missing, t.fx_inodes.agg(F.max("id")).first()[0] or 0) + 1
    at = global_positions(t.fx_objects.select("id"), ["id"], "_at").select(
        F.col("_at").alias("_object"), (F.col("id") + first).alias("_inode"))
    n = max(t.fx_objects.count(), 1)
    named = F.get_json_object("body", "$.after.id").cast("bigint")
    ingests = (F.col("routing_key") == "ingest_inode") & (named != missing)
    body = F.when(ingests & F.col("_inode").isNotNull(), F.concat(F.lit('{"after": {"id": '), F.col("_inode"), F.lit("}}"))).otherwise(F.col("body"))
    feed = (t.fx_messages.withColumn("_object", (F.col("seq") * 7919) % n)
            .join(at, "_object", "left").select("seq", "ts", "routing_key", body.alias("body")))
    held = _object_inodes(t).withColumn("id", F.col("id") - 500000 + first)
    inodes = apply_defaults(t.fx_inodes.unionByName(held, allowMissingColumns=True), "inodes", now=NOW)
    store = FeedTables(t.spark, f"{root}/tables")
    seed_store(store, inodes, t.fx_pages)
    return root, store, feed


def _feed_docs(store) -> DataFrame:
    # Only a text's hash is shown: it is taken before the changes are folded.
    docs = store.read("docs", prepare=lambda rows: rows.withColumn("contents", F.md5("contents")))
    return docs.select(F.lit("doc").alias("kind"), F.coalesce("parent_id", "doc_id").cast("bigint").alias("id"),
                       F.concat_ws(" ", "doc_id", F.coalesce("path", "contents")).alias("detail"))


@query("run_feed", V.with_views("fx_object_inodes", "msgs", "fx_inodes", "fx_pages", recursive=True, extra=FEED_CTE) + FEED_DOCS + """
UNION ALL SELECT 'followup', seq, 'embed_inode' FROM a WHERE alive AND task = 'ingest_inode'
UNION ALL SELECT 'followup', seq, 'index_inode' FROM b WHERE error IS NULL
UNION ALL SELECT 'followup', seq, 'index_inode' FROM a JOIN z ON z.id = a.id WHERE alive AND (task = 'share_inode' OR task = 'move_inode' AND seq = move_at)
UNION ALL SELECT 'notification', seq, CASE WHEN is_public THEN 'public' ELSE 'user-' || CAST(owner_id AS VARCHAR) END FROM n JOIN z ON z.id = n.id
  WHERE coalesce(error, '') <> '' OR (is_uploaded AND (is_ingested OR coalesce(ingest_at <= seq, false))
    AND (is_embedded OR coalesce(embed_at < seq OR (embed_at = seq AND step >= 1), false))
    AND (is_indexed OR coalesce(index_at < seq OR (index_at = seq AND step = 2), false)))
UNION ALL SELECT 'dead_letter', seq, 'unknown_key' FROM m WHERE task = 'unknown_key'
UNION ALL SELECT 'dead_letter', seq, 'missing_inode' FROM a WHERE NOT alive AND task NOT IN ('unknown_key', 'delete_inode')
UNION ALL SELECT 'dead_letter', seq, 'errored_inode' FROM b WHERE error IS NOT NULL
UNION ALL SELECT 'dead_letter', seq, 'missing_embedding' FROM y WHERE open""")
def q_run_feed(t):
    """The whole feed through the streaming worker (two ranges of messages), from the
    fixture tables and their objects: the final index documents and every follow-up,
    notification and dead letter of the run."""
    from ..streaming.feed import run_feed, write_feed
    root, store, feed = _feed_world(t, "feed")
    files = write_feed(feed, f"{root}/in", files=2)
    run_feed(t.spark, f"{root}/in", store.root, f"{root}/checkpoint", objects=_object_table(t), max_files=files)
    out = _feed_docs(store)
    for kind, name, detail in (("followup", "followups", "routing_key"), ("notification", "notifications", "channel"),
                               ("dead_letter", "dead_letters", "reason")):
        out = out.unionByName(store.output(name).select(F.lit(kind).alias("kind"), F.col("seq").alias("id"), F.col(detail).alias("detail")))
    return out


@query("run_feed_workers", V.with_views("fx_object_inodes", "msgs", "fx_inodes", "fx_pages", recursive=True, extra=FEED_CTE) + FEED_DOCS)
def q_run_feed_workers(t):
    """Two workers on one store, as the reference runs them: one takes the ingest queue
    and publishes the follow-ups, the other takes the rest.  Then a third, with a
    checkpoint of its own, takes the whole feed again.  The documents are those of one
    worker's single run."""
    from ..streaming.feed import run_feed, write_feed
    root, store, feed = _feed_world(t, "workers")
    files = write_feed(feed, f"{root}/in", files=1)
    others = [k for k in schemas.ROUTING_KEYS if k != "ingest_inode"]
    objects = _object_table(t)
    run_feed(t.spark, f"{root}/in", store.root, f"{root}/ingest", objects=objects, max_files=files, keys=["ingest_inode"], publish_dir=f"{root}/next")
    run_feed(t.spark, f"{root}/in", store.root, f"{root}/default", max_files=files, keys=others)
    run_feed(t.spark, f"{root}/next", store.root, f"{root}/next-default", max_files=1000, keys=others)
    run_feed(t.spark, f"{root}/in", store.root, f"{root}/again", objects=objects, max_files=files)
    return _feed_docs(store)


# -- connectors (O-S10 batch form, O-S14) ------------------------------------------

@query("read_feed", V.with_views("msgs") + """
SELECT seq, routing_key, after_id, before_id, coalesce(after_id, before_id) AS id FROM msgs""")
def q_read_feed(t):
    """The feed written as JSON-lines files and read back by the batch feed
    reader with its fixed schema."""
    from ..session import work_dir
    from ..sources.feed import read_feed
    from ..streaming.feed import write_feed
    path = work_dir(t.spark, "feed-json")
    write_feed(t.fx_messages.select("seq", "ts", "routing_key", "body"), path, files=4)
    return decode_messages(read_feed(t.spark, path)).select("seq", "routing_key", "after_id", "before_id", "id")


@query("read_table", V.with_views("fx_inodes") + """
SELECT id, CAST(owner_id AS VARCHAR) AS owner_id, type, path, parent_id, to_page, error,
  is_indexed AND is_uploaded AND is_ingested AND is_embedded AS is_ready FROM fx_inodes""")
def q_read_table(t):
    """Inodes stored as a versioned Parquet table and read back with the
    table's explicit schema (the JDBC reader returns the same shape)."""
    from ..session import work_dir
    from ..sources.tables import read_table, write_table
    base = work_dir(t.spark, "tables")
    write_table(apply_defaults(t.fx_inodes, "inodes", now=NOW), "inodes", base, 1)
    df = read_table(t.spark, "inodes/v00000001", base)
    return df.select("id", "owner_id", "type", "path", "parent_id", "to_page", "error", is_ready().alias("is_ready"))


# -- relations: navigations, deletions over the declared keys, audits of all tables -------

REL = {
    "fx_conversations": """SELECT DISTINCT conv_id AS id, conv_id % 25 AS owner_id,
  CASE WHEN conv_id % 9 = 0 THEN 'completion_context_exceeded' END AS error FROM {conversations}""",
    "fx_sources": """SELECT q.id AS prompt_id, p.id AS page_id, CAST(0.5 AS DOUBLE) AS similarity FROM {fx_prompts} q
  JOIN {fx_conversations_inodes} l ON l.conversation_id = q.conversation_id JOIN {fx_pages} p ON p.inode_id = l.inode_id""",
    "fx_conversations_bad": """SELECT id, CASE WHEN id % 19 = 0 THEN 555000 + id WHEN id % 17 = 0 THEN NULL ELSE owner_id END AS owner_id,
  CASE WHEN id % 13 = 0 THEN 'odd' ELSE error END AS error FROM {fx_conversations}
UNION ALL SELECT id, owner_id, error FROM {fx_conversations} WHERE id % 31 = 0""",
    "fx_prompts_bad": """SELECT id, CASE WHEN id % 23 = 0 THEN 66000000 + id ELSE conversation_id END AS conversation_id,
  CASE WHEN id % 29 = 0 THEN NULL ELSE query END AS query, CASE WHEN id % 37 = 0 THEN 'odd' END AS error FROM {fx_prompts}""",
    "fx_sources_bad": """SELECT prompt_id, CASE WHEN page_id % 41 = 0 THEN 99000000 ELSE page_id END AS page_id,
  CASE WHEN (prompt_id + page_id) % 43 = 0 THEN NULL ELSE similarity END AS similarity FROM {fx_sources}""",
}
REL_NEEDS = {"fx_conversations": ["conversations"], "fx_sources": ["fx_prompts", "fx_conversations_inodes", "fx_pages"],
             "fx_conversations_bad": ["fx_conversations"], "fx_prompts_bad": ["fx_prompts"], "fx_sources_bad": ["fx_sources"]}


class _Slots(dict):
    def __missing__(self, key):
        return key


def _rel_ctes(*names: str) -> str:
    """The views as CTEs for DuckDB, in the order given."""
    return ",\n".join(f"{n} AS ({REL[n].format_map(_Slots())})" for n in names)


def _rel(t, name: str) -> DataFrame:
    if name not in REL:
        return getattr(t, name)
    return _sql(t.spark, REL[name], **{n: _rel(t, n) for n in REL_NEEDS[name]})


def _rel_tables(t) -> dict[str, DataFrame]:
    return {"users": t.fx_users, "conversations": _rel(t, "fx_conversations"), "inodes": t.fx_inodes, "pages": t.fx_pages,
            "prompts": t.fx_prompts, "conversations_inodes": t.fx_conversations_inodes, "sources": _rel(t, "fx_sources")}


REL_VIEWS = ("fx_users", "fx_inodes", "fx_pages", "fx_prompts", "fx_conversations_inodes")
GONE = """gc AS (SELECT id FROM fx_conversations WHERE CONVERSATIONS),
gi(id) AS (SELECT id FROM fx_inodes WHERE INODES UNION SELECT c.id FROM fx_inodes c JOIN gi ON c.parent_id = gi.id),
gp AS (SELECT id FROM fx_pages WHERE inode_id IN (SELECT id FROM gi)),
gq AS (SELECT id FROM fx_prompts WHERE conversation_id IN (SELECT id FROM gc))"""
GONE_ROWS = """SELECT 'conversations' AS kind, CAST(id AS VARCHAR) AS key1, CAST(NULL AS VARCHAR) AS key2 FROM gc
UNION ALL SELECT 'inodes', CAST(id AS VARCHAR), NULL FROM gi UNION ALL SELECT 'pages', CAST(id AS VARCHAR), NULL FROM gp
UNION ALL SELECT 'prompts', CAST(id AS VARCHAR), NULL FROM gq
UNION ALL SELECT DISTINCT 'conversations_inodes', CAST(conversation_id AS VARCHAR), CAST(inode_id AS VARCHAR) FROM fx_conversations_inodes
  WHERE conversation_id IN (SELECT id FROM gc) OR inode_id IN (SELECT id FROM gi)
UNION ALL SELECT DISTINCT 'sources', CAST(prompt_id AS VARCHAR), CAST(page_id AS VARCHAR) FROM fx_sources
  WHERE prompt_id IN (SELECT id FROM gq) OR page_id IN (SELECT id FROM gp)"""


@query("cascade_conversations", V.with_views(*REL_VIEWS, recursive=True, extra=_rel_ctes("fx_conversations", "fx_sources") + ",\n"
       + GONE.replace("CONVERSATIONS", "id % 7 = 0").replace("INODES", "false")) + GONE_ROWS)
def q_cascade_conversations(t):
    """Conversations go, and with them their prompts, the prompts' sources and the links to files."""
    tables = _rel_tables(t)
    return R.cascade(tables, "conversations", tables["conversations"].where("id % 7 = 0").select("id"))


@query("cascade_users", V.with_views(*REL_VIEWS, recursive=True, extra=_rel_ctes("fx_conversations", "fx_sources") + ",\n"
       + GONE.replace("CONVERSATIONS", "owner_id IN (SELECT id FROM fx_users WHERE id % 5 = 0)")
       .replace("INODES", "owner_id IN (SELECT id FROM fx_users WHERE id % 5 = 0)")) + GONE_ROWS + """
UNION ALL SELECT 'users', CAST(id AS VARCHAR), NULL FROM fx_users WHERE id % 5 = 0""")
def q_cascade_users(t):
    """Users go with everything they own."""
    tables = _rel_tables(t)
    return R.cascade(tables, "users", tables["users"].where("id % 5 = 0").select("id"), owned=True)


@query("navigations", V.with_views(*REL_VIEWS, extra=_rel_ctes("fx_conversations", "fx_sources")) + """
SELECT 'user_conversations' AS nav, u.id AS a, c.id AS b FROM fx_users u JOIN fx_conversations c ON c.owner_id = u.id
UNION ALL SELECT 'user_inodes', u.id, i.id FROM fx_users u JOIN fx_inodes i ON i.owner_id = u.id
UNION ALL SELECT 'conversation_files', l.conversation_id, i.id FROM fx_conversations_inodes l JOIN fx_inodes i ON i.id = l.inode_id
UNION ALL SELECT 'conversation_prompts', c.id, q.id FROM fx_conversations c JOIN fx_prompts q ON q.conversation_id = c.id
UNION ALL SELECT 'inode_pages', i.id, p.id FROM fx_inodes i JOIN fx_pages p ON p.inode_id = i.id
UNION ALL SELECT 'prompt_sources', s.prompt_id, p.inode_id FROM fx_sources s JOIN fx_prompts q ON q.id = s.prompt_id
  JOIN fx_pages p ON p.id = s.page_id JOIN fx_inodes i ON i.id = p.inode_id""")
def q_navigations(t):
    tables = _rel_tables(t)
    navs = {"user_conversations": ("user_id", "conversation_id"), "user_inodes": ("user_id", "inode_id"),
            "conversation_files": ("conversation_id", "inode_id"), "conversation_prompts": ("conversation_id", "prompt_id"),
            "inode_pages": ("inode_id", "page_id"), "prompt_sources": ("prompt_id", "inode_id")}
    parts = [getattr(R, n)(tables).select(F.lit(n).alias("nav"), F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
             for n, (a, b) in navs.items()]
    return reduce(DataFrame.unionByName, parts)


BAD = {"users": "fx_users", "conversations": "fx_conversations_bad", "inodes": "fx_inodes_bad", "pages": "fx_pages_bad",
       "prompts": "fx_prompts_bad", "conversations_inodes": "fx_links_bad", "sources": "fx_sources_bad"}


def _key_sql(table: str) -> str:
    return " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in R.PRIMARY_KEYS[table])


def _audit_sql() -> str:
    held = {"users": ["id", "name", "email"], "conversations": ["id", "owner_id", "error"], "prompts": ["id", "conversation_id", "query", "error"],
            "inodes": ["id", *NN_INODES, "error"], "pages": ["id", *NN_PAGES], "conversations_inodes": R.PRIMARY_KEYS["conversations_inodes"],
            "sources": ["prompt_id", "page_id", "similarity"]}
    parts = [f"SELECT 'foreign_key' AS rule, '{k.child}' AS tbl, '{k.column}' AS col, {_key_sql(k.child)} AS key FROM {BAD[k.child]} c "
             f"WHERE {k.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {BAD[k.parent]} p WHERE p.id = c.{k.column})" for k in R.FOREIGN_KEYS]
    parts += [f"SELECT 'primary_key', '{t}', '{','.join(keys)}', {_key_sql(t)} FROM {BAD[t]} GROUP BY {', '.join(keys)} HAVING count(*) > 1"
              for t, keys in R.PRIMARY_KEYS.items()]
    for (t, c), domain in schemas.ENUMS.items():
        parts.append(f"SELECT 'enum', '{t}', '{c}', {_key_sql(t)} FROM {BAD[t]} WHERE {c} NOT IN ({', '.join(repr(d) for d in domain)})")
    for t in BAD:
        parts += [f"SELECT 'not_null', '{t}', '{c}', {_key_sql(t)} FROM {BAD[t]} WHERE {c} IS NULL"
                  for c in schemas.not_null_columns(t) if c in held[t]]
    return "\nUNION ALL ".join(parts)


@query("audit_tables", V.with_views("fx_users", "fx_inodes_bad", "fx_pages_bad", "fx_links_bad", "fx_prompts", extra=_rel_ctes(
    "fx_conversations", "fx_sources", "fx_conversations_bad", "fx_prompts_bad", "fx_sources_bad")) + _audit_sql())
def q_audit_tables(t):
    """All nine foreign keys, seven primary keys, four enums and every NOT NULL column, over tables
    with seeded violations."""
    tables = {name: _rel(t, view) for name, view in BAD.items()}
    return R.all_orphans(tables).unionByName(R.all_duplicates(tables)).unionByName(R.all_bad_values(tables))


@query("folder_sizes", V.with_views("fx_inodes", recursive=True, extra="""d(top, id) AS (SELECT id, id FROM fx_inodes
  UNION ALL SELECT d.top, c.id FROM d JOIN fx_inodes c ON c.parent_id = d.id)""") + "SELECT top AS id, count(*) - 1 AS n_below FROM d GROUP BY top")
def q_folder_sizes(t):
    """How many inodes lie below each: half of its interval in the walk through the tree."""
    return tree_intervals(t.fx_inodes).select("id", ((F.col("leave") - F.col("enter") - 1) / 2).cast("bigint").alias("n_below"))


@query("subtree_docs", V.with_views("fx_inodes", "fx_pages", recursive=True, extra=DOCS_ALL + """,
d(id) AS (SELECT id FROM fx_inodes WHERE id = 2 UNION ALL SELECT c.id FROM fx_inodes c JOIN d ON c.parent_id = d.id)""") + """
SELECT doc_id, kind FROM docs WHERE coalesce(parent_id, doc_id) IN (SELECT CAST(id AS VARCHAR) FROM d)""")
def q_subtree_docs(t):
    """Documents of the folder 'src1' and all below it by the tree, stale paths notwithstanding."""
    return IX.in_subtree(_rebuild_docs(t), tree_intervals(t.fx_inodes), 2).select("doc_id", "kind")


# -- retrieval: visibility, token limit, product quantisation ------------------------------

@query("visible_sources", V.with_views("fx_inodes", "fx_pages", "fx_prompts", "fx_conversations_inodes", extra=_rel_ctes("fx_conversations") + """,
sc AS (SELECT q.id AS qid, p.id, list_sum(list_transform(range(1, len(q.embedding) + 1),
  lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(p.embedding[i] AS DOUBLE)) ** 2)) AS d2
  FROM fx_prompts q JOIN fx_conversations_inodes l ON l.conversation_id = q.conversation_id JOIN fx_pages p ON p.inode_id = l.inode_id
  JOIN fx_inodes i ON i.id = l.inode_id JOIN fx_conversations c ON c.id = q.conversation_id
  WHERE q.embedding IS NOT NULL AND p.embedding IS NOT NULL AND length(p.contents) > 0 AND (i.is_public OR i.owner_id = c.owner_id))""") + """
SELECT qid AS prompt_id, id AS page_id, CAST(rank AS INTEGER) AS rank, round(1.0 / (1.0 + d2), 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d2, 9), id) AS rank FROM sc) WHERE rank <= 5""")
def q_visible_sources(t):
    """Sources among the pages that the conversation's owner may read."""
    return retrieve_sources(t.fx_prompts, t.fx_pages, t.fx_conversations_inodes, inodes=t.fx_inodes, conversations=_rel(t, "fx_conversations")).withColumn(
        "similarity", F.round("similarity", 6))


TOKEN_LIMIT = 100


class _Pieces:
    """A small tokenizer: letters, digits or single other characters, each with the space before it."""

    def encode(self, text: str) -> list:
        import re
        return re.findall(" ?(?:[a-zA-Z]+|[0-9]|[^a-zA-Z0-9])", text, re.S)

    def decode(self, pieces: list) -> str:
        return "".join(pieces)


@query("truncate_tokenizer", f"""
SELECT doc_id, md5(array_to_string(list_slice(p, 1, {TOKEN_LIMIT}), '')) AS text_md5, CAST(least(len(p), {TOKEN_LIMIT}) AS INTEGER) AS n_tokens
FROM (SELECT doc_id, regexp_extract_all({V.squash('text')}, '(?s) ?(?:[a-zA-Z]+|[0-9]|[^a-zA-Z0-9])') AS p FROM documents)""")
def q_truncate_tokenizer(t):
    """The model's token limit with a supplied tokenizer, set once per task."""
    cut = E.truncate_pages(t.documents, _Pieces, TOKEN_LIMIT, text_col="text")
    return cut.select("doc_id", F.md5("text").alias("text_md5"), "n_tokens")


@query("knn_pq", V.with_views("fx_prompts") + """
SELECT id AS qid, CAST(10 AS BIGINT) AS n_found, true AS recall_90, true AS under_30_percent FROM fx_prompts WHERE embedding IS NOT NULL""")
def q_knn_pq(t):
    """Approximate search over product-quantised codes: per prompt the rows it found, with
    what the whole search reached: recall of the exact answer, share of rows whose vector was read."""
    pages = materialize(t.fx_pages.where(F.col("embedding").isNotNull()).select("id", "embedding"), "page-vectors")
    prompts = materialize(t.fx_prompts.where(F.col("embedding").isNotNull()).select("id", "embedding"), "prompt-vectors")
    codec = PQ.fit(pages)
    rows = pages.count()
    rerank = max(10, min(200, rows // 5))       # a fifth of a small table
    found, scored = PQ.search(prompts, pages, materialize(PQ.encode(pages, codec), "codes"), codec, k=10, rerank=rerank)
    found = materialize(found, "found")
    hit = PQ.recall(found, K.knn_exact(prompts, pages, k=10)).agg((F.sum("n_hit") / F.sum("n_exact")).alias("recall"))
    share = scored.agg((F.count(F.lit(1)) / F.lit(float(max(1, rows * prompts.count())))).alias("share"))
    reached, read = hit.first()[0], share.first()[0]
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("n_found")).select(
        "qid", "n_found", F.lit(reached >= 0.9).alias("recall_90"), F.lit(read < 0.3).alias("under_30_percent"))
