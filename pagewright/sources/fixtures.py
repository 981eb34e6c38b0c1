"""Fixture views of FIXTURES.md, computed by Spark from the test tables.

The SQL below is the fixture definition (shared with the DuckDB oracle); only
the two dialect tokens differ.  Each view grows with the base tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def _sql(spark, query: str, **frames: DataFrame) -> DataFrame:
    """Run fixture SQL whose ``{name}`` slots name the given frames; each
    frame is registered under a unique temporary view name."""
    names = {}
    for key, df in frames.items():
        names[key] = f"_pw_{key}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(names[key])
    return spark.sql(query.format(**names))


def fx_users(t) -> DataFrame:
    return _sql(t.spark, 
        """SELECT c_custkey AS id, c_name AS name,
                  concat(lower(replace(c_name, '#', '.')), '@example.org') AS email
           FROM {customer}""", customer=t.customer)


def fx_inodes(t) -> DataFrame:
    return _sql(t.spark, 
        """
WITH f AS (SELECT doc_id, text, source, lang, CAST(substr(source, 4) AS bigint) AS sn,
  CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS ln FROM {documents})
SELECT DISTINCT sn + 1 AS id, CAST(NULL AS bigint) AS parent_id, sn AS owner_id, 'folder' AS type,
  source AS name, concat('/', source) AS path, sn % 5 = 0 AS is_public, true AS is_uploaded,
  true AS is_ingested, true AS is_embedded, false AS is_indexed, 0 AS from_page,
  CAST(NULL AS int) AS to_page, CAST(NULL AS string) AS error FROM f
UNION ALL SELECT DISTINCT 100 + (sn + 1) * 10 + ln, sn + 1, sn, 'folder', lang, concat('/', source, '/',
  lang), sn % 5 = 0, true, true, true, false, 0, CAST(NULL AS int), CAST(NULL AS string) FROM f
UNION ALL SELECT 1000 + doc_id, 100 + (sn + 1) * 10 + ln, sn, 'file', concat(doc_id, '.pdf'),
  CASE WHEN doc_id % 10 = 0 THEN concat('/old/', doc_id, '.pdf') ELSE concat('/', source, '/', lang, '/',
  doc_id, '.pdf') END, doc_id % 5 = 0, true, true, doc_id % 3 <> 0, doc_id % 4 <> 0,
  CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(ceil(length(text)/1000) AS int) END,
  CASE WHEN doc_id % 50 = 49 THEN 'corrupted_file' END FROM f
""", documents=t.documents)


def fx_pages(t) -> DataFrame:
    # The embeddings count is a scalar subquery (one value, planned once).
    return _sql(t.spark, 
        """
WITH p AS (SELECT doc_id, text, explode(sequence(0, CAST(ceil(length(text)/1000) AS int) - 1)) AS k
           FROM {documents}),
 q AS (SELECT (1000 + doc_id) * 1000 + k AS id, 1000 + doc_id AS inode_id,
  CAST(CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END + k AS int) AS index,
  CASE WHEN (doc_id + k) % 11 = 0 THEN '' ELSE substr(text, k * 1000 + 1, 1000) END AS contents,
  ((1000 + doc_id) * 1000 + k) % (SELECT count(*) FROM {embeddings}) AS vec_key FROM p)
SELECT q.id, q.inode_id, q.index, q.contents,
  CASE WHEN q.id % 13 <> 0 THEN e.embedding END AS embedding
FROM q JOIN {embeddings} e ON e.vec_id = q.vec_key
""", documents=t.documents, embeddings=t.embeddings)


def fx_objects(t) -> DataFrame:
    return _sql(t.spark, 
        """SELECT page_id AS id, page_id % 20 AS owner_id, concat('/web/', page_id, '.html') AS path,
                  CASE WHEN page_id % 2 = 0 THEN concat('%PDF-1.7', html) ELSE html END AS content
           FROM {pages}""", pages=t.pages)


def fx_messages(t) -> DataFrame:
    return _sql(t.spark, 
        """
WITH m AS (SELECT event_id AS seq, ts, user_id,
  CASE WHEN event_id % 97 = 0 THEN 999999 WHEN event_id % 10 = 0 THEN 1000 + CAST(get_json_object(props, '$.k') AS bigint)
    ELSE 1000 + (event_id * 7919) % (SELECT count(*) FROM {documents}) END AS id,
  CASE event_type WHEN 'signup' THEN 'ingest_inode' WHEN 'view' THEN 'embed_inode'
    WHEN 'click' THEN 'index_inode'
    WHEN 'purchase' THEN CASE user_id % 3 WHEN 0 THEN 'move_inode' WHEN 1 THEN 'share_inode'
      ELSE 'delete_inode' END
    ELSE 'unknown_key' END AS routing_key FROM {events})
SELECT m.seq, m.ts, m.routing_key,
  CASE WHEN m.routing_key = 'delete_inode'
    THEN concat('{{"before": {{"id": ', m.id, ', "type": "file", "owner_id": "',
      coalesce(cast(i.owner_id as string), ''), '", "path": "', coalesce(i.path, ''), '"}}}}')
    ELSE concat('{{"after": {{"id": ', m.id, '}}}}') END AS body
FROM m LEFT JOIN {inodes} i ON i.id = m.id
""", events=t.events, documents=t.documents, inodes=fx_inodes(t).select("id", "owner_id", "path"))


def fx_prompts(t) -> DataFrame:
    return _sql(t.spark, 
        """
WITH u AS (SELECT conv_id, turn, text, (conv_id * 100 + turn) % (SELECT count(*) FROM {embeddings}) AS vec_key
           FROM {conversations} WHERE role = 'user')
SELECT u.conv_id * 100 + u.turn AS id, u.conv_id AS conversation_id, u.text AS query, a.text AS response,
  e.embedding
FROM u
LEFT JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
JOIN {embeddings} e ON e.vec_id = u.vec_key
""", conversations=t.conversations, embeddings=t.embeddings)


def fx_conversations_inodes(t) -> DataFrame:
    return _sql(t.spark, 
        """SELECT DISTINCT conv_id AS conversation_id, 1000 + (conv_id * 7) % (SELECT count(*) FROM {documents}) AS inode_id
           FROM {conversations}""", conversations=t.conversations, documents=t.documents)


# Seeded violations for the audits; the same SQL runs on both engines (``SLICE``
# is the one dialect token).
BAD_INODES = """SELECT id, CASE WHEN id % 43 = 0 THEN 77000000 + id ELSE parent_id END AS parent_id, owner_id,
  CASE WHEN id % 47 = 0 THEN 'link' ELSE type END AS type, CASE WHEN id % 37 = 0 THEN '  ' ELSE name END AS name,
  CASE WHEN id % 59 = 0 THEN NULL ELSE path END AS path, is_public, is_uploaded, is_ingested, is_embedded, is_indexed,
  CASE WHEN id % 61 = 0 THEN NULL ELSE from_page END AS from_page, to_page,
  CASE WHEN id % 53 = 0 THEN 'lost' ELSE error END AS error FROM {inodes}
UNION ALL SELECT id, parent_id, owner_id, type, name, upper(path), is_public, is_uploaded, is_ingested, is_embedded,
  is_indexed, from_page, to_page, error FROM {inodes} WHERE id % 41 = 0"""
BAD_PAGES = """SELECT id, CASE WHEN id % 73 = 0 THEN 88000000 + id ELSE inode_id END AS inode_id, index,
  CASE WHEN id % 79 = 0 THEN NULL ELSE contents END AS contents,
  CASE WHEN id % 83 = 0 THEN SLICE(embedding, 1, 63) ELSE embedding END AS embedding FROM {pages}
UNION ALL SELECT id, inode_id, index, contents, embedding FROM {pages} WHERE id % 71 = 0"""
BAD_LINKS = """SELECT conversation_id, CASE WHEN (conversation_id + inode_id) % 7 = 0 THEN 99000000 ELSE inode_id END AS inode_id
FROM {links} UNION ALL SELECT conversation_id, inode_id FROM {links} WHERE conversation_id % 5 = 0"""


def fx_inodes_bad(t) -> DataFrame:
    return _sql(t.spark, BAD_INODES, inodes=fx_inodes(t))


def fx_pages_bad(t) -> DataFrame:
    return _sql(t.spark, BAD_PAGES, pages=fx_pages(t))


def fx_links_bad(t) -> DataFrame:
    return _sql(t.spark, BAD_LINKS, links=fx_conversations_inodes(t))
