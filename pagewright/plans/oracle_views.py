"""DuckDB spellings of the fixture views and shared oracle pieces.

The oracle only pre-registers the base tables, so each oracle query starts
with the views it needs as WITH clauses.  The fixture SQL is FIXTURES.md's.
"""

from __future__ import annotations

from ..functions.text import TOKEN_RUNS, WHITESPACE_RUN, WORD_RUN
from ..sources.fixtures import BAD_INODES, BAD_LINKS, BAD_PAGES

FX = {
    "fx_users": """fx_users AS (SELECT c_custkey AS id, c_name AS name,
  concat(lower(replace(c_name, '#', '.')), '@example.org') AS email FROM customer)""",
    "fx_inodes": """fx_inodes AS (
WITH fxf AS (SELECT doc_id, text, source, lang, CAST(substr(source, 4) AS bigint) AS sn,
  CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS ln FROM documents)
SELECT DISTINCT sn + 1 AS id, CAST(NULL AS bigint) AS parent_id, sn AS owner_id, 'folder' AS type,
  source AS name, concat('/', source) AS path, sn % 5 = 0 AS is_public, true AS is_uploaded,
  true AS is_ingested, true AS is_embedded, false AS is_indexed, 0 AS from_page,
  CAST(NULL AS int) AS to_page, CAST(NULL AS string) AS error FROM fxf
UNION ALL SELECT DISTINCT 100 + (sn + 1) * 10 + ln, sn + 1, sn, 'folder', lang, concat('/', source, '/',
  lang), sn % 5 = 0, true, true, true, false, 0, CAST(NULL AS int), CAST(NULL AS string) FROM fxf
UNION ALL SELECT 1000 + doc_id, 100 + (sn + 1) * 10 + ln, sn, 'file', concat(doc_id, '.pdf'),
  CASE WHEN doc_id % 10 = 0 THEN concat('/old/', doc_id, '.pdf') ELSE concat('/', source, '/', lang, '/',
  doc_id, '.pdf') END, doc_id % 5 = 0, true, true, doc_id % 3 <> 0, doc_id % 4 <> 0,
  CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(ceil(length(text)/1000) AS int) END,
  CASE WHEN doc_id % 50 = 49 THEN 'corrupted_file' END FROM fxf)""",
    "fx_pages": """fx_pages AS (
WITH p AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text)/1000) AS int))) AS k FROM documents),
 q AS (SELECT (1000 + doc_id) * 1000 + k AS id, 1000 + doc_id AS inode_id,
  CAST(CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END + k AS int) AS index,
  CASE WHEN (doc_id + k) % 11 = 0 THEN '' ELSE substr(text, k * 1000 + 1, 1000) END AS contents FROM p),
 n AS (SELECT count(*) AS n FROM embeddings) SELECT q.id, q.inode_id, q.index, q.contents,
  CASE WHEN q.id % 13 <> 0 THEN e.embedding END AS embedding FROM q CROSS JOIN n JOIN embeddings e ON
  e.vec_id = q.id % n.n)""",
    "fx_objects": """fx_objects AS (SELECT page_id AS id, page_id % 20 AS owner_id, concat('/web/', page_id, '.html') AS path,
  CASE WHEN page_id % 2 = 0 THEN concat('%PDF-1.7', html) ELSE html END AS content FROM pages)""",
    "fx_messages": """fx_messages AS (
WITH m AS (SELECT event_id AS seq, ts, user_id,
  CASE WHEN event_id % 97 = 0 THEN 999999 WHEN event_id % 10 = 0 THEN 1000 + CAST(json_extract_string(props, '$.k') AS bigint)
    ELSE 1000 + (event_id * 7919) % (SELECT count(*) FROM documents) END AS id,
  CASE event_type WHEN 'signup' THEN 'ingest_inode' WHEN 'view' THEN 'embed_inode'
    WHEN 'click' THEN 'index_inode'
    WHEN 'purchase' THEN CASE user_id % 3 WHEN 0 THEN 'move_inode' WHEN 1 THEN 'share_inode'
      ELSE 'delete_inode' END
    ELSE 'unknown_key' END AS routing_key FROM events)
SELECT m.seq, m.ts, m.routing_key,
  CASE WHEN m.routing_key = 'delete_inode'
    THEN concat('{"before": {"id": ', m.id, ', "type": "file", "owner_id": "',
      coalesce(cast(i.owner_id as string), ''), '", "path": "', coalesce(i.path, ''), '"}}')
    ELSE concat('{"after": {"id": ', m.id, '}}') END AS body
FROM m LEFT JOIN fx_inodes i ON i.id = m.id)""",
    "fx_prompts": """fx_prompts AS (
SELECT u.conv_id * 100 + u.turn AS id, u.conv_id AS conversation_id, u.text AS query, a.text AS response,
  e.embedding FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn +
  1 AND a.role = 'assistant' CROSS JOIN (SELECT count(*) AS n FROM embeddings) n JOIN embeddings e ON
  e.vec_id = (u.conv_id * 100 + u.turn) % n.n WHERE u.role = 'user')""",
    "fx_conversations_inodes": """fx_conversations_inodes AS (
SELECT DISTINCT conv_id AS conversation_id, 1000 + (conv_id * 7) % (SELECT count(*) FROM documents) AS inode_id FROM conversations)""",
    # Derived here (not in FIXTURES.md): one inode per test object, for ingest.
    "fx_object_inodes": """fx_object_inodes AS (
SELECT 500000 + id AS id, CAST(NULL AS bigint) AS parent_id, owner_id, 'file' AS type,
  concat(id, '.html') AS name, path, id % 5 = 0 AS is_public, true AS is_uploaded, false AS is_ingested,
  false AS is_embedded, false AS is_indexed, CAST(CASE WHEN id % 7 = 0 THEN 3 ELSE 0 END AS int) AS from_page,
  CAST(CASE WHEN id % 4 = 0 THEN 5 WHEN id % 6 = 0 THEN 0 END AS int) AS to_page,
  CAST(CASE WHEN id % 50 = 48 THEN 'corrupted_file' END AS string) AS error FROM fx_objects)""",
    # Decoded messages.
    "msgs": """msgs AS (SELECT seq, ts, routing_key, body,
  CAST(json_extract_string(body, '$.after.id') AS BIGINT) AS after_id,
  CAST(json_extract_string(body, '$.before.id') AS BIGINT) AS before_id,
  json_extract_string(body, '$.before.type') AS before_type,
  json_extract_string(body, '$.before.owner_id') AS before_owner_id,
  json_extract_string(body, '$.before.path') AS before_path FROM fx_messages)""",
}

FX["fx_inodes_bad"] = f"fx_inodes_bad AS ({BAD_INODES.format(inodes='fx_inodes')})"
FX["fx_pages_bad"] = f"fx_pages_bad AS ({BAD_PAGES.format(pages='fx_pages').replace('SLICE', 'list_slice')})"
FX["fx_links_bad"] = f"fx_links_bad AS ({BAD_LINKS.format(links='fx_conversations_inodes')})"

DEPENDS = {
    "fx_inodes_bad": ["fx_inodes"],
    "fx_pages_bad": ["fx_pages"],
    "fx_links_bad": ["fx_conversations_inodes"],
    "fx_messages": ["fx_inodes"],
    "fx_object_inodes": ["fx_objects"],
    "msgs": ["fx_messages"],
}

WS = WHITESPACE_RUN
WORD = WORD_RUN
RUNS = TOKEN_RUNS
KEYS_AFTER = "('ingest_inode', 'embed_inode', 'index_inode', 'move_inode', 'share_inode')"
KEYS_ALL = "('ingest_inode', 'embed_inode', 'index_inode', 'move_inode', 'share_inode', 'delete_inode')"


def with_views(*names: str, extra: str = "", recursive: bool = False) -> str:
    """WITH clause holding the named views (and what they depend on) plus
    ``extra`` CTE text."""
    order: list[str] = []

    def add(n: str):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [FX[n] for n in order]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def parent_folder(col: str) -> str:
    parts = f"list_filter(string_split({col}, '/'), lambda s: s <> '' AND s <> '.')"
    lead = (f"(CASE WHEN starts_with({col}, '//') AND NOT starts_with({col}, '///') THEN '//' "
            f"WHEN starts_with({col}, '/') THEN '/' ELSE '' END)")
    return (f"(CASE WHEN {col} IS NULL THEN NULL WHEN len({parts}) <= 1 THEN "
            f"(CASE WHEN {lead} = '' THEN '.' ELSE {lead} END) "
            f"ELSE {lead} || array_to_string(list_slice({parts}, 1, len({parts}) - 1), '/') END)")


def ancestors(col: str) -> str:
    return (f"list_transform(range(2, len(string_split({col}, '/')) + 1), "
            f"lambda i: array_to_string(list_slice(string_split({col}, '/'), 1, i), '/'))")


def squash(col: str) -> str:
    return f"trim(regexp_replace({col}, '{WS}', ' ', 'g'))"


def object_path(owner: str, path: str) -> str:
    return f"('users/' || CAST({owner} AS VARCHAR) || {path})"


def optimized_object_path(owner: str, path: str) -> str:
    return (f"('users/' || CAST({owner} AS VARCHAR) || "
            f"regexp_replace({path}, '(.+)(/[^/.]+)(\\..+)$', '\\1\\2_optimized\\3'))")


def resolved_cte(src: str = "fx_inodes") -> str:
    """Recursive path resolution (id, path); an orphan gets NULL."""
    return f"""rr(id, anc, suffix) AS (SELECT id, parent_id, '/' || name FROM {src}
  UNION ALL SELECT rr.id, p.parent_id, '/' || p.name || rr.suffix FROM rr JOIN {src} p ON p.id = rr.anc),
resolved AS (SELECT i.id, r.suffix AS path FROM {src} i LEFT JOIN rr r ON r.id = i.id AND r.anc IS NULL)"""


def docs_cte(inodes: str = "fx_inodes", pages: str = "fx_pages", name: str = "docs") -> str:
    """Parent + page documents (flat) of all ``inodes``, like rebuild."""
    return f"""{name} AS (
SELECT CAST(id AS VARCHAR) AS doc_id, CAST(NULL AS VARCHAR) AS parent_id, 'inode' AS kind, id,
  CAST(owner_id AS VARCHAR) AS owner_id, is_public, CAST(owner_id AS VARCHAR) AS readable_by, path, type,
  {parent_folder('path')} AS folder, name AS filename, CAST(NULL AS INTEGER) AS index,
  CAST(NULL AS VARCHAR) AS contents_md5, CAST(NULL AS INTEGER) AS emb_dim, CAST(NULL AS DOUBLE) AS emb_first
FROM {inodes}
UNION ALL
SELECT CAST(p.inode_id AS VARCHAR) || '_' || CAST(p.index AS VARCHAR), CAST(p.inode_id AS VARCHAR), 'page', p.id,
  CAST(i.owner_id AS VARCHAR), i.is_public, CAST(i.owner_id AS VARCHAR), CAST(NULL AS VARCHAR),
  CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(p.index - i.from_page AS INTEGER),
  md5(p.contents), CAST(len(p.embedding) AS INTEGER), round(CAST(p.embedding[1] AS DOUBLE), 6)
FROM {pages} p JOIN {inodes} i ON i.id = p.inode_id
WHERE length(p.contents) > 0 AND p.embedding IS NOT NULL)"""


def term_vectors_cte(src: str = "fx_pages", name: str = "tv") -> str:
    return f"""{name}_r AS (SELECT id, unnest(r) AS run, unnest(generate_series(1, len(r))) AS run_no
  FROM (SELECT id, regexp_extract_all(contents, '{RUNS}') AS r FROM {src} WHERE length(contents) > 0)),
{name}_w AS (SELECT id, run, run_no, length(run) AS len,
  CAST(regexp_matches(run, '^{WORD}') AS INTEGER) AS is_word FROM {name}_r),
{name}_s AS (SELECT *, sum(len) OVER (PARTITION BY id ORDER BY run_no ROWS UNBOUNDED PRECEDING) AS e,
  sum(is_word) OVER (PARTITION BY id ORDER BY run_no ROWS UNBOUNDED PRECEDING) AS nw FROM {name}_w),
{name} AS (SELECT id, lower(run) AS term, CAST(nw - 1 AS INTEGER) AS position,
  CAST(e - len AS INTEGER) AS start_offset, CAST(e AS INTEGER) AS end_offset FROM {name}_s WHERE is_word = 1)"""


def hashed_cte(src: str, name: str = "hv", dim: int = 64) -> str:
    """Hashed bag-of-words vectors as (id, b, x) cells, x already normalised
    and rounded through float like the stored vectors."""
    digits = "('0','1','2','3','4','5','6','7')"
    return f"""{name}_t AS (SELECT id, unnest(string_split(lower({squash('text')}), ' ')) AS tok FROM {src}),
{name}_c AS (SELECT id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS INTEGER) AS b,
  CAST(sum(CASE WHEN substr(md5(tok), 9, 1) IN {digits} THEN 1 ELSE -1 END) AS DOUBLE) AS v
  FROM {name}_t WHERE tok <> '' GROUP BY 1, 2),
{name}_n AS (SELECT id, sqrt(sum(v * v)) AS nrm FROM {name}_c GROUP BY id),
{name} AS (SELECT c.id, c.b, CAST(CAST(CASE WHEN n.nrm > 0 THEN c.v / n.nrm ELSE 0.0 END AS FLOAT) AS DOUBLE) AS x
  FROM {name}_c c JOIN {name}_n n USING (id))"""
