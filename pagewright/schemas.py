"""Table schemas, column defaults and enum domains of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Enum domains of the relational model.
INODE_TYPES = ["folder", "file"]
FILE_ERRORS = ["unsupported_file_type", "corrupted_file"]
CONVERSATION_ERRORS = ["completion_context_exceeded"]
PROMPT_ERRORS = ["embed_context_exceeded"]

# The six routing keys the worker understands.
ROUTING_KEYS = ["ingest_inode", "embed_inode", "index_inode", "move_inode", "share_inode", "delete_inode"]

# Model limits.
EMBEDDING_DIM = 1536          # vector width of the production model
EMBED_BATCH = 64              # strings per embedding request
MAX_TOKENS = 8192             # tokens kept per string before embedding

VECTOR = T.ArrayType(T.FloatType())

USERS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()),
])

INODES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("owner_id", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("is_indexed", T.BooleanType(), False),
    T.StructField("is_public", T.BooleanType(), False),
    T.StructField("is_uploaded", T.BooleanType(), False),
    T.StructField("is_ingested", T.BooleanType(), False),
    T.StructField("is_embedded", T.BooleanType(), False),
    T.StructField("from_page", T.IntegerType(), False),
    T.StructField("should_move", T.BooleanType(), False),
    T.StructField("parent_id", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("to_page", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("inode_id", T.LongType(), False),
    T.StructField("index", T.IntegerType(), False),
    T.StructField("contents", T.StringType(), False),
    T.StructField("embedding", VECTOR),
])

CONVERSATIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("owner_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("error", T.StringType()),
])

CONVERSATIONS_INODES = T.StructType([
    T.StructField("conversation_id", T.LongType(), False),
    T.StructField("inode_id", T.LongType(), False),
])

PROMPTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("query", T.StringType(), False),
    T.StructField("conversation_id", T.LongType(), False),
    T.StructField("response", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("embedding", VECTOR),
    T.StructField("error", T.StringType()),
])

SOURCES = T.StructType([
    T.StructField("prompt_id", T.LongType(), False),
    T.StructField("page_id", T.LongType(), False),
    T.StructField("similarity", T.DoubleType(), False),
])

# Change-feed message after JSON decoding.
BODY = T.StructType([
    T.StructField("after", T.StructType([T.StructField("id", T.LongType())])),
    T.StructField("before", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("owner_id", T.StringType()),
        T.StructField("path", T.StringType()),
    ])),
])

FEED = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("routing_key", T.StringType()),
    T.StructField("body", T.StringType()),
])

# One table for both kinds of search document (parent inode, child page).
DOCS = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("parent_id", T.StringType()),
    T.StructField("kind", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("owner_id", T.StringType()),
    T.StructField("is_public", T.BooleanType()),
    T.StructField("readable_by", T.ArrayType(T.StringType())),
    T.StructField("path", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("index", T.IntegerType()),
    T.StructField("contents", T.StringType()),
    T.StructField("embedding", VECTOR),
])

# Column defaults applied on insert (server defaults of the model).
# The value "now" stands for the insert time.
DEFAULTS = {
    "inodes": {
        "type": "folder", "is_indexed": False, "is_public": False, "is_uploaded": False,
        "is_ingested": False, "is_embedded": False, "from_page": 0, "should_move": False,
        "created_at": "now", "updated_at": "now",
    },
    "conversations": {"created_at": "now", "updated_at": "now"},
    "prompts": {"created_at": "now", "updated_at": "now"},
}

TABLES = {
    "users": USERS, "inodes": INODES, "pages": PAGES, "conversations": CONVERSATIONS,
    "conversations_inodes": CONVERSATIONS_INODES, "prompts": PROMPTS, "sources": SOURCES,
}

ENUMS = {
    ("inodes", "type"): INODE_TYPES,
    ("inodes", "error"): FILE_ERRORS,
    ("conversations", "error"): CONVERSATION_ERRORS,
    ("prompts", "error"): PROMPT_ERRORS,
}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]
