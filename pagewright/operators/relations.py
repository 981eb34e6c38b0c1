"""The declared foreign keys: navigations, deletions that follow them, and audits of
all tables at once.

``tables`` is a dict of DataFrames by table name; tables that are not given are
left out.  Keys are compared as text where key types meet (users have uuids)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..session import materialize
from .tree import descendants


class ForeignKey(NamedTuple):
    child: str
    column: str
    parent: str
    cascades: bool          # ON DELETE CASCADE; otherwise the delete is refused


FOREIGN_KEYS = [
    ForeignKey("conversations", "owner_id", "users", False),
    ForeignKey("inodes", "owner_id", "users", False),
    ForeignKey("inodes", "parent_id", "inodes", True),
    ForeignKey("conversations_inodes", "conversation_id", "conversations", True),
    ForeignKey("conversations_inodes", "inode_id", "inodes", True),
    ForeignKey("pages", "inode_id", "inodes", True),
    ForeignKey("prompts", "conversation_id", "conversations", True),
    ForeignKey("sources", "page_id", "pages", True),
    ForeignKey("sources", "prompt_id", "prompts", True),
]
PRIMARY_KEYS = {"users": ["id"], "conversations": ["id"], "inodes": ["id"], "pages": ["id"], "prompts": ["id"],
                "conversations_inodes": ["conversation_id", "inode_id"], "sources": ["prompt_id", "page_id"]}
# Parents before children.
ORDER = ["users", "conversations", "inodes", "pages", "prompts", "conversations_inodes", "sources"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- navigations -----------------------------------------------------------------

def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def follow(tables: dict[str, DataFrame], child: str, parent: str) -> DataFrame:
    """Rows of ``child`` with their ``parent`` row, over the declared key between them;
    columns are prefixed with the table names."""
    key = next(k for k in FOREIGN_KEYS if (k.child, k.parent) == (child, parent))
    left, right = _renamed(tables[child], child), _renamed(tables[parent], parent)
    return left.join(right, F.col(f"{child}_{key.column}").cast("string") == F.col(f"{parent}_id").cast("string"))


def user_conversations(tables: dict[str, DataFrame]) -> DataFrame:
    return follow(tables, "conversations", "users").select(F.col("users_id").alias("user_id"), F.col("conversations_id").alias("conversation_id"))


def user_inodes(tables: dict[str, DataFrame]) -> DataFrame:
    return follow(tables, "inodes", "users").select(F.col("users_id").alias("user_id"), F.col("inodes_id").alias("inode_id"), F.col("inodes_path").alias("path"))


def conversation_files(tables: dict[str, DataFrame]) -> DataFrame:
    """Both ways of the many-to-many link: (conversation_id, inode_id, path)."""
    return follow(tables, "conversations_inodes", "inodes").select(
        F.col("conversations_inodes_conversation_id").alias("conversation_id"), F.col("inodes_id").alias("inode_id"), F.col("inodes_path").alias("path"))


def conversation_prompts(tables: dict[str, DataFrame]) -> DataFrame:
    return follow(tables, "prompts", "conversations").select(
        F.col("conversations_id").alias("conversation_id"), F.col("prompts_id").alias("prompt_id"), F.col("prompts_query").alias("query"))


def inode_pages(tables: dict[str, DataFrame]) -> DataFrame:
    return follow(tables, "pages", "inodes").select(F.col("inodes_id").alias("inode_id"), F.col("pages_id").alias("page_id"), F.col("pages_index").alias("index"))


def prompt_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """(prompt_id, page_id, inode_id, path, similarity) of every source."""
    pages = tables["pages"].select(F.col("id").alias("page_id"), "inode_id")
    inodes = tables["inodes"].select(F.col("id").alias("inode_id"), "path")
    prompts = tables["prompts"].select(F.col("id").alias("prompt_id"))
    return (tables["sources"].join(prompts, "prompt_id").join(pages, "page_id").join(inodes, "inode_id")
            .select("prompt_id", "page_id", "inode_id", "path", "similarity"))


# -- deletions ----------------------------------------------------------------------

def cascade(tables: dict[str, DataFrame], kind: str, ids: DataFrame, owned: bool = False) -> DataFrame:
    """Every row that goes when the rows ``ids`` of table ``kind`` go: (kind, key1, key2),
    keys as text.  Folders take what is below them, whatever the depth.

    Keys of owners do not cascade: with ``owned`` a user's conversations and inodes go
    along; without, see :func:`held_users` for the users whose delete is refused."""
    gone: dict[str, DataFrame] = {}
    for table in ORDER:
        if table not in tables:
            continue
        keys, reached = PRIMARY_KEYS[table], []
        rows = tables[table].select(*dict.fromkeys(keys + [k.column for k in FOREIGN_KEYS if k.child == table]))
        if table == kind:
            reached.append(rows.join(ids.select("id").distinct(), "id", "left_semi").select(*keys))
        for key in FOREIGN_KEYS:
            if key.child == table != key.parent and key.parent in gone and (key.cascades or owned):
                parent = gone[key.parent].select(F.col("id").cast("string").alias("_key"))
                reached.append(rows.withColumn("_key", F.col(key.column).cast("string")).join(parent, "_key", "left_semi").select(*keys))
        if not reached:
            continue
        found = _union(reached).distinct()
        if table == "inodes":
            found = descendants(tables["inodes"], found)
        gone[table] = materialize(found, f"gone-{table}")
    parts = [df.select(F.lit(t).alias("kind"), F.col(PRIMARY_KEYS[t][0]).cast("string").alias("key1"),
                       (F.col(PRIMARY_KEYS[t][1]) if len(PRIMARY_KEYS[t]) > 1 else F.lit(None)).cast("string").alias("key2")) for t, df in gone.items()]
    return _union(parts) if parts else ids.sparkSession.createDataFrame([], "kind string, key1 string, key2 string")


def held_users(tables: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """(id, table): users of ``ids`` that rows of a table still name as owner."""
    users = ids.select(F.col("id").cast("string").alias("id")).distinct()
    refs = [tables[k.child].select(F.col(k.column).cast("string").alias("id"), F.lit(k.child).alias("table"))
            for k in FOREIGN_KEYS if not k.cascades and k.child in tables]
    return _union(refs).join(users, "id", "left_semi").distinct()


# -- audits of all tables --------------------------------------------------------------

def _row_key(table: str) -> F.Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in PRIMARY_KEYS[table]])


def all_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, tbl, col, key) of rows whose foreign key names no row.  All keys go through one
    join: references of all tables against the ids of all parents, tagged by table."""
    refs = [tables[k.child].where(F.col(k.column).isNotNull()).select(
                F.lit(k.parent).alias("parent"), F.col(k.column).cast("string").alias("id"),
                F.lit(k.child).alias("tbl"), F.lit(k.column).alias("col"), _row_key(k.child).alias("key"))
            for k in FOREIGN_KEYS if k.child in tables and k.parent in tables]
    parents = [tables[t].select(F.lit(t).alias("parent"), F.col("id").cast("string").alias("id")) for t in {k.parent for k in FOREIGN_KEYS} if t in tables]
    return (_union(refs).join(_union(sorted(parents, key=lambda d: str(d))).distinct(), ["parent", "id"], "left_anti")
            .select(F.lit("foreign_key").alias("rule"), "tbl", "col", "key"))


def all_duplicates(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, tbl, col, key) of primary keys that stand more than once."""
    keys = [df.select(F.lit(t).alias("tbl"), F.lit(",".join(PRIMARY_KEYS[t])).alias("col"), _row_key(t).alias("key")) for t, df in tables.items()]
    return (_union(keys).groupBy("tbl", "col", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .select(F.lit("primary_key").alias("rule"), "tbl", "col", "key"))


def all_bad_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, tbl, col, key) of values outside their enum and of nulls where none may be, in
    one scan per table."""
    parts = []
    for t, df in tables.items():
        enums = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(domain), F.struct(F.lit("enum").alias("rule"), F.lit(c).alias("col")))
                 for (table, c), domain in schemas.ENUMS.items() if table == t and c in df.columns]
        nulls = [F.when(F.col(c).isNull(), F.struct(F.lit("not_null").alias("rule"), F.lit(c).alias("col")))
                 for c in schemas.not_null_columns(t) if c in df.columns]
        broken = F.filter(F.array(*enums, *nulls), lambda x: x.isNotNull())
        parts.append(df.select(F.explode(broken).alias("b"), _row_key(t).alias("key")).select("b.rule", F.lit(t).alias("tbl"), "b.col", "key"))
    return _union(parts)
