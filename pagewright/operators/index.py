"""Search documents: parent (inode) and child (page) docs, writes, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import non_empty, page_doc_id, parent_folder, path_ancestors, readable_by, relative_index
from ..session import materialize

_DOC_COLS = [f.name for f in schemas.DOCS.fields]


def _conform(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Give a doc frame the full docs column list and types (and the columns ``extra``)."""
    cols = []
    for f in schemas.DOCS.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols, *extra)


def inode_docs(inodes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One parent document per inode (its id is the inode id).  ``extra`` names further
    columns of the inodes that are handed on."""
    return _conform(inodes.select(
        F.col("id").cast("string").alias("doc_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("inode").alias("kind"),
        F.col("id"),
        F.col("owner_id").cast("string").alias("owner_id"),
        F.col("is_public"),
        readable_by("owner_id").alias("readable_by"),
        F.col("path"), F.col("type"),
        parent_folder("path").alias("folder"),
        F.col("name").alias("filename"),
        *extra,
    ), extra)


def indexable_pages(inodes: DataFrame, pages: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Non-empty pages of the given inodes, with the inode fields a page doc
    needs.  Equi-join on inode_id; the filter is pushed into the page scan."""
    ino = inodes.select(F.col("id").alias("inode_id"), "owner_id", "is_public", "from_page", *extra)
    return pages.where(non_empty("contents")).join(ino, "inode_id")


def page_docs(inodes: DataFrame, pages: DataFrame, extra: tuple[str, ...] = ()):
    """Child documents for non-empty pages: returns ``(docs, quarantine)``.  ``extra``
    names further columns of the inodes that the docs keep.

    A page without a vector cannot be indexed; it goes to ``quarantine`` with
    a reason instead of failing the whole document."""
    p = indexable_pages(inodes, pages, extra)
    docs = p.select(
        page_doc_id("inode_id", "index").alias("doc_id"),
        F.col("inode_id").cast("string").alias("parent_id"),
        F.lit("page").alias("kind"),
        F.col("id"),
        F.col("owner_id").cast("string").alias("owner_id"),
        F.col("is_public"),
        readable_by("owner_id").alias("readable_by"),
        relative_index("index", "from_page").cast("int").alias("index"),
        F.col("contents"),
        F.col("embedding"),
        *extra,
    )
    ok = _conform(docs.where(F.col("embedding").isNotNull()), extra)
    bad = docs.where(F.col("embedding").isNull()).select(
        "doc_id", "parent_id", F.col("id").alias("page_id"), F.lit("missing_embedding").alias("reason"))
    return ok, bad


def write_index(current: DataFrame, new: DataFrame, mode: str = "upsert") -> DataFrame:
    """New docs replace current docs with the same id.

    ``mode='replace_parent'`` also drops current page docs of every parent
    present in ``new`` (so pages that vanished are not left behind)."""
    # Written once: the new documents are read by the anti-join and the union.
    new = materialize(_conform(new), "new-docs")
    if mode == "upsert":
        keep = current.join(new.select("doc_id"), "doc_id", "left_anti")
    elif mode == "replace_parent":
        parents = new.select(F.coalesce("parent_id", "doc_id").alias("_root")).distinct()
        keep = (current.withColumn("_root", F.coalesce("parent_id", "doc_id"))
                .join(parents, "_root", "left_anti").drop("_root")
                .join(new.select("doc_id"), "doc_id", "left_anti"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return _conform(keep).unionByName(new)


def delete_from_index(docs: DataFrame, deleted_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Remove deleted parents and their pages in one anti-join on the parent
    key (``parent_id`` for pages, ``doc_id`` for parents).  Absent ids are a
    no-op."""
    gone = deleted_ids.select(F.col(id_col).cast("string").alias("_root")).distinct()
    return (docs.withColumn("_root", F.coalesce("parent_id", "doc_id"))
            .join(gone, "_root", "left_anti").drop("_root"))


def children_of(docs: DataFrame, parents: DataFrame, id_col: str = "id") -> DataFrame:
    """Page docs whose parent is in ``parents`` (has_parent)."""
    p = parents.select(F.col(id_col).cast("string").alias("parent_id")).distinct()
    return docs.where(F.col("kind") == "page").join(p, "parent_id", "left_semi")


def folder_facets(docs: DataFrame) -> DataFrame:
    """Documents per folder token over all ancestors of each doc's folder."""
    return (docs.where(F.col("folder").isNotNull())
            .select(F.explode(path_ancestors("folder")).alias("folder_token"))
            .groupBy("folder_token").agg(F.count(F.lit(1)).alias("n_docs")))


def in_folder(docs: DataFrame, folder: str) -> DataFrame:
    """Inode docs whose folder lies in the subtree of ``folder``, and the page
    docs of those inodes (joined by parent id)."""
    parents = docs.where((F.col("kind") == "inode")
                         & F.array_contains(path_ancestors("folder"), folder))
    pages = docs.where(F.col("kind") == "page").join(
        parents.select(F.col("doc_id").alias("parent_id")), "parent_id", "left_semi")
    return parents.unionByName(pages)


def visible_to(docs: DataFrame, user: str) -> DataFrame:
    """Documents the user may read: public, or listed in ``readable_by``."""
    return docs.where(F.col("is_public") | F.array_contains("readable_by", user))


def visible_to_owner(is_public: str, owner: str, reader: str) -> F.Column:
    """The same rule on inode columns, whose readers are their owner: public, or the reader's own."""
    own = F.col(owner).cast("string") == F.col(reader).cast("string")
    return F.coalesce(F.col(is_public), F.lit(False)) | F.coalesce(own, F.lit(False))


def in_subtree(docs: DataFrame, intervals: DataFrame, folder_id: int) -> DataFrame:
    """Inode and page docs of a folder and all below it by the tree itself (not by
    stored paths): one range of the walk, see ``tree.tree_intervals``."""
    top = intervals.where(F.col("id") == folder_id).first()
    if top is None or top["enter"] is None:
        return docs.limit(0)
    below = intervals.where((F.col("enter") >= top["enter"]) & (F.col("leave") <= top["leave"])).select(F.col("id").cast("string").alias("_root"))
    return docs.withColumn("_root", F.coalesce("parent_id", "doc_id")).join(below, "_root", "left_semi").drop("_root")


def flat_docs(docs: DataFrame) -> DataFrame:
    """Docs with arrays flattened for comparison: readable_by joined, the
    vector reduced to its width and rounded first element."""
    return docs.select(
        "doc_id", "parent_id", "kind", "id", "owner_id", "is_public",
        F.array_join("readable_by", ",").alias("readable_by"),
        "path", "type", "folder", "filename", "index",
        F.md5("contents").alias("contents_md5"),
        F.size("embedding").cast("int").alias("emb_dim"),
        F.round(F.col("embedding")[0].cast("double"), 6).alias("emb_first"),
    )
