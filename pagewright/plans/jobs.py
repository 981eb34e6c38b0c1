"""What a user runs: ingest, embed, index, move, share, delete, rebuild.

Each job takes the requested ids of a batch (``seq``, ``id``) and the current
tables, and returns new versions of the tables it changes plus its outputs
(manifests, follow-up messages, notifications, dead letters).  Nothing is
written here; the caller writes each output once (see streaming.feed).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import (fill_to_page, is_file, is_pdf, is_ready, object_path, optimized_object_path,
                         path_changed, public_tag)
from ..operators import embed as E
from ..operators import extract as X
from ..operators import index as IX
from ..operators import messages as M
from ..operators.tables import lookup_inodes, set_flags, upsert_pages
from ..operators.tree import resolve_paths_of
from ..session import materialize


def _missing_letters(missing: DataFrame, task: str) -> DataFrame:
    return missing.select("seq", F.lit(task).alias("routing_key"), F.lit("missing_inode").alias("reason"))


def _ready_view(inodes: DataFrame) -> DataFrame:
    return inodes.withColumn("is_ready", is_ready())


# -- ingest -------------------------------------------------------------------

def ingest(requests: DataFrame, inodes: DataFrame, objects: DataFrame, pages: DataFrame,
           extractor: Callable[[bytes], list[str]] | None = None, clear_error: bool = False,
           page_count: Callable[[bytes], int] | None = None, next_page_id: int | None = None) -> dict:
    """Objects -> page texts -> upserted pages and inode status.

    ``objects``: (key, content) keyed ``users/{owner}{path}``.  Without an
    extractor the built-in (native) one is used; a supplied one (and its
    optional page counter) is called once per object.  Status per inode:
    'unsupported_file_type' (not a PDF), 'corrupted_file' (the file could not
    be opened), else the old error stays (``clear_error`` drops it)."""
    found, missing = lookup_inodes(requests.select("seq", "id"), inodes)
    ids = found.select("id").distinct()
    todo = (inodes.join(ids, "id", "left_semi")
            .withColumn("key", object_path("owner_id", "path")))
    # The requested keys are the small side of an inner join; past the
    # broadcast limit it becomes a sort-merge join, which shuffles the bytes of
    # the objects by key.  A missing object is found from the keys alone.
    have = (objects.select("key", "content").join(todo, "key")
            .withColumn("pdf", is_pdf("content")))
    no_object = todo.join(objects.select("key"), "key", "left_anti").select("id")
    pdfs = have.where(F.col("pdf"))
    # The built-in check finds a truncated file, a supplied extractor raises
    # CorruptedFile or has its page counter fail: 'corrupted_file'.  Any other
    # failure leaves the error column NULL (K10) and shows in ``status``.
    if extractor is None:
        extracted = (X.builtin_extract(pdfs).withColumn("corrupted", F.col("extract_error").isNotNull())
                     .withColumn("n_pages", F.when(F.col("texts").isNotNull(), F.size("texts"))))
    else:
        extracted = X.extract_pages(pdfs.select("id", "content"), extractor, page_count=page_count)
    status = (extracted.select("id", "texts", "extract_error", F.lit(True).alias("pdf"), "n_pages",
                               F.when(F.col("corrupted"), F.col("extract_error")).alias("_corrupt"))
              .unionByName(have.where(~F.col("pdf")).select(
                  "id", F.lit(None).cast("array<string>").alias("texts"),
                  F.lit(None).cast("string").alias("extract_error"), F.lit(False).alias("pdf"),
                  F.lit(None).cast("int").alias("n_pages"), F.lit(None).cast("string").alias("_corrupt")))
              .withColumn("new_error", X.ingest_status(F.col("pdf"), F.col("_corrupt")))
              .withColumn("n_texts", F.col("n_pages"))
              .drop("_corrupt", "n_pages"))
    # Written once: one extraction per object, however many outputs use it.
    status = materialize(status, "extracted", "zstd")
    ok = status.where(F.col("new_error").isNull() & F.col("texts").isNotNull())
    numbered = X.number_pages(ok.join(inodes.select("id", "from_page"), "id"), texts="texts")
    new_pages = upsert_pages(pages, numbered, next_id=next_page_id)

    upd = status.select("id", "new_error", "n_texts", F.col("extract_error").isNotNull().alias("_failed"))
    old_error = F.lit(None) if clear_error else F.col("error")
    new_inodes = (inodes.join(upd, "id", "left")
                  .withColumn("_done", F.col("n_texts").isNotNull() | F.col("new_error").isNotNull()
                              | F.coalesce(F.col("_failed"), F.lit(False)))
                  .withColumn("error", F.when(F.col("new_error").isNotNull(), F.col("new_error"))
                              .when(F.col("_done"), old_error).otherwise(F.col("error")))
                  .withColumn("to_page", F.when(F.col("n_texts").isNotNull(),
                                                fill_to_page("to_page", "n_texts")).otherwise(F.col("to_page")))
                  .withColumn("is_ingested", F.col("is_ingested") | F.col("_done"))
                  .drop("new_error", "n_texts", "_done", "_failed"))

    good = new_inodes.join(ok.select("id"), "id", "left_semi")
    uploads = upload_manifest(good)
    tags = public_tags(good.where(F.col("is_public")))
    processed = found.select("seq", "id").join(no_object, "id", "left_anti")
    after = _ready_view(new_inodes)
    done = processed.join(after.select("id", "is_ready", "error", "is_public", "owner_id"), "id")
    letters = M.dead_letters(
        _missing_letters(missing, "ingest_inode"),
        found.join(no_object, "id", "left_semi").select(
            "seq", F.lit("ingest_inode").alias("routing_key"), F.lit("missing_object").alias("reason")))
    return {
        "inodes": new_inodes, "pages": new_pages,
        "status": status.select("id", "new_error", "n_texts", "extract_error"),
        "uploads": uploads, "tags": tags,
        "followups": M.followups(processed, "ingest_inode"),
        "notifications": M.notifications(done, "ingest_inode"),
        "dead_letters": letters,
    }


def object_keys(path: str = "path") -> F.Column:
    """A file's objects as (kind, object_key, collides): the original and the optimised one.
    Where the optimised key is the original's (no folder, no extension), there is one
    object only, and ``collides`` says so."""
    original, optimized = object_path("owner_id", path), optimized_object_path("owner_id", path)

    def one(kind: str, key: F.Column, collides: bool) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("object_key"), F.lit(collides).alias("collides"))

    return (F.when(original == optimized, F.array(one("original", original, True)))
            .otherwise(F.array(one("original", original, False), one("optimized", optimized, False))))


def upload_manifest(inodes: DataFrame) -> DataFrame:
    """Optimised objects to write: the object they are made from, their key, and whether that
    key is the original's own, which the upload then replaces."""
    source, target = object_path("owner_id", "path"), optimized_object_path("owner_id", "path")
    return inodes.select("id", F.lit("optimized").alias("kind"), source.alias("source_key"), target.alias("object_key"), (source == target).alias("collides"))


def public_tags(inodes: DataFrame) -> DataFrame:
    """Tag the objects of each inode (original and optimised key) with
    ``is_public`` as 'True' / 'False'; a key that both share is tagged once."""
    return (inodes.select("id", "is_public", F.explode(object_keys()).alias("_k"))
            .select("id", "_k.kind", "_k.object_key", public_tag("is_public").alias("tag"), "_k.collides"))


def move_pairs(files: DataFrame, new_path: str = "new_path") -> DataFrame:
    """(id, kind, old_key, new_key, collides) of moved files.  The optimised object is moved
    beside the original only where it is one of its own before and after."""
    old, new = object_keys(), object_keys(new_path)
    collides = (F.size(old) == 1) | (F.size(new) == 1)
    kinds = F.when(collides, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    return (files.withColumn("_old", old).withColumn("_new", new).withColumn("_collides", collides).withColumn("_i", F.explode(kinds))
            .select("id", F.expr("_old[_i].kind").alias("kind"), F.expr("_old[_i].object_key").alias("old_key"),
                    F.expr("_new[_i].object_key").alias("new_key"), F.col("_collides").alias("collides")))


# -- embed --------------------------------------------------------------------

def embed(requests: DataFrame, inodes: DataFrame, pages: DataFrame,
          embedder: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 64,
          batch: int = 64, store: str | None = None) -> dict:
    """Fill missing vectors of the requested inodes.

    Without an embedder the native hashed embedder runs in SQL.  With one,
    requests of at most ``batch`` pages per document go through
    ``mapInPandas``; a document any of whose requests failed keeps no new
    vector and is not marked embedded (all or nothing, per document).  With
    ``store``, a folder, replies are kept there, and a later run sends only the
    requests that failed (:func:`embed_stored`)."""
    found, missing = lookup_inodes(requests.select("seq", "id"), inodes)
    ok, rejected = E.embeddable(found)
    ids = ok.select("id").distinct()
    sel = E.embed_selection(inodes.join(ids, "id", "left_semi"), pages)
    # Written once: in one plan with the table it fills, the tree of inodes stands in so many
    # places that the optimizer's union rule breaks the plan on larger tables.
    text = materialize(E.embed_input(sel).select("id", "inode_id", "index", "text"), "embed-input", "zstd")
    failed_ids = None
    if embedder is None:
        vectors = E.hashed_embeddings(text, "id", "text", dim)
    else:
        # One call per request, however often the result is used below.
        out = (materialize(E.embed_pages(E.request_batches(text, batch), embedder, batch), "embedded") if store is None
               else E.embed_stored(text, embedder, store, batch))
        failed_ids = out.where(F.col("status") != "ok").select(F.col("inode_id").alias("id")).distinct()
        vectors = (out.join(failed_ids.select(F.col("id").alias("inode_id")), "inode_id", "left_anti")
                   .select("id", "embedding"))
    new_pages = E.attach_embeddings(pages, vectors)
    done_ids = ids if failed_ids is None else ids.join(failed_ids, "id", "left_anti")
    new_inodes = set_flags(inodes, done_ids, is_embedded=True)
    processed = ok.select("seq", "id").join(done_ids, "id", "left_semi")
    after = _ready_view(new_inodes)
    letters = [_missing_letters(missing, "embed_inode"),
               rejected.select("seq", F.lit("embed_inode").alias("routing_key"),
                               F.lit("errored_inode").alias("reason"))]
    if failed_ids is not None:
        letters.append(ok.join(failed_ids, "id", "left_semi").select(
            "seq", F.lit("embed_inode").alias("routing_key"), F.lit("embedding_failed").alias("reason")))
    return {
        "inodes": new_inodes, "pages": new_pages, "vectors": vectors,
        "followups": M.followups(processed, "embed_inode"),
        "notifications": M.notifications(
            processed.join(after.select("id", "is_ready", "error", "is_public", "owner_id"), "id"), "embed_inode"),
        "dead_letters": M.dead_letters(*letters),
    }


# -- index --------------------------------------------------------------------

def index(requests: DataFrame, inodes: DataFrame, pages: DataFrame, current_docs: DataFrame | None = None,
          mode: str = "upsert", strict: bool = False) -> dict:
    """Parent and page documents of the requested inodes, written over
    ``current_docs``.  Pages without a vector are quarantined; their inode is
    not marked indexed (``strict`` raises instead)."""
    found, missing = lookup_inodes(requests.select("seq", "id"), inodes)
    ids = found.select("id").distinct()
    ino = inodes.join(ids, "id", "left_semi")
    idocs = IX.inode_docs(ino)
    pdocs, quarantine = IX.page_docs(ino, pages)
    if strict and quarantine.limit(1).count() > 0:
        raise ValueError("pages without embedding cannot be indexed")
    new_docs = idocs.unionByName(pdocs)
    docs = new_docs if current_docs is None else IX.write_index(current_docs, new_docs, mode)
    bad = quarantine.select(F.col("parent_id").cast("long").alias("id")).distinct()
    done_ids = ids.join(bad, "id", "left_anti")
    new_inodes = set_flags(inodes, done_ids, is_indexed=True)
    processed = found.select("seq", "id").join(done_ids, "id", "left_semi")
    after = _ready_view(new_inodes)
    return {
        "inodes": new_inodes, "docs": docs, "new_docs": new_docs, "quarantine": quarantine,
        "notifications": M.notifications(
            processed.join(after.select("id", "is_ready", "error", "is_public", "owner_id"), "id"), "index_inode"),
        "dead_letters": M.dead_letters(
            _missing_letters(missing, "index_inode"),
            found.join(bad, "id", "left_semi").select(
                "seq", F.lit("index_inode").alias("routing_key"), F.lit("missing_embedding").alias("reason"))),
    }


def rebuild_index(inodes: DataFrame, pages: DataFrame) -> dict:
    """Clear every ``is_indexed`` flag and index all inodes from an empty
    index in one job (no notifications, as the command line sends none)."""
    cleared = set_flags(inodes, is_indexed=False)
    idocs = IX.inode_docs(cleared)
    pdocs, quarantine = IX.page_docs(cleared, pages)
    bad = quarantine.select(F.col("parent_id").cast("long").alias("id")).distinct()
    new_inodes = set_flags(cleared, cleared.select("id").join(bad, "id", "left_anti"), is_indexed=True)
    return {"inodes": new_inodes, "docs": idocs.unionByName(pdocs), "quarantine": quarantine}


# -- move / share / delete -----------------------------------------------------

def move(requests: DataFrame, inodes: DataFrame, resolved: DataFrame | None = None) -> dict:
    """Recompute paths; a changed one yields object moves (files only: the
    original and the optimised key), the new path, ``should_move`` reset and
    a re-index message.  ``resolved`` may be passed in if already known."""
    found, missing = lookup_inodes(requests.select("seq", "id"), inodes)
    resolved = resolved if resolved is not None else resolve_paths_of(inodes, found.select("id"))
    cur = (inodes.join(found.select("id").distinct(), "id", "left_semi")
           .join(resolved.select("id", F.col("path").alias("new_path")), "id"))
    # A path that cannot be resolved (missing ancestor) is not a move target.
    changed = cur.where(F.col("new_path").isNotNull() & path_changed("new_path", "path"))
    manifest = move_pairs(changed.where(is_file("type")))
    upd = changed.select("id", "new_path")
    new_inodes = (inodes.join(upd, "id", "left")
                  .withColumn("should_move", F.when(F.col("new_path").isNotNull(), F.lit(False))
                              .otherwise(F.col("should_move") if "should_move" in inodes.columns
                                         else F.lit(False)))
                  .withColumn("path", F.coalesce("new_path", "path"))
                  .drop("new_path"))
    moved = found.select("seq", "id").join(changed.select("id"), "id", "left_semi")
    return {
        "inodes": new_inodes, "manifest": manifest, "changed": changed.select("id", "path", "new_path"),
        "followups": M.followups(moved, "move_inode"),
        "dead_letters": _missing_letters(missing, "move_inode"),
    }


def share(requests: DataFrame, inodes: DataFrame) -> dict:
    """Tag both objects of shared files; re-index every shared inode."""
    found, missing = lookup_inodes(requests.select("seq", "id"), inodes)
    files = inodes.join(found.select("id").distinct(), "id", "left_semi").where(is_file("type"))
    return {
        "tags": public_tags(files),
        "followups": M.followups(found.select("seq", "id"), "share_inode"),
        "dead_letters": _missing_letters(missing, "share_inode"),
    }


def delete(decoded: DataFrame, docs: DataFrame | None = None, inodes: DataFrame | None = None,
           pages: DataFrame | None = None) -> dict:
    """Works from the message's *before* image (the row is gone): both
    objects of a file are deleted, and the parent doc and its pages leave the
    index.  Deleting an absent id changes nothing.

    Given the tables, the delete also ends the id there, as the database's
    ON DELETE CASCADE did: the inode, every inode below it and their pages
    go, and so do the index docs of all of them."""
    before = decoded.select("seq", F.col("before_id").alias("id"), F.col("before_type").alias("type"),
                            F.col("before_owner_id").alias("owner_id"), F.col("before_path").alias("path"))
    manifest = (before.where(is_file("type"))
                .select("seq", "id", F.explode(object_keys()).alias("_k"))
                .select("seq", "id", "_k.kind", "_k.object_key", "_k.collides"))
    out = {"manifest": manifest}
    gone = before.select("id").where(F.col("id").isNotNull())
    if inodes is not None:
        from ..operators.tree import descendants
        gone = descendants(inodes, gone)
        out["inodes"] = inodes.join(gone, "id", "left_anti")
        if pages is not None:
            out["pages"] = pages.join(gone.select(F.col("id").alias("inode_id")), "inode_id", "left_anti")
    if docs is not None:
        out["docs"] = IX.delete_from_index(docs, gone)
    return out
