"""Sources of prompts: the nearest pages a prompt's user may read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import non_empty
from .index import visible_to_owner
from .knn import knn_scoped


def conversation_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(conversation_id, page columns) of the non-empty pages of each conversation's files."""
    return links.select("conversation_id", "inode_id").distinct().join(pages.where(non_empty("contents")), "inode_id")


def retrieve_sources(prompts: DataFrame, pages: DataFrame, links: DataFrame, k: int = 5, inodes: DataFrame | None = None,
                     conversations: DataFrame | None = None) -> DataFrame:
    """(prompt_id, page_id, rank, similarity): the k nearest pages among the files of each
    prompt's conversation; similarity is 1 / (1 + squared L2 distance), ties go to the smaller page id.

    Given ``inodes`` (id, owner_id, is_public) and ``conversations`` (id, owner_id), only
    pages that the conversation's owner may read are looked at: public ones and the owner's
    own.  The filter stands before the search, so hidden pages take no rank."""
    q = prompts.where(F.col("embedding").isNotNull()).select(
        F.col("conversation_id").alias("grp"), F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    held = conversation_pages(links, pages.where(F.col("embedding").isNotNull()))
    if inodes is not None and conversations is not None:
        rights = inodes.select(F.col("id").alias("inode_id"), F.col("owner_id").alias("_owner"), "is_public")
        readers = conversations.select(F.col("id").alias("conversation_id"), F.col("owner_id").alias("_reader"))
        held = held.join(rights, "inode_id").join(readers, "conversation_id").where(visible_to_owner("is_public", "_owner", "_reader"))
    v = held.select(F.col("conversation_id").alias("grp"), F.col("id").alias("vid"), F.col("embedding").alias("vvec"))
    out = knn_scoped(q, v, k=k)
    return out.select(F.col("qid").alias("prompt_id"), F.col("vid").alias("page_id"), F.col("rank").cast("int").alias("rank"),
                      (1.0 / (1.0 + F.col("distance") * F.col("distance"))).alias("similarity"))
