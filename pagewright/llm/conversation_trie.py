"""Prefix trie of conversations; subtree totals by parallel tree contraction.

Conversations are rebuilt so that those of a hundred share a beginning, and
every different sequence of first turns is a node.

Nodes.  A turn is hashed to a number, a prefix to ``before * BASE + turn`` modulo a
127-bit prime.  Turns are range-sorted by (conversation, turn) and folded in each
partition; one carry per partition joins the pieces, so a conversation of any length is
spread over tasks.  A prefix whose first turns come from another conversation
follows by arithmetic, so rebuilt conversations are never sorted again.

Totals.  Every round rakes all leaves (their totals go to their parents, summed
map-side) and splices a set of non-adjacent unary nodes out of the chains (a
node goes when its hash is below those of its parent and its child; the child takes
its total along as an edge weight).  The tree shrinks by a constant share a
round, whatever its depth; each round is written.  Afterwards the rounds are
walked back: a raked leaf's total is known, a spliced node's is its own part plus
its child's, which went in a later round.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F % PRIME
INVERSE = pow(BASE, -1, PRIME)
GROUP = 100             # conversations of one beginning
SHARED = 6              # of which fewer turns than this are taken over
ENDS_BLOCK = 4096       # conversation ids whose digest text is made in one piece


def hexed(value: int) -> str:
    return f"{value:032x}"


def turns_of(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, digest and chars of every row with an id; the texts stay behind."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    return (conversations.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
                    F.substring(F.sha2(F.concat_ws(":", F.length(role), role, text), 256), 1, 32).alias("digest"),
                    F.length(text).cast("long").alias("chars")))


def own_prefixes(turns: DataFrame) -> DataFrame:
    """conv, pos, digest, chars, key: every turn's place in its conversation and the
    hash of all turns up to it."""
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, pos, key = None, 0, 0
        for f in frames:
            places, keys = [], []
            for c, digest in zip(f["conv"].tolist(), f["digest"].tolist()):
                if c != conv:
                    conv, pos, key = c, 0, 0
                key = (key * BASE + int(digest, 16)) % PRIME
                places.append(pos)
                keys.append(hexed(key))
                pos += 1
            yield pd.DataFrame({"part": f["part"], "conv": f["conv"], "pos": places, "digest": f["digest"],
                                "chars": f["chars"], "key": keys})

    # Turns that tie follow role, then digest; equal rows are the same turn twice.
    ordered = turns.orderBy("conv", F.col("turn").asc_nulls_first(), "role", "digest").select(
        F.spark_partition_id().alias("part"), "conv", "digest", "chars")
    local = materialize(ordered.mapInPandas(fold, "part int, conv bigint, pos bigint, digest string, chars bigint, key string"),
                        "prefixes")
    # One row per partition: its first and last conversation and how far the last one came.
    last = F.max_by(F.struct("conv", "pos", "key"), F.struct("conv", "pos"))
    edges = local.groupBy("part").agg(F.min("conv").alias("first"), last.alias("last")).orderBy("part").collect()
    carries, open_conv, count, key = {}, None, 0, 0
    for e in edges:
        if open_conv is not None and e["first"] == open_conv:
            carries[e["part"]] = (open_conv, count, key)
        else:
            count, key = 0, 0
        whole = e["first"] == e["last"]["conv"]         # the partition holds one conversation
        length, value = e["last"]["pos"] + 1, int(e["last"]["key"], 16)
        key = (key * pow(BASE, length, PRIME) + value) % PRIME if whole else value
        count = count + length if whole else length
        open_conv = e["last"]["conv"]
    if not carries:
        return local.drop("part")

    def carried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            places, keys = f["pos"].tolist(), f["key"].tolist()
            for i, (part, conv) in enumerate(zip(f["part"].tolist(), f["conv"].tolist())):
                held = carries.get(part)
                if held and held[0] == conv:
                    keys[i] = hexed((held[2] * pow(BASE, places[i] + 1, PRIME) + int(keys[i], 16)) % PRIME)
                    places[i] += held[1]
            yield pd.DataFrame({"conv": f["conv"], "pos": places, "digest": f["digest"], "chars": f["chars"], "key": keys})

    return materialize(local.mapInPandas(carried, "conv bigint, pos bigint, digest string, chars bigint, key string"), "carried")


def rebuilt_prefixes(turns: DataFrame, group: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, prefixes): conv and ``whole`` (its number of rebuilt turns); and
    conv, depth, key, before (key of one turn less) and chars of every non-empty prefix."""
    own = own_prefixes(turns)
    take = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(shared))
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("pos") == take - 1, F.col("key"))).alias("skipped"))
    # A beginning is at most shared - 1 turns of one conversation.
    begun = F.array_sort(F.collect_list(F.struct("pos", "key", "digest", "chars")))
    begins = own.where((F.col("conv") % group == 0) & (F.col("pos") < shared - 1)).groupBy("conv").agg(begun.alias("begin"))
    nothing = F.array().cast("array<struct<pos:bigint,key:string,digest:string,chars:bigint>>")
    convs = materialize(
        convs.withColumn("take", take).withColumn("_base", F.col("conv") - F.col("conv") % group)
        .join(begins.select(F.col("conv").alias("_base"), "begin"), "_base", "left")
        .withColumn("begin", F.coalesce(F.slice("begin", F.lit(1), F.col("take").cast("int")), nothing))
        .withColumn("s", F.size("begin").cast("long"))
        .withColumn("start", F.when(F.col("s") > 0, F.element_at("begin", -1)["key"]))
        .withColumn("whole", F.col("s") + F.greatest(F.col("n") - F.col("take"), F.lit(0)))
        .select("conv", "take", "begin", "s", "start", "skipped", "whole"), "conversations")
    zero = F.lit(hexed(0))
    first = (convs.select("conv", F.posexplode("begin").alias("k", "t"))
             .select("conv", (F.col("k") + 1).cast("long").alias("depth"), F.col("t.digest"), F.col("t.chars"),
                     F.col("t.key"), zero.alias("start"), zero.alias("skipped"), F.lit(0).cast("bigint").alias("run")))
    rest = (own.join(convs.select("conv", "take", "s", "start", "skipped"), "conv").where(F.col("pos") >= F.col("take"))
            .withColumn("run", F.col("pos") + 1 - F.col("take"))
            .select("conv", (F.col("s") + F.col("run")).alias("depth"), "digest", "chars", "key",
                    F.coalesce("start", zero).alias("start"), F.coalesce("skipped", zero).alias("skipped"), "run"))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, before = [], []
            for digest, key, start, skipped, run in zip(f["digest"], f["key"], f["start"], f["skipped"], f["run"].tolist()):
                value = int(key, 16)
                if start != skipped:        # the beginning is another conversation's
                    value = (value + (int(start, 16) - int(skipped, 16)) * pow(BASE, run, PRIME)) % PRIME
                keys.append(hexed(value))
                before.append(hexed((value - int(digest, 16)) * INVERSE % PRIME))
            yield pd.DataFrame({"conv": f["conv"], "depth": f["depth"], "key": keys, "before": before, "chars": f["chars"]})

    prefixes = first.unionByName(rest).mapInPandas(keyed, "conv bigint, depth bigint, key string, before string, chars bigint")
    return convs.select("conv", "whole"), materialize(prefixes, "rebuilt")


def trie_nodes(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """id, parent (ids), conv_id, depth, parent_conv_id, n_convs, chars and ends_sha256 per node."""
    zero = F.lit(hexed(0))
    roots = convs.select("conv", F.lit(0).cast("bigint").alias("depth"), zero.alias("key"), F.lit(None).cast("string").alias("before"),
                         F.lit(0).cast("bigint").alias("chars"))
    found = (prefixes.unionByName(roots).groupBy("depth", "key")
             .agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
                  F.max("before").alias("before")))
    found = materialize(found.withColumn("id", F.monotonically_increasing_id()), "nodes")
    # The ids of a node's ends, as one text: pieces of neighbouring ids first.
    ends = (prefixes.unionByName(roots).join(convs.withColumnRenamed("whole", "depth"), ["conv", "depth"])
            .groupBy("depth", "key", F.floor(F.col("conv") / ENDS_BLOCK).alias("_block"))
            .agg(F.concat_ws(",", F.array_sort(F.collect_list("conv"))).alias("_ids"))
            .groupBy("depth", "key").agg(F.array_sort(F.collect_list(F.struct("_block", "_ids"))).alias("_pieces"))
            .select("depth", "key", F.sha2(F.concat_ws(",", F.col("_pieces")["_ids"]), 256).alias("ends_sha256")))
    # The root's children need no join; it may have very many.
    root = found.where(F.col("depth") == 0).select("id", "conv_id").first()
    over = found.where(F.col("depth") > 0).select((F.col("depth") + 1).alias("depth"), F.col("key").alias("before"),
                                                  F.col("id").alias("_up"), F.col("conv_id").alias("_up_conv"))
    at_root = F.col("depth") == 1
    return (found.join(over, ["depth", "before"], "left").join(ends, ["depth", "key"], "left")
            .select("id", F.when(at_root, F.lit(root and root["id"])).otherwise(F.col("_up")).cast("bigint").alias("parent"),
                    "conv_id", "depth",
                    F.when(at_root, F.lit(root and root["conv_id"])).otherwise(F.col("_up_conv")).cast("bigint").alias("parent_conv_id"),
                    "n_convs", "chars", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def subtree_totals(tree: DataFrame, values: dict[str, Column]) -> DataFrame:
    """id, n_children and, per name of ``values``, the sum of that column (which may
    use ``n_children``) over the node's subtree, itself included.

    ``tree`` has id and parent (null for roots; every other parent exists; no cycle).
    Alternating rake and compress; about log(nodes) rounds, each on a constant share
    of the rows of the one before.
    """
    names = list(values)

    def turned(node: Column, turn: int) -> Column:
        return F.xxhash64(node, F.lit(turn))

    def taken(name: str) -> Column:
        """What a node hands on when it goes: its own total and its edge's weight."""
        return F.col(f"own_{name}") + F.col(f"edge_{name}")

    kids = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    start = (tree.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
             .select("id", "parent", "n_children", *[c.cast("bigint").alias(f"own_{n}") for n, c in values.items()],
                     *[F.lit(0).cast("bigint").alias(f"edge_{n}") for n in names]))
    start = materialize(start, "tree")
    alive, rounds = start.drop("n_children"), []
    while True:
        turn = len(rounds)
        # Children of every node: how many, and the edge weights of an only one.
        child = F.min(F.struct("id", *[f"edge_{n}" for n in names]))
        below = (alive.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("n"), child.alias("child"))
                 .withColumnRenamed("parent", "id"))
        seen = alive.join(below, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        leaves = (seen.where((F.col("n") == 0) & F.col("parent").isNotNull())
                  .select(F.col("parent").alias("id"), *[taken(n).alias(f"got_{n}") for n in names]))
        got = leaves.groupBy("id").agg(F.lit(True).alias("raked"), *[F.sum(f"got_{n}").alias(f"got_{n}") for n in names])
        me = turned(F.col("id"), turn)
        spliced = ((F.col("n") == 1) & F.col("parent").isNotNull() & F.col("raked").isNull()
                   & (me < turned(F.col("parent"), turn)) & (me < turned(F.col("child.id"), turn)))
        now = (seen.join(got, "id", "left")
               .withColumn("state", F.when(F.col("n") == 0, "leaf").when(spliced, "spliced").otherwise("kept"))
               .select("id", "parent", "state", "child",
                       *[(F.col(f"own_{n}") + F.coalesce(f"got_{n}", F.lit(0))).alias(f"own_{n}") for n in names],
                       *[f"edge_{n}" for n in names]))
        now = materialize(now, f"round{turn}")
        rounds.append(now)
        if not now.where(F.col("state") != "leaf").limit(1).count():
            break
        # The child of a spliced node moves up and takes what the node had along.
        moved = (now.where(F.col("state") == "spliced")
                 .select(F.col("child.id").alias("id"), F.col("parent").alias("_up"), *[taken(n).alias(f"more_{n}") for n in names]))
        alive = (now.where(F.col("state") == "kept").join(moved, "id", "left")
                 .select("id", F.coalesce("_up", "parent").alias("parent"), *[f"own_{n}" for n in names],
                         *[(F.col(f"edge_{n}") + F.coalesce(f"more_{n}", F.lit(0))).alias(f"edge_{n}") for n in names]))

    totals = None       # of all nodes that went in the rounds walked back so far
    for now in reversed(rounds):
        known = now.where(F.col("state") == "leaf").select("id", *[F.col(f"own_{n}").alias(n) for n in names])
        if totals is not None:
            waiting = now.where(F.col("state") == "spliced").select(
                F.col("id").alias("_node"), F.col("child.id").alias("id"),
                *[(F.col(f"own_{n}") + F.col("child")[f"edge_{n}"]).alias(f"own_{n}") for n in names])
            opened = waiting.join(totals, "id").select(F.col("_node").alias("id"), *[(F.col(n) + F.col(f"own_{n}")).alias(n) for n in names])
            known = totals.unionByName(known).unionByName(opened)
        totals = materialize(known, "totals")
    return start.select("id", "n_children").join(totals, "id")


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations.

    A conversation c is rebuilt from the first h turns of conversation c - c % group
    (all, if it has fewer; none, if there is none), h being crc32(c) % shared, and
    its own turns after the first h.  A node is a different sequence of first turns
    (role, text); the root has none.  Returns conv_id (smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves (nodes without
    children in its subtree), saved_tokens (sum over its subtree of (n_convs - 1) x
    characters of the node's last text) and ends_sha256 (digest of the ascending ids of
    the conversations that end there).

    Null role or text is empty; turns go in order, null first, ties by role, then by a
    digest of the text; repeated rows are turns of their own.  Rows with a null id take
    no part.  A conversation whose turns are all replaced by a missing beginning is a
    member of the root alone.  An empty table gives no rows, not even a root.  Other
    columns are ignored.  Texts of any length are read once, where they are, and
    stay there.  The digest of a node's ends is one text by contract.
    """
    convs, prefixes = rebuilt_prefixes(turns_of(conversations, id_col, turn_col, role_col, text_col), group, shared)
    nodes = materialize(trie_nodes(convs, prefixes), "trie")
    saved = (F.col("n_convs") - 1) * F.col("chars")
    totals = subtree_totals(nodes.select("id", "parent", saved.alias("saved")),
                            {"n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": F.col("saved")})
    return (nodes.join(totals, "id")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))

