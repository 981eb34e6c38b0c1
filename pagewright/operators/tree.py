"""The folder tree: full paths, descendants, cascading deletes."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window, functions as F

from ..session import ensure_checkpoint_dir, materialize
from .ids import global_positions

LEVELS = 8      # walked one by one before the whole tree is numbered


def resolve_paths(inodes: DataFrame) -> DataFrame:
    """Full path of every inode: '/'-joined names from the root down.

    Pointer jumping: each round joins every unfinished row with the row of
    its current ancestor, so the covered part of the path doubles per round
    and a tree of depth d needs about log2(d) rounds.  Finished rows (roots
    reached, or an ancestor missing) are set aside, so they never meet in a
    join on a NULL key.  Each round is checkpointed to the shared folder.  A
    parent id that does not exist gives a NULL path; a cycle raises as soon
    as the covered length exceeds the number of inodes.  Returns (id, path).
    """
    ensure_checkpoint_dir(inodes.sparkSession)
    state = inodes.select("id", F.col("parent_id").alias("anc"), F.concat(F.lit("/"), F.col("name")).alias("path"))
    state = state.checkpoint(eager=True)
    done = state.where(F.col("anc").isNull()).select("id", "path")
    live, nodes, covered = state.where(F.col("anc").isNotNull()), None, 1
    while live.limit(1).count():
        nodes = state.count() if nodes is None else nodes
        if covered > nodes:
            raise ValueError("inode tree has a cycle")
        # An ancestor is finished (its path is whole) or itself still on the way.
        up = (done.select(F.col("id").alias("anc"), F.lit(None).cast("bigint").alias("_anc2"), F.col("path").alias("_pre"))
              .unionByName(live.select(F.col("id").alias("anc"), F.col("anc").alias("_anc2"), F.col("path").alias("_pre"))))
        step = (live.join(up.withColumn("_found", F.lit(True)), "anc", "left")
                .select("id", F.col("_anc2").alias("anc"),
                        F.when(F.col("_found"), F.concat("_pre", "path")).alias("path"))
                .checkpoint(eager=True))
        done = done.unionByName(step.where(F.col("anc").isNull()).select("id", "path"))
        live = step.where(F.col("anc").isNotNull())
        covered *= 2
    return done


def resolve_paths_of(inodes: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Full paths of the ``ids`` inodes only, walking up one level per round.

    The state holds one row per requested inode; each round joins it to the
    tree on the current ancestor (the state is the small side, the tree is
    only scanned).  For a batch of moved inodes this avoids resolving the
    whole table.  Returns (id, path); a missing ancestor gives NULL.  A cycle
    is seen in the data: every row remembers its ancestor of the last round
    that was a power of two, and meeting it again raises."""
    ensure_checkpoint_dir(inodes.sparkSession)
    tree = inodes.select(F.col("id").alias("anc"), F.col("parent_id").alias("_up"), F.col("name").alias("_name"))
    state = (inodes.join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
             .select("id", F.col("parent_id").alias("anc"), F.concat(F.lit("/"), F.col("name")).alias("path"),
                     F.col("id").alias("_mark"))
             .checkpoint(eager=True))
    done, rounds = state.where(F.col("anc").isNull()).select("id", "path"), 0
    live = state.where(F.col("anc").isNotNull())
    while True:
        left, again = live.agg(F.count(F.lit(1)), F.count(F.when(F.col("anc") == F.col("_mark"), 1))).first()
        if not left:
            return done
        if again:
            raise ValueError("inode tree has a cycle")
        rounds += 1
        mark = F.col("anc") if rounds & (rounds - 1) == 0 else F.col("_mark")
        live = (live.withColumn("_mark", mark).join(tree, "anc", "left")
                .select("id", F.col("_up").alias("anc"),
                        F.when(F.col("_name").isNotNull(), F.concat(F.lit("/"), F.col("_name"), F.col("path"))).alias("path"),
                        "_mark")
                .checkpoint(eager=True))
        done = done.unionByName(live.where(F.col("anc").isNull()).select("id", "path"))
        live = live.where(F.col("anc").isNotNull())


def tree_intervals(inodes: DataFrame) -> DataFrame:
    """(id, enter, leave): where a walk through the tree enters and leaves each inode.

    An inode lies below another exactly if its interval lies inside the other's, so a
    subtree is one range of ``enter``.  The walk (children in id order, tops one after
    the other; an inode whose parent is missing is a top) is a linked list of two steps
    per inode, ranked by pointer jumping: about log2(2 n) rounds, whatever the depth.
    Siblings are linked through their place in one global order, so a folder with very many
    children is no task of its own.  Inodes on or below a cycle have no place in
    the walk: their ``enter`` and ``leave`` are null.
    """
    ids = inodes.select("id", "parent_id")
    tops = ids.select(F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    linked = ids.join(tops.hint("merge"), "parent_id", "left").select("id", F.when(F.col("_there"), F.col("parent_id")).alias("up"))
    place = materialize(global_positions(linked, [F.col("up").asc_nulls_first(), "id"], "k"), "places")
    parents = place.select(F.col("id").alias("up"), F.col("k").alias("up_k"))
    numbered = materialize(place.join(parents.hint("merge"), "up", "left").select("id", "k", "up_k"), "numbered")
    first = numbered.where(F.col("up_k").isNotNull()).groupBy(F.col("up_k").alias("k")).agg(F.min("k").alias("child"))
    after = numbered.select((F.col("k") - 1).alias("k"), F.col("up_k").alias("after_up"), F.lit(True).alias("more"))
    both = numbered.join(first.hint("merge"), "k", "left").join(after.hint("merge"), "k", "left")
    sibling = F.coalesce(F.col("more"), F.lit(False)) & F.col("after_up").eqNullSafe(F.col("up_k"))
    # Step 2 k enters inode k, step 2 k + 1 leaves it.
    steps = both.select(F.explode(F.array(
        F.struct((F.col("k") * 2).alias("step"), F.coalesce(F.col("child") * 2, F.col("k") * 2 + 1).alias("then")),
        F.struct((F.col("k") * 2 + 1).alias("step"), F.when(sibling, F.col("k") * 2 + 2).otherwise(F.col("up_k") * 2 + 1).alias("then")))).alias("s"))
    live = materialize(steps.select("s.step", "s.then", F.lit(1).cast("bigint").alias("left")), "walk")
    done = live.where(F.col("then").isNull()).select("step", "left")
    reached, total = 1, live.count()
    live = live.where(F.col("then").isNotNull())
    while reached < 2 * total:          # a step's distance to the end of the walk, covered twice as far each round
        on = (done.select(F.col("step").alias("then"), F.lit(None).cast("bigint").alias("_then"), F.col("left").alias("_left"))
              .unionByName(live.select(F.col("step").alias("then"), F.col("then").alias("_then"), F.col("left").alias("_left"))))
        # Merged, as a broadcast would send the walk through the driver in every round.
        jumped = materialize(live.join(on.hint("merge"), "then").select("step", F.col("_then").alias("then"), (F.col("left") + F.col("_left")).alias("left")), "walk")
        done = materialize(done.unionByName(jumped.where(F.col("then").isNull()).select("step", "left")), "done")
        live = jumped.where(F.col("then").isNotNull())
        if not live.limit(1).count():
            break
        reached *= 2
    length = done.agg(F.coalesce(F.max("left"), F.lit(0))).first()[0]
    at = done.select("step", (F.lit(length) - F.col("left")).alias("at"))
    pair = at.groupBy(F.floor(F.col("step") / 2).alias("k")).agg(F.min("at").alias("enter"), F.max("at").alias("leave"))
    return materialize(numbered.join(pair.hint("merge"), "k", "left").select("id", "enter", "leave"), "intervals")


def inside(intervals: DataFrame, roots: DataFrame, block: int = 1 << 16, most_blocks: int = 10_000) -> DataFrame:
    """Rows of ``intervals`` (with places) that are one of ``roots`` (ids) or below one.

    A running count of open roots along the walk: sums per block of the walk (at most
    ``most_blocks``) are carried over, then counted on inside each block."""
    marked = intervals.where(F.col("enter").isNotNull()).join(roots.select("id").distinct().withColumn("_root", F.lit(1)), "id", "left")
    end = marked.agg(F.coalesce(F.max("leave"), F.lit(0))).first()[0]
    size = max(block, -(-(end + 1) // most_blocks))
    opened = marked.select("id", "enter", "leave", F.col("enter").alias("at"), F.coalesce("_root", F.lit(0)).alias("delta"))
    closed = marked.where(F.col("_root") == 1).select(F.lit(None).cast("bigint").alias("id"), "enter", "leave", F.col("leave").alias("at"), F.lit(-1).alias("delta"))
    walk = materialize(opened.unionByName(closed).withColumn("block", F.floor(F.col("at") / size)), "opened")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = walk.groupBy("block").agg(F.sum("delta").alias("_sum")).select("block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_open"))
    here = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (walk.withColumn("_here", F.sum("delta").over(here)).join(F.broadcast(carried), "block")
            .where(F.col("id").isNotNull() & (F.col("_here") + F.col("_open") > 0)).select("id", "enter", "leave"))


def descendants(inodes: DataFrame, roots: DataFrame, id_col: str = "id", intervals: DataFrame | None = None,
                levels: int = LEVELS) -> DataFrame:
    """Ids of ``roots`` and of every inode below them.

    The first ``levels`` are walked down from the roots, each by a join of the edges with the
    last level.  What goes on below that is found through the intervals of
    :func:`tree_intervals` (used at once if they are passed in): no round per level.
    Inodes on or below a cycle have no interval; those are walked level by level,
    each at most once."""
    ensure_checkpoint_dir(inodes.sparkSession)
    asked = roots.select(F.col(id_col).alias("id")).distinct()
    edges = inodes.select("id", "parent_id")
    if intervals is None:
        found, deeper = _level_by_level(edges.where(F.col("parent_id").isNotNull()), asked, levels)
        if deeper is None:
            return found
        asked, intervals = deeper, tree_intervals(inodes)
    else:
        asked = found = materialize(asked, "roots")
    found = found.unionByName(inside(intervals, asked).select("id"))
    looped = intervals.where(F.col("enter").isNull()).select("id")
    if looped.limit(1).count():
        among = materialize(edges.join(looped, "id", "left_semi"), "looped")
        found = found.unionByName(_level_by_level(among, among.join(asked, "id", "left_semi").select("id"))[0])
    return found.distinct()


def _level_by_level(edges: DataFrame, roots: DataFrame, levels: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Ids reached from ``roots`` over (id, parent_id), a node at most once; and the last level,
    if ``levels`` ended the walk."""
    reached = frontier = roots.checkpoint(eager=True)
    for level in count():
        if level == levels:
            return reached, frontier
        frontier = (edges.join(frontier.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
                    .select("id").distinct().join(reached, "id", "left_anti").checkpoint(eager=True))
        if frontier.limit(1).count() == 0:
            return reached, None
        reached = reached.unionByName(frontier).checkpoint(eager=True)


def cascade_delete(inodes: DataFrame, pages: DataFrame, conversations_inodes: DataFrame,
                   deleted: DataFrame, sources: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Rows removed by deleting ``deleted`` inodes, following ON DELETE
    CASCADE: child inodes, their pages, sources of those pages and links to
    conversations.  Returns (kind, key1, key2)."""
    gone = descendants(inodes, deleted.where(F.col(id_col).isNotNull()), id_col=id_col)
    existing = gone.join(inodes.select("id"), "id", "left_semi")
    gone_pages = pages.join(existing.select(F.col("id").alias("inode_id")), "inode_id", "left_semi")
    links = conversations_inodes.join(existing.select(F.col("id").alias("inode_id")), "inode_id", "left_semi")
    out = (existing.select(F.lit("inode").alias("kind"), F.col("id").alias("key1"),
                           F.lit(None).cast("bigint").alias("key2"))
           .unionByName(gone_pages.select(F.lit("page").alias("kind"), F.col("id").alias("key1"),
                                          F.lit(None).cast("bigint").alias("key2")))
           .unionByName(links.select(F.lit("conversation_link").alias("kind"),
                                     F.col("conversation_id").alias("key1"), F.col("inode_id").alias("key2"))))
    if sources is not None:
        src = sources.join(gone_pages.select(F.col("id").alias("page_id")), "page_id", "left_semi")
        out = out.unionByName(src.select(F.lit("source").alias("kind"), F.col("prompt_id").alias("key1"),
                                         F.col("page_id").alias("key2")))
    return out
