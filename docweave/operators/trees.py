"""Operators on trees held as adjacency rows.

A tree is a set of rows (tree, node id, parent id, place among siblings,
title).  Walks double their reach with each join over the whole table, so a
tree of any width is spread over all tasks; nothing collects a tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import ids
from docweave.session import cut

#: Merges of one round that are made from one row.
SLOTS = 65_536
#: Between the steps of a place; it sorts before every character of an id, so children follow their parent at once.
STEP = "\x01"


def live_nodes(nodes: DataFrame, tree: str = "map_id") -> DataFrame:
    """Nodes that are not deleted, each once: of repeated rows the one created first (ties: smallest parent, place, title).

    Null trees and null ids are dropped: nothing can refer to them.
    """
    kept = nodes.where(F.col("deleted_at").isNull() & F.col(tree).isNotNull() & F.col("node_id").isNotNull())
    first = kept.groupBy(tree, "node_id").agg(F.min(F.struct("created_at", "parent_id", "sibling_idx", "title", "depth")).alias("_n"))
    return first.select(tree, "node_id", "_n.parent_id", "_n.sibling_idx", "_n.title", "_n.created_at")


def _key(sibling: Column, node: Column) -> Column:
    return F.concat(F.lpad(F.coalesce(sibling, F.lit(0)).cast("string"), 8, "0"), F.lit("~"), node)


def walk(nodes: DataFrame, tree: str = "map_id") -> DataFrame:
    """Preorder walk of all trees from their roots (parent null).

    Adds ``level`` (0 at a root), ``path`` (titles from the root) and
    ``place``, a string whose order within a tree is the preorder: siblings by
    their index, ties by node id.  Nodes that hang on no root are left out.
    A tree may be of any depth; a node below itself that hangs on a root too is
    an error.

    Every node starts with itself and looks up to its parent; in each round it
    puts what the node it looks up to has found before its own path, and looks
    on from there.  So a tree of depth d takes log2(d) joins, and only nodes
    that have not reached a root take part in the next.
    """
    columns = [tree, "node_id", "parent_id", "sibling_idx", "title"]
    start = nodes.select(*columns, F.col("parent_id").alias("_up"), F.array(F.coalesce("title", F.lit(""))).alias("path"), _key(F.col("sibling_idx"), F.col("node_id")).alias("place"))
    start = cut(start)
    done, open_, turning = [start.where("_up is null")], start.where("_up is not null"), []
    steps = F.split("place", STEP)
    turns = F.size(F.array_distinct(steps)) < F.size(steps)
    while not open_.isEmpty():
        known = reduce(DataFrame.unionByName, [*done, open_])
        above = known.select(tree, F.col("node_id").alias("_up"), F.col("path").alias("_path"), F.col("place").alias("_place"), F.col("_up").alias("_next"))
        met = open_.join(above, [tree, "_up"]).select(*columns, F.col("_next").alias("_up"), F.concat("_path", "path").alias("path"), F.concat("_place", F.lit(STEP), "place").alias("place"))
        met = cut(met)
        done.append(met.where("_up is null"))
        going = met.where("_up is not null")
        turning.append(going.where(turns).select(tree, "node_id"))
        open_ = going.where(~turns)
    walked = reduce(DataFrame.unionByName, done).select(*columns, (F.size("path") - 1).alias("level"), "path", "place")
    if turning and not reduce(DataFrame.unionByName, turning).join(walked, [tree, "node_id"], "left_semi").isEmpty():
        raise ValueError("a node is its own ancestor")
    return walked


def with_ids(walked: DataFrame) -> DataFrame:
    """Adds ``new_id``: slug of the path and hash of path, depth and place among siblings."""
    sibling = F.when(F.col("level") == 0, F.lit(0)).otherwise(F.coalesce("sibling_idx", F.lit(0)))
    return walked.withColumn("new_id", ids.node_id(F.col("path"), F.col("level"), sibling))


def with_fingerprint(walked: DataFrame, first_content: DataFrame | None = None, tree: str = "map_id") -> DataFrame:
    """Adds ``ord`` (0 at the root) and ``fingerprint`` of title, ancestors and first content (``tree, node_id, markdown``)."""
    joined = walked.withColumn("_md", F.lit(None).cast("string")) if first_content is None else walked.join(first_content.select(tree, "node_id", F.col("markdown").alias("_md")), [tree, "node_id"], "left")
    ancestors = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    order = F.when(F.col("level") == 0, 0).otherwise(F.coalesce("sibling_idx", F.lit(0))).alias("ord")
    return joined.select(*[c for c in joined.columns if c != "_md"], order, ids.fingerprint(F.col("title"), ancestors, F.col("_md")).alias("fingerprint"))


def child_counts(nodes: DataFrame, tree: str = "map_id") -> DataFrame:
    return nodes.where("parent_id is not null").groupBy(tree, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))


def node_types(walked: DataFrame, tree: str = "map_id") -> DataFrame:
    """Adds ``n_children`` and ``ntype``: leaf; else hub down to level 1; else branch."""
    joined = walked.join(child_counts(walked, tree), [tree, "node_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return joined.withColumn("ntype", F.when(F.col("n_children") == 0, "leaf").when(F.col("level") <= 1, "hub").otherwise("branch"))


def children(walked: DataFrame, tree: str = "map_id") -> DataFrame:
    """One row per edge, in order: ``parent_id``, ``ord`` from 0, ``node_id``.

    The order is taken within segments of equal sibling index first, so a
    parent of any number of children makes no large group unless they share
    one index.
    """
    edges = walked.where("parent_id is not null").select(tree, "parent_id", "node_id", F.coalesce("sibling_idx", F.lit(0)).alias("_s"))
    segment = F.floor(F.col("_s") / 1024).alias("_seg")
    sized = edges.groupBy(tree, "parent_id", segment).agg(F.count(F.lit(1)).alias("_n"))
    before = sized.select(tree, "parent_id", "_seg", (F.sum("_n").over(Window.partitionBy(tree, "parent_id").orderBy("_seg")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(tree, "parent_id", "_seg").orderBy("_s", "node_id"))
    numbered = edges.withColumn("_seg", segment).withColumn("_k", local).join(before, [tree, "parent_id", "_seg"])
    return numbered.select(tree, "parent_id", "node_id", (F.col("_before") + F.col("_k") - 1).alias("ord"))


def levels(walked: DataFrame, tree: str = "map_id") -> DataFrame:
    """Nodes per tree and level."""
    return walked.groupBy(tree, "level").agg(F.count(F.lit(1)).alias("n_nodes"))


def fallback_tags(walked: DataFrame, tree: str = "map_id", first: int = 8) -> DataFrame:
    """Sorted distinct lower-case titles of the first nodes in preorder, blank ones left out."""
    place = F.row_number().over(Window.partitionBy(tree).orderBy("place"))
    title = F.lower(F.trim("title"))
    head = walked.select(tree, "place", title.alias("t")).where("t <> ''").withColumn("_k", place).where(F.col("_k") <= first)
    return head.groupBy(tree).agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tags"))


def merge_schedule(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Pairwise reduction of each group's items in rounds; an odd one is carried to the end of the next round.

    One row per merge: ``round``, ``slot`` (place of the result), ``left`` and
    ``right`` (places in the round before).  Only the group sizes matter, so
    the schedule is computed from one count per group.
    """
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rounds = F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.col("_n"))).cast("int"), F.lit(1)))).alias("round")
    before = F.ceil(F.col("_n") / F.pow(F.lit(2.0), F.col("round") - 1)).cast("long")
    per_round = sizes.where("_n > 1").select(group, "_n", rounds).withColumn("_before", before).where("_before > 1")
    # Blocks first, then the slots of a block, so no row holds an array as long as a group.
    merges = F.floor(F.col("_before") / 2).cast("long")
    blocks = per_round.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((merges - 1) / SLOTS).cast("long"))))
    first = F.col("_block") * F.lit(SLOTS)
    slots = blocks.withColumn("slot", F.explode(F.sequence(first, F.least(first + F.lit(SLOTS), merges) - 1)))
    return slots.select(group, "round", "slot", (F.col("slot") * 2).alias("left"), (F.col("slot") * 2 + 1).alias("right"))


def neighbours(walked: DataFrame, tree: str = "map_id", siblings: int = 36, cousins: int = 72) -> DataFrame:
    """Two bounded arrays per parent: its first children (``sibs``) and its own parent's first grandchildren (``cous``), in order.

    Both are cut to what the lists built from them can use, by a ranked window
    that Spark limits before it shuffles, so a parent with very many children
    costs no more than any other.
    """
    edges = walked.where("parent_id is not null").select(tree, "parent_id", "node_id", "place")
    by_parent = Window.partitionBy(tree, "parent_id").orderBy("place")
    own = (
        edges.withColumn("_k", F.row_number().over(by_parent)).where(F.col("_k") <= siblings)
        .groupBy(tree, "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "node_id"))), lambda x: x["node_id"]).alias("sibs"))
    )
    parents = edges.select(tree, F.col("node_id").alias("parent_id"), F.col("parent_id").alias("grand_id"))
    by_grand = Window.partitionBy(tree, "grand_id").orderBy("place")
    grand = (
        edges.join(parents, [tree, "parent_id"]).withColumn("_k", F.row_number().over(by_grand)).where(F.col("_k") <= cousins)
        .groupBy(tree, "grand_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "node_id"))), lambda x: x["node_id"]).alias("cous"))
    )
    return own.join(parents, [tree, "parent_id"], "left").join(grand, [tree, "grand_id"], "left").select(tree, "parent_id", "sibs", "cous")


def nearest(walked: DataFrame, tree: str = "map_id", lists: DataFrame | None = None) -> DataFrame:
    """Adds the arrays of :func:`neighbours` of its parent to each node; ``lists`` holds them if they are known.

    One row per parent meets its children in one join, after which nothing wide is shuffled.
    """
    lists = neighbours(walked, tree) if lists is None else lists
    empty = F.array().cast("array<string>")
    return walked.select(tree, "node_id", "parent_id").join(lists, [tree, "parent_id"], "left").select(tree, "node_id", "parent_id", F.coalesce("sibs", empty).alias("sibs"), F.coalesce("cous", empty).alias("cous"))


def prereq_candidates(walked: DataFrame, tree: str = "map_id", limit: int = 30, lists: DataFrame | None = None) -> DataFrame:
    """Per node the first candidates, in order: siblings, then children of the grandparent's children; not the node itself."""
    near = nearest(walked, tree, lists)
    both = F.array_distinct(F.concat("sibs", "cous"))
    return near.select(tree, "node_id", F.slice(F.filter(F.slice(both, 1, 200), lambda x: x != F.col("node_id")), 1, limit).alias("candidates"))


def valid_picks(picks: DataFrame, walked: DataFrame, tree: str = "map_id", limit: int = 5) -> DataFrame:
    """Of ``picks`` (tree, node_id, ord, pick) those that are known, not the node itself and not its child; the first few."""
    known = walked.select(tree, F.col("node_id").alias("pick"))
    own = walked.where("parent_id is not null").select(tree, F.col("parent_id").alias("node_id"), F.col("node_id").alias("pick"))
    good = picks.where("pick <> node_id").join(known, [tree, "pick"], "left_semi").join(own, [tree, "node_id", "pick"], "left_anti")
    once = good.groupBy(tree, "node_id", "pick").agg(F.min("ord").alias("ord"))
    k = F.row_number().over(Window.partitionBy(tree, "node_id").orderBy("ord", "pick"))
    return once.withColumn("place", k).where(F.col("place") <= limit).select(tree, "node_id", "place", "pick")


def see_also(walked: DataFrame, prereqs: DataFrame | None = None, tree: str = "map_id", limit: int = 5, lists: DataFrame | None = None) -> DataFrame:
    """Per node up to ``limit`` others, in order: siblings, parent, cousins, without its prerequisites (tree, node_id, array ``prereqs``)."""
    near = nearest(walked, tree, lists)
    empty = F.array().cast("array<string>")
    near = near.withColumn("prereqs", empty) if prereqs is None else near.join(prereqs.select(tree, "node_id", "prereqs"), [tree, "node_id"], "left").withColumn("prereqs", F.coalesce("prereqs", empty))
    parent = F.when(F.col("parent_id").isNull(), empty).otherwise(F.array("parent_id"))
    order = F.array_distinct(F.concat("sibs", parent, "cous"))
    kept = F.filter(order, lambda x: (x != F.col("node_id")) & ~F.array_contains(F.col("prereqs"), x))
    return near.select(tree, "node_id", F.slice(kept, 1, limit).alias("see_also"))
