"""Concept trees from headings: the deterministic stand-in for tree, merge and refine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import ids
from docweave.functions.text import normalize_for_id
from docweave.operators.ordering import ordinal
from docweave.session import cut

#: Siblings that a refined tree shows; the others go below a node "More".
SIBLINGS = 6
MORE = "More"


def heading_tree(blocks: DataFrame, document: str = "map_id", keys: list[str] | None = None) -> DataFrame:
    """Nodes of each document's tree of headings: ``path, parent, title, first_pos, n_blocks``.

    Equal paths are one node, so trees of chunks merge by union; titles are
    equal if they are after normalisation and without case, the first spelling
    stays.  ``keys`` part a document into several trees (those of its chunks).
    """
    within = [c for c in keys or [] if c != document]
    paths = blocks.where(F.size("heading_path") > 0).select(document, *within, "pos", F.explode(F.transform(F.sequence(F.lit(1), F.size("heading_path")), lambda n: F.slice("heading_path", 1, n))).alias("_p"))
    key = F.transform("_p", lambda t: F.lower(normalize_for_id(F.coalesce(t, F.lit("")))))
    return (
        paths.groupBy(document, *within, key.alias("path"))
        .agg(F.min_by(F.element_at("_p", -1), "pos").alias("title"), F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_blocks"))
        .withColumn("parent", F.slice("path", 1, F.size("path") - 1))
        .withColumn("depth", F.size("path") - 1)
    )


def refine(tree: DataFrame, document: str = "map_id", siblings: int = SIBLINGS) -> DataFrame:
    """Adds ``sibling_idx`` by first place (``rank`` first, where there is one), and ``more`` for siblings beyond the limit (kept, below a node "More")."""
    ranked = "rank" in tree.columns
    segment = F.floor(F.col("first_pos") / 4096) + (F.col("rank").cast("long") * (1 << 32) if ranked else 0)
    numbered = ordinal(tree, [document, "parent"], [*["rank"] * ranked, "first_pos", "path"], segment, "sibling_idx")
    return numbered.withColumn("sibling_idx", F.col("sibling_idx").cast("int")).withColumn("more", F.col("sibling_idx") >= siblings)


def as_nodes(refined: DataFrame, document: str = "map_id", siblings: int = SIBLINGS) -> DataFrame:
    """Adjacency rows with ids; the parents of the top nodes are null.

    Siblings beyond the limit hang on a node "More" at the end of their
    parent's children; what is below them stays below them.
    """
    made = refined.withColumn("node_id", ids.node_id(F.col("path"), F.col("depth"), F.lit(0)))
    above = F.when(F.size("parent") > 0, ids.node_id(F.col("parent"), F.size("parent") - 1, F.lit(0)))
    more = ids.node_id(F.concat("parent", F.array(F.lit(MORE))), F.size("parent"), F.lit(siblings))
    moved = made.select(
        document, "node_id", F.when(F.col("more"), more).otherwise(above).alias("parent_id"), (F.col("depth") + F.col("more").cast("int")).alias("depth"),
        F.when(F.col("more"), F.col("sibling_idx") - siblings).otherwise(F.col("sibling_idx")).alias("sibling_idx"), "title", "more",
    )
    holders = refined.where("more").select(document, "parent").distinct().select(document, more.alias("node_id"), above.alias("parent_id"), F.size("parent").alias("depth"), F.lit(siblings).alias("sibling_idx"), F.lit(MORE).alias("title"), F.lit(False).alias("more"))
    return moved.unionByName(holders)


def merged_trees(trees: DataFrame, clusters: DataFrame, document: str = "map_id") -> tuple[DataFrame, DataFrame]:
    """Trees of chunks merged within their cluster, and the trees of the clusters merged into one per document.

    ``trees`` are rows of :func:`heading_tree` with ``chunk_index``; ``clusters``
    holds ``document, chunk_index, cluster``.  The union of trees does not
    depend on how they are paired, so each merge is one aggregate in place of
    rounds of pairs.  Clusters count in the order of their first chunk; within
    siblings those of an earlier cluster come first.
    """
    order = clusters.groupBy(document, "cluster").agg(F.min("chunk_index").alias("rank"))
    ranked = trees.join(clusters.select(document, "chunk_index", "cluster"), [document, "chunk_index"]).join(order, [document, "cluster"])
    place = F.struct("rank", "first_pos")
    whole = [F.min_by("title", place).alias("title"), F.min("rank").alias("rank"), F.min("first_pos").alias("first_pos"), F.sum("n_blocks").alias("n_blocks"), F.first("parent").alias("parent"), F.first("depth").alias("depth")]
    by_cluster = ranked.groupBy(document, "cluster", "path").agg(*whole)
    at = F.min(place).alias("_at")
    merged = by_cluster.groupBy(document, "path").agg(at, F.min_by("title", place).alias("title"), F.sum("n_blocks").alias("n_blocks"), F.first("parent").alias("parent"), F.first("depth").alias("depth"))
    return by_cluster.drop("rank"), merged.select(document, "path", "title", F.col("_at.rank").alias("rank"), F.col("_at.first_pos").alias("first_pos"), "n_blocks", "parent", "depth")


def merge_in_rounds(trees: DataFrame, group: list[str], slot: str, tree: str, merge: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """Trees of each group merged in pairs, round by round; an odd one goes to the next round: ``group, tree``.

    For merges that depend on the pairing, as those of a language model.
    ``slot`` numbers the trees of a group from 0; ``merge`` takes the rows with
    ``left`` and ``right`` and their keys and adds ``tree``.
    """
    keys = [*group, "_slot"]
    now = cut(trees.select(*group, F.col(slot).cast("long").alias("_slot"), F.col(tree).alias("tree")))
    while not now.where("_slot > 0").isEmpty():
        first = F.pmod("_slot", F.lit(2)) == 0
        pairs = now.groupBy(*group, F.floor(F.col("_slot") / 2).alias("_slot")).agg(F.max(F.when(first, F.col("tree"))).alias("left"), F.max(F.when(~first, F.col("tree"))).alias("right"))
        made = merge(pairs.where("right is not null"), keys).select(*keys, "tree")
        now = cut(made.unionByName(pairs.where("right is null").select(*keys, F.col("left").alias("tree"))))
    return now.select(*group, "tree")


def place_blocks(weights: DataFrame, nodes: DataFrame, document: str = "map_id", key: str = "block_id", best: int = 3) -> DataFrame:
    """One node per block: that of the heaviest of the block's terms that some title holds.

    ``weights`` are TF-IDF weights (document, key, term, weight).  A term leads
    to one node per document, the first in order that has it, so no pairs of
    blocks and nodes are made; blocks without such a term get no node.
    """
    words = nodes.select(document, "node_id", "place", F.explode(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    led = words.groupBy(document, "term").agg(F.min_by("node_id", "place").alias("target_node_id"))
    hits = weights.join(led, [document, "term"])
    return hits.groupBy(document, key).agg(F.max_by("target_node_id", F.struct(F.round("weight", 9), "term")).alias("target_node_id"), F.round(F.max("weight"), 6).alias("score"))
