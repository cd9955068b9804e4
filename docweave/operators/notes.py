"""Teaching notes of tree nodes: front matter, body, closing blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import camel, section, strip_section
from docweave.operators import links as L
from docweave.operators import trees as T
from docweave.session import cut

# Closing blocks of a note, as the note viewer reads them.
_CLOSING = """## {title}
```dataviewjs
// Render clickable {comment}
const items = dv.current().{name} ?? [];
const uniq = dv.array(items).distinct(i => i?.path ?? i);
if (uniq.length) {{
  dv.list(uniq.map(i => `[[${{i}}]]`));
}} else {{
  dv.paragraph("None");
}}
```

"""
PREREQS_BLOCK = _CLOSING.format(title="Prereqs", comment="prereqs from frontmatter `prereqs`", name="prereqs")
SEE_ALSO_BLOCK = _CLOSING.format(title="See also", comment="links from frontmatter `see_also`", name="see_also")


def page_link(folder: Column, title: Column) -> Column:
    return F.concat(folder, F.lit("/"), camel(title), F.lit(".md"))


def _block(name: str, links: Column) -> Column:
    lines = F.array_join(F.transform(links, lambda x: F.concat(F.lit("\n  - "), x)), "")
    return F.concat(F.lit(f"\n{name}:"), lines)


def front_matter(node_id: Column, kind: Column, parent: Column, children: Column, prereqs: Column, see_also: Column, summary: Column, model: Column, run: Column) -> Column:
    """YAML block of a note; the parent's line is left out at a root."""
    head = F.concat(F.lit("---\nid: "), node_id, F.lit("\ntype: "), kind, F.coalesce(F.concat(F.lit("\nparent: "), parent), F.lit("")))
    tail = F.concat(F.lit("\nsummary: "), F.substring(F.coalesce(summary, F.lit("")), 1, 480), F.lit("\nmodel: "), model, F.lit("\nrun_id: "), run, F.lit("\n---"))
    return F.concat(head, _block("children", children), _block("prereqs", prereqs), _block("see_also", see_also), tail)


def child_digest(edges: DataFrame, summaries: DataFrame, tree: str = "map_id") -> DataFrame:
    """Title, path and summary of all children of a node, one line each, in order; ``summaries`` holds ``title, where_, summary``."""
    ranked = edges.join(summaries, [tree, "node_id"], "left")
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("Untitled")), F.lit(" :: [["), F.coalesce("where_", F.lit("")), F.lit("]] :: "), F.coalesce("summary", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("l"))))
    return ranked.groupBy(tree, F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("digest"))


def with_children_section(bodies: DataFrame, edges: DataFrame, typed: DataFrame, folder: Column, tree: str = "map_id") -> DataFrame:
    """Bodies of branches with a section of links to their children at the end, in place of one they may have."""
    lines = L.children_lines(edges, typed, folder, tree)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    sections = lines.groupBy(tree, "node_id").agg(F.concat(F.lit("## Children\n"), F.array_join(listed, "\n")).alias("_section"))
    bare = F.regexp_replace(strip_section("body", "Children"), r"[ \t\n\x0B\f\r]+$", "")
    whole = F.when(F.col("_section").isNull(), bare).when(bare == "", F.col("_section")).otherwise(F.concat(bare, F.lit("\n\n"), F.col("_section")))
    return bodies.join(sections, [tree, "node_id"], "left").select(tree, "node_id", whole.alias("body"))


def assemble(typed: DataFrame, edges: DataFrame, see_also: DataFrame, prereqs: DataFrame, bodies: DataFrame, folder: Column, model: str, run: Column, tree: str = "map_id") -> DataFrame:
    """One synthetic note per node: ``tree, node_id, element_id, markdown``.

    ``typed`` holds the walked nodes with ``ntype``; ``see_also`` and
    ``prereqs`` arrays of ids; ``bodies`` texts.  A body without a heading gets
    the title.  Front matter lists all children; a note is one value, so its size
    follows the number of its children.
    """
    links = typed.select(tree, "node_id", page_link(folder, F.col("title")).alias("link"))
    kids = edges.join(links, [tree, "node_id"]).groupBy(tree, F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "link"))), lambda x: x["link"]).alias("kids"))

    def linked(lists: DataFrame, name: str) -> DataFrame:
        rows = lists.select(tree, F.col("node_id").alias("_n"), F.posexplode(name).alias("_i", "node_id")).join(links, [tree, "node_id"])
        return rows.groupBy(tree, F.col("_n").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "link"))), lambda x: x["link"]).alias(name))

    parents = links.select(tree, F.col("node_id").alias("parent_id"), F.col("link").alias("parent_link"))
    empty = F.array().cast("array<string>")
    joined = (
        typed.join(parents, [tree, "parent_id"], "left").join(kids, [tree, "node_id"], "left").join(linked(see_also, "see_also"), [tree, "node_id"], "left")
        .join(linked(prereqs, "prereqs"), [tree, "node_id"], "left").join(bodies.select(tree, "node_id", "body"), [tree, "node_id"], "left")
    )
    body = F.coalesce("body", F.lit("# Untitled"))
    body = F.when(F.ltrim(body).startswith("#"), body).otherwise(F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n"), body))
    front = front_matter(F.col("node_id"), F.col("ntype"), F.col("parent_link"), F.coalesce("kids", empty), F.coalesce("prereqs", empty), F.coalesce("see_also", empty), section(body, "Summary"), F.lit(model), run)
    text = F.concat(front, F.lit("\n"), body, F.lit("\n\n"), F.lit(PREREQS_BLOCK), F.lit(SEE_ALSO_BLOCK))
    return joined.select(tree, "node_id", F.concat(F.lit("note::"), "node_id").alias("element_id"), "ntype", text.alias("markdown"))


def write_notes(walked: DataFrame, folders: DataFrame | None, folder: Column, asked: Callable[..., DataFrame], model: str, run: Column, tree: str = "map_id") -> DataFrame:
    """Notes of all nodes: leaves from their path, branches from the summaries of their children, prerequisites of leaves as picked.

    Branches end with links to their children; links in any body lead to a page
    of the tree or lose their brackets.

    ``folder`` is an expression over the walked nodes and ``folders`` (one row
    per tree, or none); ``asked`` has the arguments of ``ask``.
    """
    typed = T.node_types(walked, tree) if folders is None else T.node_types(walked, tree).join(folders, tree)
    typed = typed.withColumn("shown", F.coalesce("title", F.lit("Untitled"))).withColumn("where_", F.array_join("path", " / ")).withColumn("none", F.lit(""))
    typed = cut(typed.drop("path", "place", "sibling_idx", "level", "n_children"))
    edges = cut(T.children(walked, tree))
    leaves = cut(asked(typed.where("ntype = 'leaf'"), [tree, "node_id"], ["shown", "where_", "none"], "leaf_note", "body"))
    titles = typed.select(tree, "node_id", "title", "where_")
    summaries = titles.join(leaves.select(tree, "node_id", section("body", "Summary").alias("summary")), [tree, "node_id"], "left")
    digests = child_digest(edges, summaries, tree)
    inner = typed.where("ntype <> 'leaf'").join(digests, [tree, "node_id"], "left")
    branches = with_children_section(asked(inner, [tree, "node_id"], ["shown", "where_", "digest"], "branch_note", "body"), edges, typed, folder, tree)
    allowed = typed.select(tree, camel("title").alias("slug"), page_link(folder, F.col("title")).alias("canonical"))
    bodies = L.repair_links(leaves.select(tree, "node_id", "body").unionByName(branches), allowed, [tree, "node_id"], "body", "body", tree)
    lists = cut(T.neighbours(walked, tree))
    candidates = T.prereq_candidates(walked, tree, lists=lists).join(typed.where("ntype = 'leaf'").select(tree, "node_id"), [tree, "node_id"], "left_semi")
    picks = asked(candidates, [tree, "node_id"], ["node_id", "candidates"], "pick_prereqs", "picked", "array<string>").select(tree, "node_id", F.posexplode("picked").alias("ord", "pick"))
    chosen = T.valid_picks(picks, walked, tree)
    prereqs = cut(chosen.groupBy(tree, "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pick"))), lambda x: x["pick"]).alias("prereqs")))
    return assemble(typed, edges, T.see_also(walked, prereqs, tree, lists=lists), prereqs, bodies, folder, model, run, tree)
