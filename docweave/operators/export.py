"""Exports as ordered lines.

A document of any length is a set of rows (document, place, line); a writer
sorts them by range.  No export builds a whole document in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import camel, one_line, strip
from docweave.operators.ordering import previous
from docweave.operators.trees import STEP


def _title(c: str = "title") -> Column:
    return one_line(F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("Untitled")).otherwise(F.col(c)))


def markmap_lines(walked: DataFrame, with_refs: DataFrame, folder: Column, tree: str = "map_id") -> DataFrame:
    """The outline of each tree: root as H1, others as bullets indented by level; a node with content (``tree, node_id``) is a link to its page."""
    marked = walked.join(with_refs.select(tree, "node_id").distinct().withColumn("_linked", F.lit(True)), [tree, "node_id"], "left").withColumn("_folder", folder)
    title = _title()
    text = F.when(F.col("_linked"), F.concat(F.lit("["), title, F.lit("]("), F.col("_folder"), F.lit("/"), camel(title), F.lit(".md)"))).otherwise(title)
    line = F.when(F.col("level") == 0, F.concat(F.lit("# "), text)).otherwise(F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), text))
    return marked.select(tree, "place", line.alias("line"))


# Signs before the captions of content in an outline.
_SIGNS = {"image": "🖼 ", "code": "🧩 ", "table": "📊 "}


def inline_markmap_lines(walked: DataFrame, refs: DataFrame, tree: str = "map_id") -> DataFrame:
    """The outline with content below its nodes; ``refs`` holds ``tree, node_id, ord, type, element_caption, markdown``.

    A paragraph's first line is the bullet; images, code and tables get their
    caption as bullet; further lines are indented below.  Empty paragraphs vanish.
    """
    indent = F.repeat(F.lit("  "), F.col("level"))
    heads = walked.select(tree, "place", F.lit(-1).cast("long").alias("ord"), F.lit(0).alias("sub"), F.when(F.col("level") == 0, F.concat(F.lit("# "), _title())).otherwise(F.concat(indent, F.lit("- "), _title())).alias("line"))
    joined = refs.join(walked.select(tree, "node_id", "place", "level"), [tree, "node_id"])
    body = strip(F.coalesce("markdown", F.lit("")))
    lines = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))
    kind = F.lower(F.coalesce("type", F.lit("")))
    caption = F.trim(F.coalesce("element_caption", F.lit("")))
    label = F.lit(None).cast("string")
    for k, sign in _SIGNS.items():
        label = F.when(kind == k, F.concat(F.lit("- " + sign), F.when(caption == "", F.lit(k.capitalize())).otherwise(caption))).otherwise(label)
    rendered = F.when(label.isNotNull(), F.concat(F.array(label), lines)).otherwise(F.when(F.size(lines) > 0, F.concat(F.array(F.concat(F.lit("- "), F.element_at(lines, 1))), F.slice(lines, 2, F.size(lines)))).otherwise(lines))
    rows = joined.select(tree, "place", "ord", "level", F.posexplode(rendered).alias("sub", "_l"))
    shown = F.concat(F.repeat(F.lit("  "), F.col("level")), F.when(F.col("sub") == 0, F.lit("  ")).otherwise(F.lit("    ")), F.col("_l"))
    return heads.unionByName(rows.select(tree, "place", "ord", "sub", shown.alias("line")))


def page_lines(walked: DataFrame, refs: DataFrame, tree: str = "map_id") -> DataFrame:
    """The page of every node with content, as parts in order: ``page`` (name), ``ord`` (-2 front matter, -1 title), ``part``.

    A YAML block at the start of the first content goes to the top.  The title
    is left out if the content starts with it.  Captions become H3 unless
    empty or "Teaching note"; questions become H3 with a question mark.
    """
    first = refs.groupBy(tree, "node_id").agg(F.min_by(F.coalesce("markdown", F.lit("")), F.col("ord")).alias("_first"), F.min("ord").alias("_o"))
    start = F.regexp_replace(F.col("_first"), r"^[ \t\n\x0B\f\r]+", "")
    yaml = F.regexp_extract(start, r"(?s)^(---\n.*?\n---)", 1)
    heads = walked.join(first, [tree, "node_id"]).withColumn("_yaml", yaml).withColumn("_rest", F.when(F.col("_yaml") == "", F.col("_first")).otherwise(F.regexp_replace(start, r"(?s)^---\n.*?\n---\n*", "")))
    title = _title()
    opening = F.element_at(F.split(F.regexp_replace("_rest", r"^[ \t\n\x0B\f\r]+", ""), "\n"), 1)
    same = opening.startswith("#") & (F.lower(F.trim(F.substr(opening, F.lit(2)))) == F.lower(title))
    page = camel(title).alias("page")
    tops = heads.where("_yaml <> ''").select(tree, "node_id", page, F.lit(-2).cast("long").alias("ord"), F.col("_yaml").alias("part"))
    titles = heads.where(~same).select(tree, "node_id", page, F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("# "), title).alias("part"))
    body = refs.join(heads.select(tree, "node_id", "title", "_o", "_yaml", "_rest"), [tree, "node_id"])
    text = strip(F.when((F.col("ord") == F.col("_o")) & (F.col("_yaml") != ""), F.col("_rest")).otherwise(F.coalesce("markdown", F.lit(""))))
    caption = F.trim(F.coalesce("element_caption", F.lit("")))
    qa = F.lower(F.coalesce("type", F.lit(""))) == "qa"
    content = F.when(qa, F.concat(F.lit("### ❓ "), F.trim(F.coalesce("q", F.lit(""))), F.lit("\n"), strip(F.coalesce("a", F.lit("")))))
    content = content.when((caption != "") & (F.lower(caption) != "teaching note"), F.concat(F.lit("### "), caption, F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("\n"), text)))).otherwise(text)
    parts = body.select(tree, "node_id", camel(_title()).alias("page"), "ord", content.alias("part"))
    return tops.unionByName(titles).unionByName(parts)


def nested_qa_lines(pairs: DataFrame, document: str, order: list[str], path: str = "heading_path", question: str = "question", answer: str = "answer") -> DataFrame:
    """Questions below the headings of their path: ``place`` columns, ``sub`` and ``line``.

    A heading is printed where its full path first occurs in a document; the
    question is one level deeper; the answer follows as it is.  The first
    occurrence is found by one aggregate per path, not by an ordered scan.
    """
    clean = pairs.withColumn("_path", F.coalesce(F.col(path), F.array().cast("array<string>")))
    place = F.struct(*[F.col(c) for c in order])
    prefixes = clean.where(F.size("_path") > 0).select(document, place.alias("_at"), F.explode(F.transform(F.sequence(F.lit(1), F.size("_path")), lambda n: F.slice("_path", 1, n))).alias("_prefix"))
    firsts = prefixes.groupBy(document, "_prefix").agg(F.min("_at").alias("_at"))
    heads = firsts.select(document, *[F.col("_at")[c].alias(c) for c in order], F.size("_prefix").alias("sub"), F.concat(F.repeat(F.lit("#"), F.size("_prefix")), F.lit(" "), F.element_at("_prefix", -1)).alias("line"))
    asked = clean.select(document, *order, F.lit(100).alias("sub"), F.concat(F.repeat(F.lit("#"), F.size("_path") + 1), F.lit(" "), strip(F.col(question))).alias("line"))
    said = clean.select(document, *order, F.lit(101).alias("sub"), strip(F.coalesce(F.col(answer), F.lit(""))).alias("line"))
    return heads.unionByName(asked).unionByName(said)


def join_parts(parts: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """Formatted chunks as one document in parts: right-stripped, blank line between, line end after the last."""
    last = parts.groupBy(document).agg(F.max(order).alias("_last"))
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0B\f\r]+$", "")
    return parts.join(last, document).select(document, order, F.concat(trimmed, F.when(F.col(order) == F.col("_last"), F.lit("\n")).otherwise(F.lit("\n\n"))).alias("part"))


def transcript_lines(files: DataFrame, path: str = "path", body: str = "body", key: str = "sort_key") -> DataFrame:
    """Merged transcript: ``# directory`` where its name changes, ``## file``, then the text; rows in the order of ``key``.

    The file before is looked up within ranges of the key, so no task sees all files.
    """
    folder = F.regexp_replace(F.col(path), "/?[^/]*$", "")
    directory = F.coalesce(F.element_at(F.split(folder, "/"), -1), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract(F.col(path), "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    named = files.select(F.col(key).alias("sort_key"), directory.alias("_dir"), stem.alias("_stem"), F.coalesce(F.col(body), F.lit("")).alias("_body"))
    seen = previous(named, ["sort_key", "_stem"], ["_dir"])
    changed = F.col("_dir_before").isNull() | (F.col("_dir_before") != F.col("_dir"))
    lines = F.array(
        F.struct(F.lit(0).alias("sub"), F.when(changed, F.concat(F.lit("# "), F.col("_dir"))).alias("line")),
        F.struct(F.lit(1).alias("sub"), F.concat(F.lit("## "), F.col("_stem")).alias("line")),
        F.struct(F.lit(2).alias("sub"), F.col("_body").alias("line")),
    )
    return seen.select("sort_key", F.explode(lines).alias("_l")).select("sort_key", "_l.sub", "_l.line").where("line is not null")


def mindmap_json_lines(walked: DataFrame, refs: DataFrame, tree: str = "map_id") -> DataFrame:
    """The nested JSON of every tree as lines: ``tree, place, part, ord, line``; the lines of a root, in this order, are its JSON.

    A node's first line (part 0) closes the nodes before it that do not
    contain it and opens the node; each content is a line (part 1); part 2
    opens the children; part 3, after the last node of a root, closes all.
    A node may hold any number of contents.
    """
    head = F.regexp_replace(F.to_json(F.struct(F.coalesce("title", F.lit("Untitled")).alias("title"), "node_id")), r"\}$", "")
    opened = walked.select(tree, "place", "level", F.concat(head, F.lit(',"content_refs":[')).alias("_o"))
    seen = previous(opened, [tree, "place"], [tree, "level"])
    inside = F.col(f"{tree}_before").eqNullSafe(F.col(tree)) & (F.col("level") > 0) & (F.col("level_before") >= F.col("level"))
    closing = F.concat(F.repeat(F.lit("]}"), F.col("level_before") - F.col("level") + 1), F.lit(","))
    zero = F.lit(0).cast("long").alias("ord")
    opens = seen.select(tree, "place", F.lit(0).alias("part"), zero, F.concat(F.when(inside, closing).otherwise(F.lit("")), "_o").alias("line"))
    nodes = walked.select(tree, "node_id", "place")
    firsts = refs.groupBy(tree, "node_id").agg(F.min("ord").alias("_first"))
    content = F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("element_id", "type", "element_caption", "markdown", "hash")]))
    held = refs.join(nodes, [tree, "node_id"]).join(firsts, [tree, "node_id"])
    contents = held.select(tree, "place", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(F.when(F.col("ord") == F.col("_first"), "").otherwise(","), content).alias("line"))
    below = walked.select(tree, "place", F.lit(2).alias("part"), zero, F.lit('],"children":[').alias("line"))
    root = F.element_at(F.split("place", STEP), 1).alias("_root")
    last = walked.select(tree, "place", "level", root).groupBy(tree, "_root").agg(F.max_by("level", "place").alias("level"), F.max("place").alias("place"))
    ends = last.select(tree, "place", F.lit(3).alias("part"), zero, F.repeat(F.lit("]}"), F.col("level") + 1).alias("line"))
    return opens.unionByName(contents).unionByName(below).unionByName(ends)
