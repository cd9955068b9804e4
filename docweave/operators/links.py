"""Links between node pages: validation and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import camel, one_line, wikilinks


def children_lines(edges: DataFrame, walked: DataFrame, folder: Column, tree: str = "map_id") -> DataFrame:
    """One line ``- [[Folder/Slug|Title]]`` per child, in the page of its parent: ``tree, node_id, ord, line``."""
    titled = walked.select(tree, "node_id", "title", folder.alias("_folder"))
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.lit("Untitled")).otherwise(F.trim("title"))
    line = F.concat(F.lit("- [["), F.col("_folder"), F.lit("/"), camel("title"), F.lit("|"), title, F.lit("]]"))
    return edges.join(titled, [tree, "node_id"]).select(tree, F.col("parent_id").alias("node_id"), "ord", line.alias("line"))


def page_names(pages: DataFrame, tree: str = "map_id") -> DataFrame:
    """Distinct page names of each tree from the titles of its nodes with content."""
    return pages.select(tree, camel(one_line(F.when(F.coalesce("title", F.lit("")) == "", F.lit("Untitled")).otherwise(F.col("title")))).alias("target")).distinct()


def missing_links(texts: DataFrame, names: DataFrame, tree: str = "map_id", key: str = "node_id", text: str = "line") -> DataFrame:
    """Distinct links of each page that lead to no page of the tree (letter case counts): ``tree, key, target``."""
    links = texts.select(tree, key, F.explode(wikilinks(text)).alias("target")).distinct()
    return links.join(names, [tree, "target"], "left_anti").select(tree, key, "target")


def repair_links(texts: DataFrame, allowed: DataFrame, keys: list[str], text: str, out: str, tree: str = "map_id") -> DataFrame:
    """Rewrite links to the canonical page whatever their case or folder; links to no page lose their brackets.

    ``allowed`` holds ``tree, slug, canonical``.  A text is taken apart into
    links and the text between, the links meet their page in an equi-join, and
    the parts of one text are put together again; texts without a link take no
    part in this.  Null texts stay null.
    """
    has_link = F.coalesce(F.contains(F.col(text), F.lit("[[")), F.lit(False))
    untouched = texts.where(~has_link).select(*keys, F.col(text).alias(out))
    texts = texts.where(has_link)
    pattern = r"\[\[[^\]]+\]\]"
    between, links = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    pieces = F.flatten(F.transform(between, lambda t, i: F.array(t, F.coalesce(F.get(links, i), F.lit("")))))
    rows = texts.select(*keys, F.posexplode_outer(pieces).alias("_i", "_p"))
    raw = F.trim(F.regexp_extract("_p", r"^\[\[([^\]]+)\]\]$", 1))
    left = F.element_at(F.split(raw, r"\|"), 1)
    base = F.regexp_replace(F.element_at(F.split(left, "/"), -1), r"(?i)\.md$", "")
    alias = F.when(F.contains(raw, F.lit("|")), F.regexp_replace(raw, r"^[^|]*\|", ""))
    linked = rows.withColumns({"_raw": raw, "_alias": alias, "_slug": F.when(raw != "", F.lower(base))})
    canonical = allowed.groupBy(tree, F.lower("slug").alias("_slug")).agg(F.min("canonical").alias("_to"))
    joined = linked.where("_slug is not null").join(canonical, [tree, "_slug"], "left").unionByName(linked.where("_slug is null").withColumn("_to", F.lit(None).cast("string")))
    shown = F.when(F.col("_slug").isNull(), F.col("_p")).when(F.col("_to").isNull(), F.col("_raw")).otherwise(F.concat(F.lit("[["), F.col("_to"), F.coalesce(F.concat(F.lit("|"), F.col("_alias")), F.lit("")), F.lit("]]")))
    again = joined.withColumn("_s", shown).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_a"), F.max("_i").alias("_m"))
    text_out = F.array_join(F.transform("_a", lambda x: x["_s"]), "")
    return again.select(*keys, F.when(F.col("_m").isNull(), F.lit(None).cast("string")).otherwise(text_out).alias(out)).unionByName(untouched)
