"""Bookkeeping around the mapping of content onto tree nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.ids import content_hash
from docweave.functions.text import strip
from docweave.operators.ordering import keep_first, ordinal

# Block types that can be mapped.
SUPPORTED = ("paragraph", "code", "table", "image")


def caption() -> Column:
    """Caption of a block: its own; of images the alternative text and the end of the path; else the first line; else the end of the path."""
    path = F.coalesce("heading_path", F.array().cast("array<string>"))
    trail3 = F.array_join(F.slice(path, F.greatest(F.size(path) - 2, F.lit(1)), 3), " / ")
    trail2 = F.array_join(F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), 2), " / ")
    alt = F.coalesce(F.when(strip(F.coalesce("alt", F.lit(""))) != "", strip("alt")), F.lit("Image"))
    image = F.when(trail3 != "", F.concat(alt, F.lit(" — "), trail3)).otherwise(alt)
    body = strip(F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("markdown"), F.lit("")))
    other = F.when(body != "", F.substring(F.element_at(F.split(body, "\r\n|[\r\n]"), 1), 1, 160)).otherwise(F.substring(F.when(trail2 != "", trail2).otherwise(F.lit("Content block")), 1, 160))
    return F.coalesce(F.when(F.col("element_caption") != "", F.col("element_caption")), F.when(F.col("type") == "image", image).otherwise(other))


def payload() -> Column:
    """What is sent along for a block: its Markdown; data URLs masked and long sources cut for images."""
    body = F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("markdown", "text", "src")], F.lit(""))
    alt, src = strip(F.coalesce("alt", F.lit(""))), F.coalesce("src", F.lit(""))
    shown = F.concat(F.lit("!["), alt, F.lit("]("))
    image = F.when(src.startswith("data:"), F.concat(shown, F.lit("[data-url])"))).when(F.length(src) > 200, F.concat(shown, F.substring(src, 1, 200), F.lit("…)")))
    return F.when((F.col("type") == "image") & image.isNotNull(), image).otherwise(body)


def with_reason(blocks: DataFrame, document: str = "map_id") -> DataFrame:
    """Adds ``reason``, null for blocks that are queued; tested in the order no_id, unsupported_type, dup_id.

    The first block of an id is found by an aggregate; hot ids (boilerplate)
    are combined on the map side and meet one row each in the join.
    """
    usable = (F.coalesce("element_id", F.lit("")) != "") & F.coalesce(F.col("type").isin(*SUPPORTED), F.lit(False))
    firsts = blocks.where(usable).groupBy(document, "element_id").agg(F.min(F.struct("pos", "block_id")).alias("_first"))
    joined = blocks.join(firsts, [document, "element_id"], "left")
    reason = (
        F.when(F.coalesce("element_id", F.lit("")) == "", "no_id")
        .when(~F.coalesce(F.col("type").isin(*SUPPORTED), F.lit(False)), "unsupported_type")
        .when(F.struct("pos", "block_id") != F.col("_first"), "dup_id")
    )
    return joined.withColumn("reason", reason).drop("_first")


def batch_size(n: Column, override: int | None = None) -> Column:
    """Blocks per batch: ``override`` if there is one; else all below 20; else aiming at 6 to 10 batches of 20 to 80 blocks."""
    if override:
        return F.lit(max(1, int(override)))
    target = F.least(F.greatest(F.bround(n / 60), F.lit(6)), F.lit(10))
    return F.when(n < 20, n).otherwise(F.greatest(F.least(F.ceil(n / target), F.lit(80)), F.lit(20))).cast("int")


def batches(queued: DataFrame, document: str = "map_id", override: int | None = None) -> DataFrame:
    """Number of the batch of each queued block, in order of place."""
    sizes = queued.groupBy(document).agg(F.count(F.lit(1)).alias("_total"))
    numbered = ordinal(queued, [document], ["pos", "block_id"], F.floor(F.col("pos") / 4096), "k").join(sizes, document)
    return numbered.withColumn("batch", F.floor(F.col("k") / batch_size(F.col("_total"), override)).cast("int")).drop("_total")


def ref_markdown() -> Column:
    """Markdown of a mapped block by its type; questions have none."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    fence = F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))
    alt = strip(F.coalesce(F.when(F.col("alt") != "", F.col("alt")), F.lit("image")))
    return (
        F.when(kind == "qa", "")
        .when(kind == "code", F.coalesce(F.when(F.col("markdown") != "", F.col("markdown")), fence))
        .when(kind == "table", F.coalesce("text", F.lit("")))
        .when(kind == "image", F.concat(F.lit("!["), alt, F.lit("]("), F.coalesce("src", F.lit("")), F.lit(")")))
        .otherwise(F.coalesce(F.when(F.col("markdown") != "", F.col("markdown")), F.col("text"), F.lit("")))
    )


def decisions(refs: DataFrame, document: str = "map_id") -> DataFrame:
    """Mapping decisions with an element id, the first per document and id."""
    kept = refs.where(F.coalesce("element_id", F.lit("")) != "").select("ref_id", document, "element_id", "target_node_id", F.lower("type").alias("ref_type"), F.col("element_caption").alias("ref_caption"), "created_at")
    return keep_first(kept, [document, "element_id"], ["created_at", "ref_id"])


def insert_refs(refs: DataFrame, blocks: DataFrame, nodes: DataFrame, document: str = "map_id", questions: DataFrame | None = None) -> DataFrame:
    """Content references as they enter the tree.

    Each decision meets the last block of its id (by place) and its node;
    without a block the reference keeps its type and has no Markdown; without
    a node it is dropped.  Adds ``markdown``, ``hash``, ``ord``.  An id that
    belongs to one of the ``questions`` (document, element_id, q, a; the last
    of an id by q and a) is a question, whatever block has it too, and its
    Markdown is the question as a heading above the answer.
    """
    rest = ["type", "text", "language", "src", "alt", "markdown"]
    last = blocks.where(F.coalesce("element_id", F.lit("")) != "").groupBy(document, "element_id").agg(F.max_by(F.struct(*rest), F.struct("pos", "block_id")).alias("_b"))
    last = last.select(document, "element_id", *[F.col("_b")[c].alias(c) for c in rest])
    known = nodes.select(document, F.col("node_id").alias("target_node_id"))
    joined = decisions(refs, document).join(known, [document, "target_node_id"]).join(last, [document, "element_id"], "left")
    kind = F.coalesce(F.lower("type"), F.col("ref_type"))
    shown = joined.withColumn("_md", F.coalesce(ref_markdown(), F.lit(""))).select(
        document, F.col("target_node_id").alias("node_id"), F.col("ref_id").alias("ord"), "element_id", kind.alias("type"), F.col("ref_caption").alias("element_caption"), F.col("_md").alias("markdown"), F.lit(None).cast("string").alias("q"), F.lit(None).cast("string").alias("a")
    )
    if questions is not None:
        asked = questions.where(F.coalesce("element_id", F.lit("")) != "").groupBy(document, "element_id").agg(F.max(F.struct(F.coalesce("q", F.lit("")).alias("q"), F.coalesce("a", F.lit("")).alias("a"))).alias("_q"))
        both = shown.drop("q", "a").join(asked, [document, "element_id"], "left").withColumns({"q": F.col("_q.q"), "a": F.col("_q.a")})
        is_question = F.col("_q").isNotNull()
        as_text = F.concat(F.lit("## "), F.col("q"), F.lit("\n"), F.col("a"))
        shown = both.withColumns({"type": F.when(is_question, "qa").otherwise(F.col("type")), "markdown": F.when(is_question, as_text).otherwise(F.col("markdown"))}).select(*shown.columns)
    return shown.withColumn("hash", content_hash(F.col("markdown")))


def coverage(questions: DataFrame, refs: DataFrame, nodes: DataFrame, document: str = "map_id") -> DataFrame:
    """Per document: questions, mapped, unmapped, percent (100 if there are none), and how many reach a known node."""
    asked = questions.where(F.col(document).isNotNull()).select(document, "answer_id", "element_id").distinct()
    mapped = refs.where(F.coalesce("element_id", F.lit("")) != "").select(document, "element_id", "target_node_id")
    known = nodes.select(document, F.col("node_id").alias("target_node_id"), F.lit(1).alias("_known"))
    state = mapped.join(known, [document, "target_node_id"], "left").groupBy(document, "element_id").agg(F.max(F.coalesce("_known", F.lit(0))).alias("_known"), F.lit(1).alias("_mapped"))
    joined = asked.join(state, [document, "element_id"], "left")
    totals = joined.groupBy(document).agg(F.count(F.lit(1)).alias("total"), F.count("_mapped").alias("mapped"), F.coalesce(F.sum("_known"), F.lit(0)).alias("inserted"))
    return totals.select(document, "total", "mapped", (F.col("total") - F.col("mapped")).alias("unmapped"), "inserted", F.round(F.when(F.col("total") == 0, 100.0).otherwise(F.col("mapped") * 100.0 / F.col("total")), 4).alias("coverage_pct"))


def unmapped(questions: DataFrame, refs: DataFrame, document: str = "map_id") -> DataFrame:
    """Questions whose element was not mapped."""
    mapped = refs.where(F.coalesce("element_id", F.lit("")) != "").select(document, "element_id")
    return questions.where(F.col(document).isNotNull()).select(document, "answer_id", "element_id").distinct().join(mapped, [document, "element_id"], "left_anti")


def attach_answers(answers: DataFrame, blocks: DataFrame, document: str = "map_id") -> DataFrame:
    """Question and answer pairs with the block they belong to, each pair once; pairs of unknown blocks are dropped."""
    known = blocks.where(F.coalesce("element_id", F.lit("")) != "").groupBy(document, "element_id").agg(F.min_by(F.struct("pos", "heading_path"), F.struct("pos", "block_id")).alias("_b"))
    once = keep_first(answers.where(F.col("element_id").isNotNull()).select("answer_id", document, "element_id", "question", "answer"), ["answer_id"], ["element_id", "question", "answer"])
    return once.join(known, [document, "element_id"]).select("answer_id", document, "element_id", "question", "answer", F.col("_b.pos").alias("pos"), F.col("_b.heading_path").alias("heading_path"))


def pairs_by_block(pairs: DataFrame, document: str = "map_id") -> DataFrame:
    """The pairs of each block: their number, and question and answer of each in order as one text (``pairs``), as large as the block's pairs."""
    said = F.concat(F.lit("## "), F.coalesce("question", F.lit("")), F.lit("\n"), F.coalesce("answer", F.lit("")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("answer_id", said.alias("s")))), lambda x: x["s"])
    return pairs.groupBy(document, "element_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.array_join(listed, "\n\n").alias("pairs"))
