"""Operators on typed blocks: current rows, heading paths, Markdown, ids, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.ids import block_content, element_id
from docweave.functions.text import token_count

#: Rows of one document scanned by one task; a longer document is scanned in parts that are joined afterwards.
SEGMENT = 4096


def live_blocks(blocks: DataFrame, columns: list[str] | None = None, **computed: Column) -> DataFrame:
    """Blocks that are not deleted, each delivered block once (its first delivery).

    Only ``columns`` and what is ``computed`` from a row are shuffled; the
    filter reaches the scan, and the ranked window drops repeated deliveries
    before the shuffle too.  Blocks without an id are left out.
    """
    columns = columns if columns is not None else [c for c in blocks.columns if c not in ("block_id", "ingested_at", "deleted_at")]
    kept = blocks.where(F.col("deleted_at").isNull() & F.col("block_id").isNotNull()).select("block_id", "ingested_at", *columns, *[c.alias(n) for n, c in computed.items()])
    first = F.row_number().over(Window.partitionBy("block_id").orderBy("ingested_at"))
    return kept.withColumn("_nth", first).where("_nth = 1").drop("_nth", "ingested_at")


def block_markdown(kind: Column, level: Column, text: Column, language: Column, src: Column, alt: Column) -> Column:
    """A block as Markdown, by its type."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), body))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), body, F.lit("\n```")))
        .when(kind == "image", F.concat(F.lit("!["), F.coalesce(alt, F.lit("")), F.lit("]("), F.coalesce(src, F.lit("")), F.lit(")")))
        .otherwise(body)
    )


def enrich(blocks: DataFrame) -> DataFrame:
    """Adds ``new_markdown``, ``new_token_count``, ``new_is_atomic`` and ``new_element_id`` computed from the raw fields."""
    md = block_markdown(F.col("type"), F.col("level"), F.col("text"), F.col("language"), F.col("src"), F.col("alt"))
    content = block_content(F.col("type"), F.col("text"), F.col("markdown"), F.col("src"), F.col("alt"), F.col("heading_path"))
    return blocks.withColumns(
        {
            "new_markdown": md,
            "new_token_count": token_count(md),
            "new_is_atomic": F.coalesce(F.col("type").isin("code", "table", "image"), F.lit(False)),
            "new_element_id": element_id(F.col("type"), content),
        }
    )


def heading_paths(blocks: DataFrame, document: str = "map_id", order: str = "pos", levels: int = 6) -> DataFrame:
    """Adds ``path``: the open headings at each block, top first; a heading's own path ends with itself.

    A heading of level L is open until a heading of level L or less.  With h(l)
    the last heading of level l so far, level l is open if h(l) stands after
    every h(k), k < l.  "The last so far" is associative, so a document is
    scanned in segments of positions: each segment starts from the carry of the
    segments before it, which is one small row per segment.  No task ever sees
    more than a segment, however long the document.
    """
    heading = F.struct(F.col(order).alias("p"), F.col("text").alias("t"))
    is_level = [F.when((F.col("type") == "heading") & (F.col("level") == n), heading) for n in range(1, levels + 1)]
    parts = blocks.withColumn("_seg", F.floor(F.col(order) / SEGMENT).cast("long"))
    inside = Window.partitionBy(document, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({f"_h{n}": F.last(is_level[n - 1], ignorenulls=True).over(inside) for n in range(1, levels + 1)})
    ends = parts.where(F.col("type") == "heading").groupBy(document, "_seg").agg(*[F.max(is_level[n - 1]).alias(f"_e{n}") for n in range(1, levels + 1)])
    across = Window.partitionBy(document).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    # One row per segment; segments without a heading take the carry of the last one before.
    segments = parts.select(document, "_seg").distinct().join(ends, [document, "_seg"], "left")
    carry = segments.select(document, "_seg", *[F.max(f"_e{n}").over(across).alias(f"_c{n}") for n in range(1, levels + 1)])
    joined = local.join(carry, [document, "_seg"], "left")
    state = [F.coalesce(F.col(f"_h{n}"), F.col(f"_c{n}")) for n in range(1, levels + 1)]
    open_ = []
    for n in range(levels):
        above = [F.coalesce(state[k]["p"], F.lit(-1)) for k in range(n)]
        still = state[n].isNotNull() & (F.lit(True) if not above else state[n]["p"] > (F.greatest(*above) if len(above) > 1 else above[0]))
        open_.append(F.when(still, F.coalesce(state[n]["t"], F.lit(""))))
    return joined.withColumn("path", F.array_compact(F.array(*open_))).drop("_seg", *[f"_h{n}" for n in range(1, levels + 1)], *[f"_c{n}" for n in range(1, levels + 1)])


def type_histogram(blocks: DataFrame, document: str = "map_id") -> DataFrame:
    """Blocks and tokens per document and type."""
    return blocks.groupBy(document, "type").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))


def top_heading_paths(blocks: DataFrame, document: str = "map_id", k: int = 3) -> DataFrame:
    """The ``k`` heaviest heading paths per document: by tokens (0 or null counts as 1), ties by first place."""
    path = F.array_join("heading_path", " › ")
    weighed = (
        blocks.where(F.size("heading_path") > 0)
        .groupBy(document, path.alias("path"))
        .agg(F.sum(F.when(F.coalesce("token_count", F.lit(0)) == 0, 1).otherwise(F.col("token_count"))).alias("weight"), F.min("pos").alias("first_pos"))
    )
    place = F.row_number().over(Window.partitionBy(document).orderBy(F.desc("weight"), "first_pos", "path"))
    return weighed.withColumn("place", place).where(F.col("place") <= k)
