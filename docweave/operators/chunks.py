"""Greedy packing of blocks into token-bounded chunks.

Only narrow rows (ids, sizes, flags) go through the ordered fold; texts are
joined back by chunk afterwards.  The fold of a long document runs in segments
of positions, all at once: what a segment hands on hardly depends on what it is
handed, because the boundaries of chunks soon fall together.  Each segment is
folded as if nothing came in, then again with what the segment before handed
on, and further only where that has changed.  When nothing changes any more,
the segments agree with the fold of the whole document, from the first one on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import cut

#: Positions of one segment of a document.
SEGMENT = 4096
#: Tokens of a chunk whose settings name none.
LIMIT = 2000

PACKED = "block_id long, chunk_index int, ord int, token_count int, role string"


def pack(blocks: DataFrame, document: str = "map_id", max_column: str = "max_tokens", overlap_column: str = "overlap_tokens", strict_overlap: bool = False) -> DataFrame:
    """Membership of blocks in chunks: ``document, block_id, chunk_index, ord, token_count, role``.

    ``blocks`` holds ``document, pos, block_id, type, token_count, is_atomic``
    and the limits.  Per document, in order of place:

    * an atomic block over the limit is a chunk of its own (``oversized``), the
      pending chunk stays as it is;
    * a paragraph over the limit is a chunk of its own (``split``), to be cut
      into parts by :func:`split_paragraph`;
    * a block that would overflow the pending chunk emits it; its last
      non-atomic blocks are carried over (``carried``) until they hold the
      overlap.  The test comes after the addition, so an overlap of 0 carries
      one block unless ``strict_overlap``;
    * what is pending at the end is a chunk.

    Null sizes count as 0, null limits as LIMIT, so that a chunk stays a value;
    blocks of no document are left out.
    """
    narrow = blocks.select(
        document, F.coalesce(F.floor(F.col("pos") / SEGMENT), F.lit(-1)).alias("_seg"), "pos", "block_id", "type", F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.coalesce("is_atomic", F.lit(False)).alias("is_atomic"), F.coalesce(max_column, F.lit(LIMIT)).alias("_max"), F.coalesce(overlap_column, F.lit(0)).alias("_over"),
    ).where(F.col(document).isNotNull())
    along = Window.partitionBy(document).orderBy("_seg")
    segments = narrow.select(document, "_seg").distinct()
    # One row per segment: the state that comes in, the chunks before, and whether it is the last.
    begins = cut(segments.withColumns({"_first": F.lag("_seg").over(along).isNull(), "_last": F.lead("_seg").over(along).isNull(), "_state": F.lit(None).cast("string"), "_base": F.lit(0)}))
    several = begins.where("not (_first and _last)")
    if not several.isEmpty():
        rows = cut(narrow.join(several.select(document, "_seg"), [document, "_seg"], "left_semi"))
        known = cut(several.select(document, "_seg", "_last", "_state").join(_folded(rows, several, document, strict_overlap, False), [document, "_seg"]))
        while True:
            wanted = known.withColumn("_in", F.lag("_out").over(along))
            todo = cut(wanted.where(~F.col("_in").eqNullSafe(F.col("_state"))).select(document, "_seg", "_last", F.col("_in").alias("_state")).withColumn("_base", F.lit(0)))
            if todo.isEmpty():
                break
            again = _folded(rows.join(todo.select(document, "_seg"), [document, "_seg"], "left_semi"), todo, document, strict_overlap, False).join(todo.select(document, "_seg", "_last", "_state"), [document, "_seg"])
            known = cut(known.join(todo.select(document, "_seg"), [document, "_seg"], "left_anti").unionByName(again.select(*known.columns)))
        counted = known.select(document, "_seg", "_last", "_state", (F.sum("_n").over(along) - F.col("_n")).cast("int").alias("_base"))
        begins = begins.where("_first and _last").select(document, "_seg", "_last", "_state", "_base").unionByName(counted)
    return _folded(narrow, begins, document, strict_overlap, True)


def _folded(rows: DataFrame, begins: DataFrame, document: str, strict_overlap: bool, members: bool) -> DataFrame:
    """The fold of each segment from the state it begins with: its chunks' ``members``, or the state it hands on (``_out``) and its number of chunks (``_n``)."""
    kind = rows.schema[document].dataType.simpleString()
    # No nulls among the numbers: they would reach Python as floats, which do not hold every id.
    none = {c: F.lit("" if c == "type" else None if c == "pos" else 0).cast(rows.schema[c].dataType) for c in ("pos", "block_id", "type", "token_count", "is_atomic", "_max", "_over")}
    heads = begins.select(document, "_seg", F.lit(0).alias("_kind"), *[c.alias(n) for n, c in none.items()], "_state", "_base", "_last")
    body = rows.withColumns({"_kind": F.lit(1), "_state": F.lit(None).cast("string"), "_base": F.lit(0), "_last": F.lit(False)}).select(*heads.columns)
    ordered = heads.unionByName(body).repartition(document, "_seg").sortWithinPartitions(document, "_seg", "_kind", "pos", "block_id")
    names = [document, "block_id", "chunk_index", "ord", "token_count", "role"] if members else [document, "_seg", "_out", "_n"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, seg, last, base, chunk, pending, held = None, None, True, 0, 0, [], 0
        out: list[tuple] = []

        def emit(held_members: list[tuple], role: str | None = None) -> None:
            nonlocal chunk
            if members:
                out.extend((doc, b, base + chunk, i, t, role or ("carried" if carried else "packed")) for i, (b, t, _, carried) in enumerate(held_members))
            chunk += 1

        def close() -> None:
            if seg is None:
                return
            if last and pending:
                emit(pending)
            if not members:
                out.append((doc, seg, None if last else json.dumps(pending), chunk))

        for pdf in frames:
            cells = [pdf[c].to_numpy() for c in (document, "_seg", "_kind", "block_id", "type", "token_count", "is_atomic", "_max", "_over", "_state", "_base", "_last")]
            for d, g, k, b, what, t, atomic, most, over, state, before, ends in zip(*cells):
                if k == 0:
                    close()
                    doc, seg, last, base, chunk = d, g, bool(ends), int(before), 0
                    pending = [tuple(m) for m in json.loads(state)] if state else []
                    held = sum(m[1] for m in pending)
                    continue
                b, t, atomic = int(b), int(t), bool(atomic)
                if t > most and (atomic or what == "paragraph"):
                    emit([(b, t, atomic, False)], "oversized" if atomic else "split")
                    continue
                if held + t > most:
                    if pending:
                        emit(pending)
                    carry, held = [], 0
                    for member in reversed(pending):
                        if strict_overlap and held >= over:
                            break
                        if member[2]:
                            continue
                        carry.insert(0, (*member[:3], True))
                        held += member[1]
                        if held >= over:
                            break
                    pending = carry
                pending.append((b, t, atomic, False))
                held += t
            yield pd.DataFrame(out, columns=names)
            out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, f"`{document}` {kind}, {PACKED}" if members else f"`{document}` {kind}, _seg long, _out string, _n int")


def chunk_sizes(packed: DataFrame, document: str = "map_id") -> DataFrame:
    """One row per chunk: members, tokens, whether it is over the limit by itself."""
    return packed.groupBy(document, "chunk_index").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("token_count").alias("tokens"), F.max(F.when(F.col("role") == "oversized", 1).otherwise(0)).alias("is_oversized"))


def chunk_texts(packed: DataFrame, blocks: DataFrame, document: str = "map_id") -> DataFrame:
    """Markdown of each chunk: its blocks that are not empty, a blank line between.

    A chunk is bounded by the limit, so its members may be gathered.
    """
    joined = packed.join(blocks.select("block_id", "markdown"), "block_id").where(F.coalesce("markdown", F.lit("")) != "")
    members = F.array_sort(F.collect_list(F.struct("ord", "markdown")))
    return joined.groupBy(document, "chunk_index").agg(F.array_join(F.transform(members, lambda m: m["markdown"]), "\n\n").alias("md_text"))


def chunk_top_paths(packed: DataFrame, blocks: DataFrame, document: str = "map_id", k: int = 3) -> DataFrame:
    """The heaviest heading paths of each chunk, joined by semicolons; ties by first place."""
    joined = packed.join(blocks.select("block_id", "heading_path"), "block_id").where(F.size("heading_path") > 0)
    weight = F.sum(F.when(F.col("token_count") == 0, 1).otherwise(F.col("token_count"))).alias("w")
    paths = joined.groupBy(document, "chunk_index", F.array_join("heading_path", " › ").alias("path")).agg(weight, F.min("ord").alias("o"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("n"), "o", "path"))), 1, k)
    return paths.groupBy(document, "chunk_index").agg(F.array_join(F.transform(best, lambda x: x["path"]), " ; ").alias("paths"))


_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def split_paragraph(text: str, max_tokens: int) -> list[str]:
    """Parts of at most ``max_tokens`` tokens, cut between lines, sentences, words, in this order of preference."""

    def size(t: str) -> int:
        return len(_TOKEN.findall(t))

    def cut(t: str, level: int) -> list[str]:
        if size(t) <= max_tokens or level > 3:
            return [t]
        units = (t.split("\n") if level == 0 else _SENTENCE.split(t) if level == 1 else t.split(" ") if level == 2 else _TOKEN.findall(t))
        glue = ("\n", " ", " ", "")[level]
        parts, now = [], ""
        for unit in (p for u in units for p in cut(u, level + 1)):
            joined = now + glue + unit if now else unit
            if now and size(joined) > max_tokens:
                parts.append(now)
                now = unit
            else:
                now = joined
        return parts + [now] if now else parts

    return [p.strip() for p in cut(text, 0) if p.strip()]


def split_paragraphs(packed: DataFrame, blocks: DataFrame, limits: DataFrame, document: str = "map_id") -> DataFrame:
    """Parts of the paragraphs that are over the limit: ``block_id, part, text``."""
    over = packed.where("role = 'split'").select("block_id").distinct()
    rows = blocks.select("block_id", "config_name", F.coalesce("markdown", F.lit("")).alias("markdown")).join(over, "block_id", "left_semi").join(limits.select("config_name", "max_tokens"), "config_name")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(b, i, p) for b, t, m in zip(pdf["block_id"], pdf["markdown"], pdf["max_tokens"]) for i, p in enumerate(split_paragraph(t, int(m)))]
            yield pd.DataFrame(found, columns=["block_id", "part", "text"])

    return rows.select("block_id", "markdown", "max_tokens").mapInPandas(run, "block_id long, part int, text string")
