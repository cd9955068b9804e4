"""Splitting oversized items at natural boundaries.

An item larger than its limit is cut into atomic segments (lines, sentences,
clauses, and single tokens where even a clause is too long).  Adjacent segments
stand in a heap ordered by the strength of the boundary between them; the
weakest boundary is merged first as long as the merged piece plus the overlap
fits.  What remains are the strongest boundaries the limit allows.

Sizes are counted in ``word_punct`` tokens: one for each longest run of letters,
digits and underscores, one for every other visible character.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import spread

#: One token; the same pattern holds in Java, RE2 and the ``regex`` module.
WORD_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\t\n\x0B\f\r\x85]"

# Strength of a boundary, weakest first.
INSIDE, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = range(7)


@dataclass(frozen=True)
class Piece:
    start: int  # character at which the piece starts, its overlap included
    own: int  # character at which its own part starts
    end: int
    tokens: int
    overlap: int  # tokens shared with the piece before


def word_punct_count(column: Column) -> Column:
    """Tokens of a text, computed inside the JVM; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PUNCT)), F.lit(0))


#: Closing marks skipped to find the mark that ends a sentence or clause.
_LOOK_BACK = 8
_CLOSERS = "\"')]}»”’*_`"
_SENTENCE_END = set(".!?…。！？")
_CLAUSE_END = set(",;:—–、；：，")


def _strength(text: str, left_end: int, right_start: int) -> int:
    """Boundary between a token that ends at ``left_end`` and the next one."""
    gap = text[left_end:right_start]
    if "\n" in gap or "\r" in gap:
        if text.startswith("#", right_start):
            return HEADING
        return PARAGRAPH if gap.replace("\r\n", "\n").replace("\r", "\n").count("\n") > 1 else LINE
    at = left_end - 1
    for _ in range(_LOOK_BACK):
        if at <= 0 or text[at] not in _CLOSERS:
            break
        at -= 1
    wide = text[at] in "。！？、；：，"  # these need no space after them
    if gap or wide:
        if text[at] in _SENTENCE_END and text[right_start] not in _CLOSERS:
            return SENTENCE
        if text[at] in _CLAUSE_END:
            return CLAUSE
    return SPACE if gap else INSIDE


def split_text(text: str, max_tokens: int, overlap_tokens: int, pattern=None) -> list[Piece]:
    """Pieces of at most ``max_tokens`` tokens; their own parts joined give the text.

    Each piece but the first starts with the last ``overlap_tokens`` tokens
    before its own part (fewer if there are fewer).  An overlap that the limit
    can not hold, as it is no smaller, is taken as half the limit.  A limit
    below 1 can not be kept either: then every token is a piece.
    """
    import regex

    pattern = pattern or regex.compile(WORD_PUNCT)
    spans = [m.span() for m in pattern.finditer(text)]
    n = len(spans)
    limit = max(1, max_tokens)
    if n <= limit:
        return [Piece(0, 0, len(text), n, 0)]
    overlap = max(0, overlap_tokens)
    if overlap >= limit:
        overlap = limit // 2
    room = limit - overlap

    strength = [0] + [_strength(text, spans[i - 1][1], spans[i][0]) for i in range(1, n)]
    # Atomic segments: cut at every boundary of a line; where such a segment is too long, at weaker ones, down to tokens.
    starts = _segments(strength, 0, n, room, LINE)

    ends = starts[1:] + [n]
    count = len(starts)
    before = list(range(-1, count - 1))
    after = list(range(1, count)) + [-1]
    version = [0] * count
    dead = [False] * count
    # Of equal boundaries the first merges first, so that pieces fill up from the left.
    heap = [(strength[starts[i + 1]], i, ends[i + 1] - starts[i], 0, 0) for i in range(count - 1)]
    heapq.heapify(heap)
    while heap:
        _, i, size, vi, vj = heapq.heappop(heap)
        j = after[i]
        if dead[i] or j < 0 or version[i] != vi or version[j] != vj:
            continue
        # The first piece has no overlap before it.
        if size > (limit if i == 0 else room):
            continue
        dead[j] = True
        ends[i] = ends[j]
        version[i] += 1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0:
                heapq.heappush(heap, (strength[starts[b]], a, ends[b] - starts[a], version[a], version[b]))
    pieces, i = [], 0
    while i >= 0:
        lo, hi = starts[i], ends[i]
        back = max(0, lo - overlap)
        own = 0 if i == 0 else spans[lo][0]
        end = spans[ends[i]][0] if hi < n else len(text)
        pieces.append(Piece(0 if i == 0 else spans[back][0], own, end, hi - back, lo - back))
        i = after[i]
    return pieces


def _segments(strength: list[int], lo: int, hi: int, room: int, level: int) -> list[int]:
    """First tokens of the atomic segments of tokens lo..hi."""
    cuts = [lo] + [i for i in range(lo + 1, hi) if strength[i] >= level]
    if level == INSIDE:
        return cuts
    out = []
    for a, b in zip(cuts, cuts[1:] + [hi]):
        out += [a] if b - a <= room else _segments(strength, a, b, room, level - 1)
    return out


def split_oversized(
    items: DataFrame, limits: DataFrame, key: str = "block_id", text_column: str = "markdown", config_column: str = "config_name", max_column: str = "max_tokens", overlap_column: str = "overlap_tokens"
) -> DataFrame:
    """All items of ``items`` as pieces within the limits of their configuration.

    Result: ``key``, ``piece_no`` (from 0), ``n_pieces``, ``start`` and ``own``
    (characters at which the piece and its own part start), ``n_tokens``,
    ``n_overlap``, ``piece``.  Items within the limit, null and empty texts and
    items without a known limit are one piece (of null text: null).  Repeated
    rows give repeated pieces.  Extra columns are ignored.

    Counting runs inside the JVM; only oversized items reach Python, and no
    item is shuffled: the limits are a small table whose size Spark checks
    before it broadcasts them.
    """
    limit = limits.groupBy(F.col(config_column).alias("_config")).agg(F.min(max_column).alias("_max"), F.min(overlap_column).alias("_overlap"))
    narrow = spread(items.select(F.col(key), F.col(text_column).alias("_text"), F.col(config_column).alias("_config")))
    sized = narrow.join(limit, "_config", "left").withColumn("_n", word_punct_count(F.col("_text")))
    fits = F.col("_max").isNull() | (F.col("_n") <= F.col("_max"))
    kind = items.schema[key].dataType.simpleString()
    whole = sized.where(fits).select(
        key, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.lit(0).alias("own"), F.col("_n").cast("int").alias("n_tokens"), F.lit(0).alias("n_overlap"), F.col("_text").alias("piece")
    )
    return whole.unionByName(_cut(sized.where(~fits), key, kind))


def _cut(sized: DataFrame, key: str, kind: str) -> DataFrame:
    names = [key, "piece_no", "n_pieces", "start", "own", "n_tokens", "n_overlap", "piece"]
    schema = f"`{key}` {kind}, piece_no int, n_pieces int, start int, own int, n_tokens int, n_overlap int, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(WORD_PUNCT)
        for batch in batches:
            row, numbers, shown = [], [], []
            for at, (text, most, overlap) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                pieces = split_text(text, most, overlap or 0, pattern)
                row += [at] * len(pieces)
                numbers += [(i, len(pieces), p.start, p.own, p.tokens, p.overlap) for i, p in enumerate(pieces)]
                shown += [text[p.start : p.end] for p in pieces]
            columns = list(zip(*numbers)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int32()) for c in columns], pa.array(shown, pa.string())], names=names)

    return sized.select(key, "_text", "_max", "_overlap").mapInArrow(run, schema)


def oversized_items(items: DataFrame, limits: DataFrame, key: str = "block_id", **columns: str) -> DataFrame:
    """Ids of the items that come out of :func:`split_oversized` in several pieces, each once."""
    return split_oversized(items, limits, key, **columns).where("n_pieces > 1").select(key).distinct()
