"""Queries on blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import blocks as B
from docweave.session import table


def block_enrichment(spark: SparkSession, root: str) -> DataFrame:
    """Markdown, tokens, atomicity and element id from the raw fields of every live block."""
    live = B.live_blocks(table(spark, root, "blocks"), ["type", "level", "text", "language", "src", "alt", "markdown", "heading_path"])
    return B.enrich(live).select("block_id", "new_markdown", "new_token_count", "new_is_atomic", "new_element_id")


def block_heading_paths(spark: SparkSession, root: str) -> DataFrame:
    live = B.live_blocks(table(spark, root, "blocks"), ["map_id", "pos", "type", "level", "text"])
    return B.heading_paths(live).select("block_id", F.array_join("path", " / ").alias("path"))


def block_types(spark: SparkSession, root: str) -> DataFrame:
    return B.type_histogram(B.live_blocks(table(spark, root, "blocks"), ["map_id", "type", "token_count"]))


def block_top_paths(spark: SparkSession, root: str) -> DataFrame:
    return B.top_heading_paths(B.live_blocks(table(spark, root, "blocks"), ["map_id", "pos", "heading_path", "token_count"]))


def block_types_wide(spark: SparkSession, root: str) -> DataFrame:
    """One row per map, one column per block type."""
    live = B.live_blocks(table(spark, root, "blocks"), ["map_id", "type"])
    kinds = ["heading", "paragraph", "code", "table", "image"]
    return live.groupBy("map_id").pivot("type", kinds).count().select("map_id", *[F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k in kinds])


QUERIES = {f.__name__: f for f in (block_enrichment, block_heading_paths, block_types, block_top_paths, block_types_wide)}

LIVE = "live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ingested_at) rn FROM blocks WHERE deleted_at IS NULL) WHERE rn = 1)"
TOKENS = r"len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\p{{Z}}\t\n\x0B\f\r\x{{85}}]'))"
NORM = r"trim(regexp_replace(regexp_replace({c}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g'), '[\p{{Z}}\t\n\x0B\f\r\x1C-\x1F\x{{85}}]+', ' ', 'g'))"
# Latin spelling of the letters of other alphabets that the test data hold, written for the SQL by itself.
_LATIN = "lower({c})"
for _letters, _spelling in (("ё", "io"), ("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("щ", "shch"), ("ш", "sh"), ("ю", "iu"), ("я", "ia"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("θ", "th"), ("φ", "ph"), ("χ", "kh"), ("ψ", "ps")):
    _LATIN = f"replace({_LATIN}, '{_letters}', '{_spelling}')"
_LATIN = f"translate(strip_accents({_LATIN}), 'абвгдезийклмнопрстуфыэøđłαβγδεζηικλμνξοπρσςτυω', 'abvgdeziiklmnoprstufyeodlabgdezeiklmnxoprsstuo')"
SLUG = rf"regexp_replace(regexp_replace(lower(regexp_replace({_LATIN}, '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_STRIP = r"regexp_replace({c}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"

_MD = """CASE type WHEN 'heading' THEN repeat('#', coalesce(level, 1)) || ' ' || coalesce(text, '')
    WHEN 'code' THEN '```' || coalesce(language, '') || chr(10) || coalesce(text, '') || chr(10) || '```'
    WHEN 'image' THEN '![' || coalesce(alt, '') || '](' || coalesce(src, '') || ')' ELSE coalesce(text, '') END"""
_CONTENT = f"""coalesce(CASE WHEN type = 'image' THEN coalesce(nullif({_STRIP.format(c="src")}, ''), nullif({_STRIP.format(c="alt")}, ''), nullif(array_to_string(heading_path, ' / '), ''))
    ELSE coalesce(nullif(text, ''), nullif(markdown, ''), nullif(alt, ''), nullif(src, '')) END, '')"""

ORACLE = {
    "block_enrichment": f"""WITH {LIVE}, m AS (SELECT block_id, type, {_MD} AS md, {NORM.format(c="(" + _CONTENT + ")")} AS norm FROM live)
        SELECT block_id, md AS new_markdown, {TOKENS.format(c="md")} AS new_token_count, type IN ('code', 'table', 'image') AS new_is_atomic,
        type || '_' || coalesce(nullif(left({SLUG.format(c="CASE WHEN norm = '' THEN type ELSE norm END")}, 8), ''), 'item') || '_' || left(sha1(norm), 8) AS new_element_id FROM m""",
    "block_heading_paths": f"""WITH {LIVE}, h AS (
        SELECT block_id, {", ".join(f"last_value(CASE WHEN type = 'heading' AND level = {n} THEN pos END IGNORE NULLS) OVER w p{n}, last_value(CASE WHEN type = 'heading' AND level = {n} THEN coalesce(text, '') END IGNORE NULLS) OVER w t{n}" for n in range(1, 7))}
        FROM live WINDOW w AS (PARTITION BY map_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
        SELECT block_id, array_to_string(list_filter([{", ".join(f"CASE WHEN p{n} > {'greatest(' + ', '.join(f'coalesce(p{k}, -1)' for k in range(1, n)) + ')' if n > 1 else '-1'} THEN t{n} END" for n in range(1, 7))}], lambda x: x IS NOT NULL), ' / ') AS path FROM h""",
    "block_types": f"WITH {LIVE} SELECT map_id, type, count(*) AS n_blocks, sum(coalesce(token_count, 0))::BIGINT AS tokens FROM live GROUP BY ALL",
    "block_top_paths": f"""WITH {LIVE}, w AS (SELECT map_id, array_to_string(heading_path, ' › ') AS path, sum(CASE WHEN coalesce(token_count, 0) = 0 THEN 1 ELSE token_count END)::BIGINT AS weight, min(pos) AS first_pos
        FROM live WHERE len(heading_path) > 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY weight DESC, first_pos, path) AS place FROM w)
        SELECT map_id, path, weight, first_pos, place FROM r WHERE place <= 3""",
    "block_types_wide": f"""WITH {LIVE} SELECT map_id, {", ".join(f"count(*) FILTER (type = '{k}') AS n_{k}" for k in ["heading", "paragraph", "code", "table", "image"])} FROM live GROUP BY map_id""",
}
