"""Queries on chunks, readers, subtitles, links and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.functions.text import camel
from docweave.operators import blocks as B
from docweave.operators import chunks as C
from docweave.operators import export as E
from docweave.operators import links as L
from docweave.operators import trees as T
from docweave.plans.block_queries import _STRIP, LIVE
from docweave.plans.tree_queries import _CAMEL, _REFS, _TITLE, WALK, _refs, _walk
from docweave.session import table
from docweave.sources import markdown as R


def _packed(spark: SparkSession, root: str) -> DataFrame:
    sized = B.live_blocks(table(spark, root, "blocks"), ["map_id", "pos", "type", "config_name", "is_atomic"], token_count=X.token_count("markdown"))
    return C.pack(sized.join(table(spark, root, "chunk_configs"), "config_name", "left"))


def chunk_pack(spark: SparkSession, root: str) -> DataFrame:
    """Membership of the live blocks in chunks under the settings of their runs."""
    return _packed(spark, root)


def chunk_sizes(spark: SparkSession, root: str) -> DataFrame:
    return C.chunk_sizes(_packed(spark, root))


def chunk_texts(spark: SparkSession, root: str) -> DataFrame:
    live = B.live_blocks(table(spark, root, "blocks"), ["markdown"])
    return C.chunk_texts(_packed(spark, root), live).select("map_id", "chunk_index", F.md5("md_text").alias("md5"))


def chunk_top_paths(spark: SparkSession, root: str) -> DataFrame:
    return C.chunk_top_paths(_packed(spark, root), B.live_blocks(table(spark, root, "blocks"), ["heading_path"]))


def chunk_split_parts(spark: SparkSession, root: str) -> DataFrame:
    """Parts of the paragraphs that are larger than a chunk."""
    live = B.live_blocks(table(spark, root, "blocks"), ["config_name", "markdown"])
    return C.split_paragraphs(_packed(spark, root), live, table(spark, root, "chunk_configs"))


def chunk_export(spark: SparkSession, root: str) -> DataFrame:
    """All chunks of a map as the parts of one document."""
    live = B.live_blocks(table(spark, root, "blocks"), ["markdown"])
    parts = E.join_parts(C.chunk_texts(_packed(spark, root), live), "map_id", "chunk_index", "md_text")
    return parts.select("map_id", "chunk_index", F.length("part").alias("n_chars"), F.md5("part").alias("md5"))


def _notes(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents", ["doc_id", "text"]).where("text is not null")
    return documents.where(~X.is_html_page(F.col("text")) & ~X.is_subtitles(F.col("text")))


def read_markdown_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of all Markdown notes among the documents."""
    return R.markdown_blocks(_notes(spark, root))


def read_question_guides(spark: SparkSession, root: str) -> DataFrame:
    """Headings with a text below them, as questions and answers, of all Markdown notes."""
    return R.question_blocks(_notes(spark, root))


def read_outlines(spark: SparkSession, root: str) -> DataFrame:
    """Headings and bullets of all documents, read as outlines."""
    return R.outline_nodes(table(spark, root, "documents", ["doc_id", "text"]))


def read_html(spark: SparkSession, root: str) -> DataFrame:
    """Markdown of all HTML pages among the documents."""
    return R.html_markdown(table(spark, root, "documents", ["doc_id", "text"]).where(X.is_html_page(F.col("text"))))


def subtitle_clean(spark: SparkSession, root: str) -> DataFrame:
    """Spoken text of all subtitle documents."""
    return table(spark, root, "documents", ["doc_id", "text"]).where("text like '%-->%'").select("doc_id", X.clean_subtitles("text").alias("body"))


def subtitle_transcript(spark: SparkSession, root: str) -> DataFrame:
    """Merged transcript of the files that end in .srt or .vtt, in natural order of their paths."""
    files = table(spark, root, "documents", ["path", "text"]).where("lower(path) rlike '\\.(srt|vtt)$' and text is not null")
    return E.transcript_lines(files.select("path", X.clean_subtitles("text").alias("body"), X.natural_key("path").alias("sort_key")))


def natural_sort(spark: SparkSession, root: str) -> DataFrame:
    """Place of each path in natural order, by its key."""
    return table(spark, root, "documents", ["doc_id", "path"]).where("path is not null").select("doc_id", X.natural_key("path").alias("sort_key"))


def text_sanitized(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents", ["doc_id", "text"]).where("text is not null").select("doc_id", F.md5(X.sanitize_markdown("text")).alias("md5"))


def text_payload(spark: SparkSession, root: str) -> DataFrame:
    """The first filled content of every live block."""
    live = B.live_blocks(table(spark, root, "blocks"), ["markdown", "text", "alt", "src"])
    return live.select("block_id", X.first_filled("text", "markdown", "alt", "src").alias("payload"))


def text_sections(spark: SparkSession, root: str) -> DataFrame:
    """The section "Further reading" of every document: its summary, and the length of the text without it."""
    documents = table(spark, root, "documents", ["doc_id", "text"]).where("text like '%## Further reading%'")
    return documents.select("doc_id", X.section("text", "Further reading").alias("summary"), F.length(X.strip_section("text", "Further reading")).alias("n_rest"))


def _child_lines(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    maps = table(spark, root, "maps", ["map_id", "run_name"])
    walked = _walk(spark, root).join(maps, "map_id")
    return walked, L.children_lines(T.children(walked), walked, camel("run_name"))


def link_validation(spark: SparkSession, root: str) -> DataFrame:
    """Links of child lists that lead to nodes without a page."""
    walked, lines = _child_lines(spark, root)
    paged = walked.join(_refs(spark, root).select("map_id", "node_id").distinct(), ["map_id", "node_id"], "left_semi")
    return L.missing_links(lines, L.page_names(paged))


def link_repair(spark: SparkSession, root: str) -> DataFrame:
    """Child lists with links in lower case and without a folder, repaired."""
    walked, lines = _child_lines(spark, root)
    broken = lines.select("map_id", "node_id", "ord", F.regexp_replace(F.lower("line"), r"\[\[[^/\]]*/", "[[").alias("line"))
    paged = walked.join(_refs(spark, root).select("map_id", "node_id").distinct(), ["map_id", "node_id"], "left_semi")
    allowed = paged.select("map_id", camel("title").alias("slug"), F.concat(camel("run_name"), F.lit("/"), camel("title"), F.lit(".md")).alias("canonical"))
    return L.repair_links(broken, allowed, ["map_id", "node_id", "ord"], "line", "fixed")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_pack, chunk_sizes, chunk_texts, chunk_top_paths, chunk_split_parts, chunk_export, read_markdown_blocks, read_question_guides, read_outlines,
        read_html, subtitle_clean, subtitle_transcript, natural_sort, text_sanitized, text_payload, text_sections, link_validation, link_repair,
    )
}

_TOKENS = r"len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\p{{Z}}\t\n\x0B\f\r\x{{85}}]'))"
# The fold, one block of every map per step: the pending chunk as a list, and what the step emits.
_PACK = f"""WITH RECURSIVE {LIVE}, sq AS (SELECT l.map_id, l.block_id, l.type, coalesce(l.is_atomic, false) AS a, {_TOKENS.format(c="l.markdown")}::INTEGER AS t, c.max_tokens AS mx, c.overlap_tokens AS ov,
        row_number() OVER (PARTITION BY l.map_id ORDER BY pos, block_id) AS k, count(*) OVER (PARTITION BY l.map_id) AS n FROM live l JOIN chunk_configs c USING (config_name)),
    st AS (
        SELECT map_id, 0::BIGINT AS k, [] :: STRUCT(b BIGINT, t INTEGER, a BOOLEAN, c BOOLEAN)[] AS cur, 0 AS held, [] :: STRUCT(b BIGINT, t INTEGER, a BOOLEAN, c BOOLEAN)[] AS out, '' AS role, max(n) AS n FROM sq GROUP BY map_id
        UNION ALL
        SELECT map_id, k,
            CASE WHEN alone THEN cur WHEN NOT over THEN list_append(cur, me) ELSE list_append(carry, me) END,
            CASE WHEN alone THEN held WHEN NOT over THEN held + t ELSE coalesce(list_sum(list_transform(carry, lambda x: x.t)), 0)::INTEGER + t END,
            CASE WHEN alone THEN [me] WHEN over THEN cur ELSE [] END, CASE WHEN alone AND a THEN 'oversized' WHEN alone THEN 'split' ELSE '' END, n
        FROM (SELECT *, list_transform(na[len(na) - coalesce(list_filter(range(1, len(na) + 1), lambda j: list_sum(list_transform(na[len(na) - j + 1:], lambda x: x.t)) >= ov)[1], len(na)) + 1:], lambda x: {{'b': x.b, 't': x.t, 'a': x.a, 'c': true}}) AS carry
            FROM (SELECT s.map_id, q.k, s.cur, s.held, q.t, q.a, q.ov, s.n, {{'b': q.block_id, 't': q.t, 'a': q.a, 'c': false}} AS me, q.t > q.mx AND (q.a OR q.type = 'paragraph') AS alone, s.held + q.t > q.mx AS over, list_filter(s.cur, lambda x: NOT x.a) AS na
                FROM st s JOIN sq q ON q.map_id = s.map_id AND q.k = s.k + 1))),
    ch AS (SELECT map_id, k, out, role FROM st WHERE len(out) > 0 UNION ALL SELECT map_id, k + 1, cur, '' FROM st WHERE k = n AND len(cur) > 0),
    nm AS (SELECT map_id, (row_number() OVER (PARTITION BY map_id ORDER BY k) - 1)::INTEGER AS chunk_index, out, role FROM ch),
    pk AS (SELECT map_id, x.b AS block_id, chunk_index, (i - 1)::INTEGER AS ord, x.t AS token_count, CASE WHEN role <> '' THEN role WHEN x.c THEN 'carried' ELSE 'packed' END AS role
        FROM (SELECT map_id, chunk_index, role, unnest(range(1, len(out) + 1)) AS i, out FROM nm) z, LATERAL (SELECT out[i] AS x) y)"""
_SRT = r"regexp_replace(text, '\x{FEFF}', '', 'g')"
_TIME = r"([0-9]+:)?[0-9]{1,2}:[0-9]{2}([.,][0-9]+)?"
_CLEAN = _SRT
_CLEAN = rf"regexp_replace({_CLEAN}, '^(?i:WEBVTT)[^\n]*\n+', '')"
_CLEAN = rf"regexp_replace({_CLEAN}, '(?m)^[ \t\r\x0B\f]*{_TIME}[ \t\r]*-->[ \t\r]*{_TIME}[ \t\r]*$', '', 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '(?m)^[0-9]+[ \t\r]*$', '', 'g')"
_CLEAN = rf"regexp_replace({_CLEAN}, '\n[ \t\n\x0B\f\r]*\n', chr(10), 'g')"
_CLEAN = _STRIP.format(c=_CLEAN)
_NATURAL = "array_to_string(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN chr(1) || printf('%010d', len(regexp_replace(p, '^0+([0-9])', '\\1'))) || '.' || regexp_replace(p, '^0+([0-9])', '\\1') ELSE p END), '')"
_LINES = f"""WITH RECURSIVE {WALK}, {_REFS}, ed AS (SELECT map_id, parent_id, node_id, title, row_number() OVER (PARTITION BY map_id, parent_id ORDER BY coalesce(sibling_idx, 0), node_id) - 1 AS ord FROM w WHERE parent_id IS NOT NULL),
    nl AS (SELECT ed.map_id, ed.parent_id AS node_id, ord, {_CAMEL.format(c="run_name")} AS fo, {_CAMEL.format(c="coalesce(title, '')")} AS sl, CASE WHEN trim(coalesce(title, '')) = '' THEN 'Untitled' ELSE trim(title) END AS ti FROM ed JOIN maps m ON m.map_id = ed.map_id),
    pg AS (SELECT DISTINCT w.map_id, {_CAMEL.format(c=_TITLE)} AS name FROM w WHERE EXISTS (SELECT 1 FROM rf WHERE rf.map_id = w.map_id AND rf.node_id = w.node_id))"""

# Every line that is a heading or a bullet is a node; it hangs on the last node of a smaller depth since the last root, else on that root.
_OUTLINES = r"""WITH RECURSIVE t AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]') AS ls FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM t),
    h AS (SELECT doc_id, pos, regexp_extract(line, '^(#{1,6})[\s\p{Z}\x1C-\x1F\x{85}]+(.*)$', 1) AS hash, regexp_extract(line, '^#{1,6}[\s\p{Z}\x1C-\x1F\x{85}]+(.*)$', 1) AS ht,
        regexp_matches(line, '^[\s\p{Z}\x1C-\x1F\x{85}]*-[\s\p{Z}\x1C-\x1F\x{85}]+') AS bul, regexp_extract(line, '^([\s\p{Z}\x1C-\x1F\x{85}]*)-', 1) AS ind, regexp_extract(line, '^[\s\p{Z}\x1C-\x1F\x{85}]*-[\s\p{Z}\x1C-\x1F\x{85}]+(.*)$', 1) AS bt FROM l),
    n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS no, hash <> '' AS head, CASE WHEN hash <> '' THEN length(hash) - 1 ELSE length(ind) // 2 END AS d,
        regexp_replace(CASE WHEN hash <> '' THEN ht ELSE bt END, '^[\s\p{Z}\x1C-\x1F\x{85}]+|[\s\p{Z}\x1C-\x1F\x{85}]+$', '', 'g') AS t FROM h WHERE hash <> '' OR bul),
    r AS (SELECT *, sum(CASE WHEN no = 0 OR (head AND d = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS seg FROM n),
    g AS (SELECT *, min(no) OVER (PARTITION BY doc_id, seg) AS root FROM r),
    q AS (SELECT g.doc_id, g.no, g.root, g.t, CASE WHEN g.no = g.root THEN NULL ELSE coalesce(max(b.no), g.root) END AS par FROM g LEFT JOIN g b ON b.doc_id = g.doc_id AND b.seg = g.seg AND b.no < g.no AND b.d < g.d GROUP BY g.doc_id, g.no, g.root, g.t),
    w AS (SELECT doc_id, no, par, t, 0 AS depth FROM q WHERE par IS NULL UNION ALL SELECT q.doc_id, q.no, q.par, q.t, w.depth + 1 FROM q JOIN w ON w.doc_id = q.doc_id AND w.no = q.par)
    SELECT doc_id, no::INTEGER AS node_no, par::INTEGER AS parent_no, depth, (row_number() OVER (PARTITION BY doc_id, par ORDER BY no) - 1)::INTEGER AS sibling_idx,
        CASE WHEN regexp_full_match(t, '\[.+?\]\(.*?\)') THEN regexp_extract(t, '^\[(.+?)\]\(.*?\)$', 1) ELSE t END AS title FROM w"""

ORACLE = {
    "read_outlines": _OUTLINES,
    "chunk_pack": f"{_PACK} SELECT * FROM pk",
    "chunk_sizes": f"{_PACK} SELECT map_id, chunk_index, count(*) AS n_blocks, sum(token_count)::BIGINT AS tokens, max(CASE WHEN role = 'oversized' THEN 1 ELSE 0 END) AS is_oversized FROM pk GROUP BY ALL",
    "chunk_texts": f"{_PACK} SELECT pk.map_id, chunk_index, md5(string_agg(markdown, chr(10) || chr(10) ORDER BY ord)) AS md5 FROM pk JOIN live USING (block_id) WHERE coalesce(markdown, '') <> '' GROUP BY ALL",
    "chunk_top_paths": f"""{_PACK}, pp AS (SELECT pk.map_id, chunk_index, array_to_string(heading_path, ' › ') AS path, sum(CASE WHEN pk.token_count = 0 THEN 1 ELSE pk.token_count END) AS wt, min(ord) AS o FROM pk JOIN live USING (block_id) WHERE len(heading_path) > 0 GROUP BY ALL),
        rr AS (SELECT *, row_number() OVER (PARTITION BY map_id, chunk_index ORDER BY wt DESC, o, path) AS r FROM pp) SELECT map_id, chunk_index, string_agg(path, ' ; ' ORDER BY r) AS paths FROM rr WHERE r <= 3 GROUP BY ALL""",
    "chunk_export": f"""{_PACK}, tx AS (SELECT pk.map_id, chunk_index, string_agg(markdown, chr(10) || chr(10) ORDER BY ord) AS md FROM pk JOIN live USING (block_id) WHERE coalesce(markdown, '') <> '' GROUP BY ALL)
        SELECT map_id, chunk_index, (length(regexp_replace(md, '[ \\t\\n\\x0B\\f\\r]+$', '')) + CASE WHEN chunk_index = max(chunk_index) OVER (PARTITION BY map_id) THEN 1 ELSE 2 END)::INTEGER AS n_chars,
            md5(regexp_replace(md, '[ \\t\\n\\x0B\\f\\r]+$', '') || CASE WHEN chunk_index = max(chunk_index) OVER (PARTITION BY map_id) THEN chr(10) ELSE chr(10) || chr(10) END) AS md5 FROM tx""",
    "subtitle_clean": f"SELECT doc_id, {_CLEAN} AS body FROM documents WHERE text LIKE '%-->%'",
    "subtitle_transcript": f"""WITH f AS (SELECT path, {_NATURAL} AS sort_key, {_CLEAN} AS body, string_split(regexp_replace(path, '/?[^/]*$', ''), '/')[-1] AS dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem
            FROM documents WHERE regexp_matches(lower(path), '\\.(srt|vtt)$') AND text IS NOT NULL),
        g AS (SELECT *, lag(dir) OVER (ORDER BY sort_key, stem) AS prev FROM f)
        SELECT sort_key, 0 AS sub, '# ' || dir AS line FROM g WHERE prev IS NULL OR prev <> dir UNION ALL SELECT sort_key, 1, '## ' || stem FROM g UNION ALL SELECT sort_key, 2, coalesce(body, '') FROM g""",
    "natural_sort": f"SELECT doc_id, {_NATURAL} AS sort_key FROM documents WHERE path IS NOT NULL",
    "text_sanitized": """WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\\x{FEFF}', '') AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5(CASE WHEN starts_with(t, '```') THEN chr(10) || t ELSE t END) AS md5 FROM t""",
    "text_payload": f"WITH {LIVE} SELECT block_id, coalesce({', '.join(f'CASE WHEN {_STRIP.format(c=c)} <> {chr(39)*2} THEN {c} END' for c in ('text', 'markdown', 'alt', 'src'))}) AS payload FROM live",
    # A section ends at the next line that starts with two number signs and a space.
    "text_sections": """WITH d AS (SELECT doc_id, chr(10) || text AS t FROM documents WHERE text LIKE '%## Further reading%'),
        s AS (SELECT doc_id, t, regexp_matches(t, '\n## (?i:Further reading)[ \\t]*\n') AS has, regexp_extract(t, '(?s)\n## (?i:Further reading)[ \\t]*\n(.*)', 1) AS rest FROM d),
        b AS (SELECT *, CASE WHEN starts_with(rest, '## ') THEN '' ELSE split_part(rest, chr(10) || '## ', 1) END AS body FROM s)
        SELECT doc_id, CASE WHEN has THEN left(trim(regexp_replace(body, '[ \\t\\n\x0B\f\r]+', ' ', 'g')), 480) ELSE '' END AS summary,
        (length(t) - 1 - CASE WHEN has THEN length(regexp_extract(t, '\n(## (?i:Further reading)[ \\t]*\n)', 1)) + length(body) + CASE WHEN length(rest) > length(body) AND NOT starts_with(rest, '## ') THEN 1 ELSE 0 END ELSE 0 END)::INTEGER AS n_rest FROM b""",
    "link_validation": f"{_LINES} SELECT DISTINCT map_id, node_id, sl AS target FROM nl WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.map_id = nl.map_id AND pg.name = nl.sl)",
    "link_repair": f"""{_LINES}, al AS (SELECT DISTINCT w.map_id, {_CAMEL.format(c="coalesce(title, '')")} AS name FROM w WHERE EXISTS (SELECT 1 FROM rf WHERE rf.map_id = w.map_id AND rf.node_id = w.node_id)),
        ca AS (SELECT nl.map_id, nl.node_id, nl.ord, nl.sl, nl.ti, (SELECT min(nl.fo || '/' || al.name || '.md') FROM al WHERE al.map_id = nl.map_id AND lower(al.name) = lower(nl.sl)) AS c FROM nl)
        SELECT map_id, node_id, ord, CASE WHEN c IS NULL THEN '- ' || lower(sl) || '|' || lower(ti) ELSE '- [[' || c || '|' || lower(ti) || ']]' END AS fixed FROM ca""",
}
