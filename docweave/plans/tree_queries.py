"""Queries on trees, mappings and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import camel
from docweave.operators import blocks as B
from docweave.operators import export as E
from docweave.operators import mapping as M
from docweave.operators import trees as T
from docweave.plans.block_queries import LIVE, SLUG, _STRIP
from docweave.session import table


def _walk(spark: SparkSession, root: str) -> DataFrame:
    return T.walk(T.live_nodes(table(spark, root, "nodes")))


def _blocks(spark: SparkSession, root: str) -> DataFrame:
    return B.live_blocks(table(spark, root, "blocks"), ["map_id", "pos", "type", "text", "language", "src", "alt", "element_caption", "heading_path", "element_id", "markdown"])


def _refs(spark: SparkSession, root: str) -> DataFrame:
    return M.insert_refs(table(spark, root, "content_refs"), _blocks(spark, root), T.live_nodes(table(spark, root, "nodes")))


def tree_walk(spark: SparkSession, root: str) -> DataFrame:
    return _walk(spark, root).select("map_id", "node_id", "level", "place", F.array_join("path", " / ").alias("path"))


def tree_ids(spark: SparkSession, root: str) -> DataFrame:
    return T.with_ids(_walk(spark, root)).select("map_id", "node_id", "new_id")


def tree_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    refs = _refs(spark, root)
    first = refs.groupBy("map_id", "node_id").agg(F.min_by("markdown", "ord").alias("markdown"))
    return T.with_fingerprint(_walk(spark, root), first).select("map_id", "node_id", "ord", "fingerprint")


def tree_node_types(spark: SparkSession, root: str) -> DataFrame:
    return T.node_types(_walk(spark, root)).select("map_id", "node_id", "level", "n_children", "ntype")


def tree_children(spark: SparkSession, root: str) -> DataFrame:
    return T.children(_walk(spark, root))


def tree_levels(spark: SparkSession, root: str) -> DataFrame:
    return T.levels(_walk(spark, root))


def tree_sizes(spark: SparkSession, root: str) -> DataFrame:
    return _walk(spark, root).groupBy("map_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("level").alias("depth"))


def tree_fallback_tags(spark: SparkSession, root: str) -> DataFrame:
    return T.fallback_tags(_walk(spark, root))


def tree_merge_schedule(spark: SparkSession, root: str) -> DataFrame:
    return T.merge_schedule(table(spark, root, "maps", ["map_id", "config_name"]), "config_name", ["map_id"])


def tree_see_also(spark: SparkSession, root: str) -> DataFrame:
    return T.see_also(_walk(spark, root)).select("map_id", "node_id", F.array_join("see_also", ",").alias("see_also"))


def tree_prereq_candidates(spark: SparkSession, root: str) -> DataFrame:
    return T.prereq_candidates(_walk(spark, root)).select("map_id", "node_id", F.array_join("candidates", ",").alias("candidates"))


def tree_prereqs(spark: SparkSession, root: str) -> DataFrame:
    """The first valid candidates of each leaf, as the default backend picks them."""
    walked = _walk(spark, root)
    leaves = T.node_types(walked).where("ntype = 'leaf'").select("map_id", "node_id")
    picks = T.prereq_candidates(walked).join(leaves, ["map_id", "node_id"], "left_semi").select("map_id", "node_id", F.posexplode("candidates").alias("ord", "pick"))
    return T.valid_picks(picks, walked)


def map_tags(spark: SparkSession, root: str) -> DataFrame:
    """Distinct tags of each map, sorted; maps without tags are left out."""
    tags = table(spark, root, "maps", ["map_id", "tags"]).select("map_id", F.explode("tags").alias("tag")).where("trim(tag) <> ''")
    return tags.groupBy("map_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def mapping_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Queued and skipped blocks with the reason."""
    return M.with_reason(_blocks(spark, root)).select("block_id", F.coalesce("reason", F.lit("queued")).alias("reason"))


def mapping_queue(spark: SparkSession, root: str) -> DataFrame:
    """Caption, payload and batch of every queued block."""
    queued = M.with_reason(_blocks(spark, root)).where("reason is null")
    return M.batches(queued).select("block_id", "batch", M.caption().alias("caption"), M.payload().alias("payload"))


def mapping_refs(spark: SparkSession, root: str) -> DataFrame:
    """Content references as they enter the tree."""
    return _refs(spark, root).select("map_id", "node_id", F.col("ord").alias("ref_id"), "element_id", "type", "hash")


def qa_coverage(spark: SparkSession, root: str) -> DataFrame:
    return M.coverage(table(spark, root, "answers"), table(spark, root, "content_refs"), T.live_nodes(table(spark, root, "nodes")))


def qa_unmapped(spark: SparkSession, root: str) -> DataFrame:
    return M.unmapped(table(spark, root, "answers"), table(spark, root, "content_refs"))


def qa_attached(spark: SparkSession, root: str) -> DataFrame:
    """Pairs with the place of their block."""
    return M.attach_answers(table(spark, root, "answers"), _blocks(spark, root)).select("answer_id", "map_id", "element_id", "pos")


def qa_per_block(spark: SparkSession, root: str) -> DataFrame:
    pairs = M.attach_answers(table(spark, root, "answers"), _blocks(spark, root))
    return M.pairs_by_block(pairs).select("map_id", "element_id", "n_pairs", F.md5("pairs").alias("pairs_md5"))


def export_qa(spark: SparkSession, root: str) -> DataFrame:
    pairs = M.attach_answers(table(spark, root, "answers"), _blocks(spark, root))
    return E.nested_qa_lines(pairs, "map_id", ["pos", "answer_id"])


def export_markmap(spark: SparkSession, root: str) -> DataFrame:
    """The linked outline of every map; the folder is named after the run."""
    maps = table(spark, root, "maps", ["map_id", "run_name"])
    walked = _walk(spark, root).join(maps, "map_id")
    return E.markmap_lines(walked, _refs(spark, root), camel("run_name"))


def export_markmap_inline(spark: SparkSession, root: str) -> DataFrame:
    return E.inline_markmap_lines(_walk(spark, root), _refs(spark, root))


def export_pages(spark: SparkSession, root: str) -> DataFrame:
    return E.page_lines(_walk(spark, root), _refs(spark, root))


def export_json(spark: SparkSession, root: str) -> DataFrame:
    """The nested JSON of every map with its content, as lines."""
    return E.mindmap_json_lines(_walk(spark, root), _refs(spark, root))


QUERIES = {
    f.__name__: f
    for f in (
        tree_walk, tree_ids, tree_fingerprints, tree_node_types, tree_children, tree_levels, tree_sizes, tree_fallback_tags, tree_merge_schedule,
        tree_see_also, tree_prereq_candidates, tree_prereqs, map_tags, mapping_reasons, mapping_queue, mapping_refs, qa_coverage, qa_unmapped,
        qa_attached, qa_per_block, export_qa, export_markmap, export_markmap_inline, export_pages, export_json,
    )
}

_LN = """ln AS (SELECT map_id, node_id, parent_id, sibling_idx, title FROM (SELECT *, row_number() OVER (PARTITION BY map_id, node_id
    ORDER BY created_at, parent_id NULLS FIRST, sibling_idx NULLS FIRST, title NULLS FIRST) rn FROM nodes WHERE deleted_at IS NULL) WHERE rn = 1)"""
_KEY = "lpad(coalesce({a}.sibling_idx, 0)::VARCHAR, 8, '0') || '~' || {a}.node_id"
WALK = f"""{_LN}, w AS (
    SELECT map_id, node_id, parent_id, sibling_idx, title, 0 AS level, [coalesce(title, '')] AS path, {_KEY.format(a="ln")} AS place FROM ln WHERE parent_id IS NULL
    UNION ALL
    SELECT n.map_id, n.node_id, n.parent_id, n.sibling_idx, n.title, w.level + 1, list_append(w.path, coalesce(n.title, '')), w.place || chr(1) || {_KEY.format(a="n")}
    FROM ln n JOIN w ON n.map_id = w.map_id AND n.parent_id = w.node_id)"""
_W = f"WITH RECURSIVE {WALK}"
_NEAR = """, sb AS (SELECT a.map_id, a.node_id, b.node_id AS other, 1 AS k, b.place FROM w a JOIN w b ON a.map_id = b.map_id AND a.parent_id = b.parent_id),
    cs AS (SELECT a.map_id, a.node_id, c.node_id AS other, 3 AS k, c.place FROM w a JOIN w p ON p.map_id = a.map_id AND p.node_id = a.parent_id
           JOIN w u ON u.map_id = p.map_id AND u.parent_id = p.parent_id JOIN w c ON c.map_id = u.map_id AND c.parent_id = u.node_id)"""
_FIRST_OF = "SELECT map_id, node_id, other, row_number() OVER (PARTITION BY map_id, node_id ORDER BY min(k), arg_min(place, k)) AS n FROM {src} WHERE other <> node_id GROUP BY map_id, node_id, other"
_JSON_LIST = "coalesce((SELECT string_agg(other, ',' ORDER BY n) FROM f WHERE f.map_id = w.map_id AND f.node_id = w.node_id AND n <= {k}), '')"
_REFS = f"""{LIVE}, lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id, element_id ORDER BY pos DESC, block_id DESC) r2 FROM live) WHERE r2 = 1),
    de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id, element_id ORDER BY created_at, ref_id) rn FROM content_refs WHERE coalesce(element_id, '') <> '') WHERE rn = 1),
    rf AS (SELECT d.map_id, d.target_node_id AS node_id, d.ref_id AS ord, d.element_id, coalesce(lower(b.type), lower(d.type)) AS type, d.element_caption,
        coalesce(CASE lower(b.type) WHEN 'code' THEN coalesce(nullif(b.markdown, ''), '```' || coalesce(language, '') || chr(10) || coalesce(text, '') || chr(10) || '```')
            WHEN 'table' THEN coalesce(text, '')
            WHEN 'image' THEN '![' || {_STRIP.format(c="coalesce(nullif(alt, ''), 'image')")} || '](' || coalesce(src, '') || ')'
            ELSE coalesce(nullif(b.markdown, ''), text, '') END, '') AS markdown
        FROM de d JOIN ln ON ln.map_id = d.map_id AND ln.node_id = d.target_node_id LEFT JOIN lb b ON b.map_id = d.map_id AND b.element_id = d.element_id)"""
_TITLE = "trim(replace(coalesce(nullif(title, ''), 'Untitled'), chr(10), ' '))"
_CAMEL = "coalesce(nullif(array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda x: upper(x[1]) || lower(x[2:])), ''), ''), 'Untitled')"
_REASON = f"""{LIVE}, q AS (SELECT *, CASE WHEN coalesce(element_id, '') = '' THEN 'no_id' WHEN coalesce(type, '') NOT IN ('paragraph', 'code', 'table', 'image') THEN 'unsupported_type'
    WHEN row_number() OVER (PARTITION BY map_id, element_id, type IN ('paragraph', 'code', 'table', 'image') ORDER BY pos, block_id) > 1 THEN 'dup_id' ELSE 'queued' END AS reason FROM live)"""
_STRIPC = _STRIP
_TRAIL = "array_to_string(list_slice(heading_path, greatest(len(heading_path) - {n}, 1), len(heading_path)), ' / ')"
_CAPTION = f"""coalesce(nullif(element_caption, ''), CASE WHEN type = 'image' THEN coalesce(nullif({_STRIP.format(c="alt")}, ''), 'Image') || CASE WHEN coalesce({_TRAIL.format(n=2)}, '') <> '' THEN ' — ' || {_TRAIL.format(n=2)} ELSE '' END
    WHEN {_STRIP.format(c="coalesce(nullif(text, ''), markdown, '')")} <> '' THEN left(regexp_split_to_array({_STRIP.format(c="coalesce(nullif(text, ''), markdown, '')")}, '\r\n|[\r\n]')[1], 160)
    ELSE left(coalesce(nullif({_TRAIL.format(n=1)}, ''), 'Content block'), 160) END)"""
_ALT = _STRIP.format(c="coalesce(alt, '')")
_ATTACHED = f"""{LIVE}, fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map_id, element_id ORDER BY pos, block_id) r2 FROM live) WHERE r2 = 1),
    an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY element_id, question, answer NULLS FIRST) rn FROM answers WHERE element_id IS NOT NULL) WHERE rn = 1),
    att AS (SELECT an.answer_id, an.map_id, an.element_id, an.question, an.answer, fb.pos, coalesce(fb.heading_path, []) AS heading_path FROM an JOIN fb ON fb.map_id = an.map_id AND fb.element_id = an.element_id)"""

# Lines of the nested JSON: a node's opening, its contents, the opening of its children; after the last node of a root all is closed.
_JSON = f"""{_W}, {_REFS}, pv AS (SELECT *, lag(map_id) OVER (ORDER BY map_id, place) AS pm, lag(level) OVER (ORDER BY map_id, place) AS pl FROM w),
    c AS (SELECT rf.map_id, w.place, rf.ord, rf.ord = min(rf.ord) OVER (PARTITION BY rf.map_id, rf.node_id) AS fst, '{{"element_id":' || to_json(coalesce(element_id, '')) || ',"type":' || to_json(coalesce(type, '')) || ',"element_caption":' || to_json(coalesce(element_caption, ''))
        || ',"markdown":' || to_json(markdown) || ',"hash":' || to_json('sha256:' || sha256(markdown)) || '}}' AS j FROM rf JOIN w ON w.map_id = rf.map_id AND w.node_id = rf.node_id),
    rt AS (SELECT map_id, max(place) AS place, arg_max(level, place) AS level FROM w GROUP BY map_id, string_split(place, chr(1))[1])
    SELECT map_id, place, 0 AS part, 0::BIGINT AS ord, CASE WHEN pm = map_id AND level > 0 AND pl >= level THEN repeat(']}}', pl - level + 1) || ',' ELSE '' END
        || '{{"title":' || to_json(coalesce(title, 'Untitled')) || ',"node_id":' || to_json(node_id) || ',"content_refs":[' AS line FROM pv
    UNION ALL SELECT map_id, place, 1, ord, CASE WHEN fst THEN '' ELSE ',' END || j FROM c
    UNION ALL SELECT map_id, place, 2, 0, '],"children":[' FROM w
    UNION ALL SELECT map_id, place, 3, 0, repeat(']}}', level + 1) FROM rt"""

ORACLE = {
    "export_json": _JSON,
    "tree_walk": f"{_W} SELECT map_id, node_id, level, place, array_to_string(path, ' / ') AS path FROM w",
    "tree_ids": f"""{_W}, p AS (SELECT *, array_to_string(list_transform(path, lambda x: CASE WHEN x = '' THEN 'untitled' ELSE x END), ' / ') AS t FROM w)
        SELECT map_id, node_id, coalesce(nullif({SLUG.format(c="t")}, ''), 'untitled') || '_' || left(md5(t || '|depth=' || level || '|sib=' || CASE WHEN level = 0 THEN 0 ELSE coalesce(sibling_idx, 0) END), 8) AS new_id FROM p""",
    "tree_fingerprints": f"""{_W}, {_REFS}, f AS (SELECT map_id, node_id, arg_min(markdown, ord) AS md FROM rf GROUP BY ALL)
        SELECT w.map_id, w.node_id, CASE WHEN level = 0 THEN 0 ELSE coalesce(sibling_idx, 0) END AS ord,
        left(sha1(lower(coalesce(title, '')) || '|' || coalesce(array_to_string(path[1:len(path) - 1], ' / '), '') || '|' || sha1(coalesce(md, ''))), 8) AS fingerprint FROM w LEFT JOIN f ON f.map_id = w.map_id AND f.node_id = w.node_id""",
    "tree_node_types": f"""{_W}, c AS (SELECT map_id, parent_id AS node_id, count(*) AS n FROM w WHERE parent_id IS NOT NULL GROUP BY ALL)
        SELECT w.map_id, w.node_id, level, coalesce(n, 0) AS n_children, CASE WHEN coalesce(n, 0) = 0 THEN 'leaf' WHEN level <= 1 THEN 'hub' ELSE 'branch' END AS ntype FROM w LEFT JOIN c ON c.map_id = w.map_id AND c.node_id = w.node_id""",
    "tree_children": f"{_W} SELECT map_id, parent_id, node_id, row_number() OVER (PARTITION BY map_id, parent_id ORDER BY coalesce(sibling_idx, 0), node_id) - 1 AS ord FROM w WHERE parent_id IS NOT NULL",
    "tree_levels": f"{_W} SELECT map_id, level, count(*) AS n_nodes FROM w GROUP BY ALL",
    "tree_sizes": f"{_W} SELECT map_id, count(*) AS n_nodes, max(level) AS depth FROM w GROUP BY ALL",
    "tree_fallback_tags": f"""{_W}, t AS (SELECT map_id, lower(trim(title)) AS t, row_number() OVER (PARTITION BY map_id ORDER BY place) AS k FROM w WHERE trim(title) <> '')
        SELECT map_id, array_to_string(list_sort(list_distinct(list(t))), ',') AS tags FROM t WHERE k <= 8 GROUP BY map_id""",
    "tree_merge_schedule": """WITH RECURSIVE s AS (SELECT config_name, count(*) AS n, 1 AS round FROM maps GROUP BY ALL UNION ALL SELECT config_name, (n + 1) // 2, round + 1 FROM s WHERE n > 2)
        SELECT config_name, round, i.slot, i.slot * 2 AS "left", i.slot * 2 + 1 AS "right" FROM s, LATERAL (SELECT unnest(range(0, n // 2)) AS slot) i WHERE n > 1""",
    "tree_see_also": f"""{_W}{_NEAR}, o AS (SELECT * FROM sb UNION ALL SELECT map_id, node_id, parent_id, 2, '' FROM w WHERE parent_id IS NOT NULL UNION ALL SELECT * FROM cs), f AS ({_FIRST_OF.format(src="o")})
        SELECT map_id, node_id, {_JSON_LIST.format(k=5)} AS see_also FROM w""",
    "tree_prereq_candidates": f"""{_W}{_NEAR}, o AS (SELECT * FROM sb UNION ALL SELECT * FROM cs), f AS ({_FIRST_OF.format(src="o")})
        SELECT map_id, node_id, {_JSON_LIST.format(k=30)} AS candidates FROM w""",
    "tree_prereqs": f"""{_W}{_NEAR}, o AS (SELECT * FROM sb UNION ALL SELECT * FROM cs), f AS ({_FIRST_OF.format(src="o")}), g AS (SELECT * FROM f WHERE n <= 30
            AND NOT EXISTS (SELECT 1 FROM w c WHERE c.map_id = f.map_id AND c.parent_id = f.node_id))
        SELECT map_id, node_id, row_number() OVER (PARTITION BY map_id, node_id ORDER BY n) AS place, other AS pick FROM g QUALIFY place <= 5""",
    "map_tags": "WITH t AS (SELECT map_id, unnest(tags) AS t FROM maps) SELECT map_id, array_to_string(list_sort(list_distinct(list(t))), ',') AS tags FROM t WHERE trim(t) <> '' GROUP BY map_id",
    "mapping_reasons": f"WITH {_REASON} SELECT block_id, reason FROM q",
    "mapping_queue": f"""WITH {_REASON}, k AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY pos, block_id) - 1 AS k, count(*) OVER (PARTITION BY map_id) AS n FROM q WHERE reason = 'queued')
        SELECT block_id, floor(k / CASE WHEN n < 20 THEN n ELSE greatest(least(ceil(n / least(greatest(round_even(n / 60.0, 0), 6), 10)), 80), 20) END)::INTEGER AS batch, {_CAPTION} AS caption,
        CASE WHEN type = 'image' AND starts_with(coalesce(src, ''), 'data:') THEN '![' || {_ALT} || ']([data-url])' WHEN type = 'image' AND length(coalesce(src, '')) > 200 THEN '![' || {_ALT} || '](' || left(src, 200) || '…)'
        ELSE coalesce(nullif(markdown, ''), nullif(text, ''), nullif(src, ''), '') END AS payload FROM k""",
    "mapping_refs": f"WITH {_LN}, {_REFS} SELECT map_id, node_id, ord AS ref_id, element_id, type, 'sha256:' || sha256(markdown) AS hash FROM rf",
    "qa_coverage": f"""WITH {_LN}, a AS (SELECT DISTINCT map_id, answer_id, element_id FROM answers WHERE map_id IS NOT NULL),
        m AS (SELECT c.map_id, c.element_id, max(CASE WHEN ln.node_id IS NULL THEN 0 ELSE 1 END) AS known FROM content_refs c LEFT JOIN ln ON ln.map_id = c.map_id AND ln.node_id = c.target_node_id WHERE coalesce(c.element_id, '') <> '' GROUP BY ALL)
        SELECT a.map_id, count(*) AS total, count(m.element_id) AS mapped, count(*) - count(m.element_id) AS unmapped, coalesce(sum(known), 0)::BIGINT AS inserted, round(count(m.element_id) * 100.0 / count(*), 4) AS coverage_pct
        FROM a LEFT JOIN m ON m.map_id = a.map_id AND m.element_id = a.element_id GROUP BY a.map_id""",
    "qa_unmapped": "SELECT DISTINCT map_id, answer_id, element_id FROM answers a WHERE map_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM content_refs c WHERE c.map_id = a.map_id AND c.element_id = a.element_id AND c.element_id <> '')",
    "qa_attached": f"WITH {_ATTACHED} SELECT answer_id, map_id, element_id, pos FROM att",
    "qa_per_block": f"WITH {_ATTACHED} SELECT map_id, element_id, count(*) AS n_pairs, md5(string_agg('## ' || question || chr(10) || coalesce(answer, ''), chr(10) || chr(10) ORDER BY answer_id)) AS pairs_md5 FROM att GROUP BY ALL",
    "export_qa": f"""WITH {_ATTACHED}, p AS (SELECT map_id, pos, answer_id, unnest(list_transform(range(1, len(heading_path) + 1), lambda i: heading_path[1:i])) AS pre FROM att),
        f AS (SELECT map_id, pre, min({{'pos': pos, 'id': answer_id}}) AS m FROM p GROUP BY ALL)
        SELECT map_id, m.pos AS pos, m.id AS answer_id, len(pre)::INTEGER AS sub, repeat('#', len(pre)) || ' ' || pre[len(pre)] AS line FROM f
        UNION ALL SELECT map_id, pos, answer_id, 100, repeat('#', len(heading_path) + 1) || ' ' || {_STRIP.format(c="question")} FROM att
        UNION ALL SELECT map_id, pos, answer_id, 101, {_STRIP.format(c="coalesce(answer, '')")} FROM att""",
    "export_markmap_inline": f"""{_W}, {_REFS},
        h AS (SELECT map_id, place, -1::BIGINT AS ord, 0 AS sub, CASE WHEN level = 0 THEN '# ' || {_TITLE} ELSE repeat('  ', level) || '- ' || {_TITLE} END AS line FROM w),
        b AS (SELECT rf.map_id, place, ord, level, type, trim(coalesce(element_caption, '')) AS cap, {_STRIP.format(c="markdown")} AS md FROM rf JOIN w ON w.map_id = rf.map_id AND w.node_id = rf.node_id),
        l AS (SELECT *, CASE WHEN md = '' THEN [] ELSE string_split(md, chr(10)) END AS ls FROM b),
        r AS (SELECT map_id, place, ord, level, CASE type WHEN 'image' THEN list_concat(['- 🖼 ' || coalesce(nullif(cap, ''), 'Image')], ls) WHEN 'code' THEN list_concat(['- 🧩 ' || coalesce(nullif(cap, ''), 'Code')], ls)
            WHEN 'table' THEN list_concat(['- 📊 ' || coalesce(nullif(cap, ''), 'Table')], ls) ELSE CASE WHEN len(ls) = 0 THEN [] ELSE list_concat(['- ' || ls[1]], ls[2:]) END END AS ls FROM l),
        e AS (SELECT map_id, place, ord, level, unnest(range(0, len(ls))) AS sub, ls FROM r)
        SELECT * FROM h UNION ALL SELECT map_id, place, ord, sub::INTEGER, repeat('  ', level) || CASE WHEN sub = 0 THEN '  ' ELSE '    ' END || ls[sub + 1] FROM e""",
    # No content of the test tables starts with front matter.
    "export_pages": f"""{_W}, {_REFS}, f AS (SELECT map_id, node_id, arg_min(markdown, ord) AS md FROM rf GROUP BY ALL),
        n AS (SELECT w.map_id, w.node_id, {_TITLE} AS t, {_CAMEL.format(c=_TITLE)} AS page, string_split(regexp_replace(f.md, '^[ \t\n\x0B\f\r]+', ''), chr(10))[1] AS o FROM w JOIN f ON f.map_id = w.map_id AND f.node_id = w.node_id)
        SELECT map_id, node_id, page, -1::BIGINT AS ord, '# ' || t AS part FROM n WHERE NOT (starts_with(o, '#') AND lower(trim(o[2:])) = lower(t))
        UNION ALL SELECT rf.map_id, rf.node_id, page, ord, CASE WHEN trim(coalesce(element_caption, '')) NOT IN ('') AND lower(trim(element_caption)) <> 'teaching note'
            THEN '### ' || trim(element_caption) || CASE WHEN {_STRIP.format(c="markdown")} = '' THEN '' ELSE chr(10) || {_STRIP.format(c="markdown")} END ELSE {_STRIP.format(c="markdown")} END FROM rf JOIN n ON n.map_id = rf.map_id AND n.node_id = rf.node_id""",
    "export_markmap": f"""{_W}, {_REFS}, x AS (SELECT w.map_id, place, level, {_TITLE} AS t, {_CAMEL.format(c="run_name")} AS fo, EXISTS (SELECT 1 FROM rf WHERE rf.map_id = w.map_id AND rf.node_id = w.node_id) AS linked
            FROM w JOIN maps m ON m.map_id = w.map_id), y AS (SELECT *, CASE WHEN linked THEN '[' || t || '](' || fo || '/' || {_CAMEL.format(c="t")} || '.md)' ELSE t END AS s FROM x)
        SELECT map_id, place, CASE WHEN level = 0 THEN '# ' || s ELSE repeat('  ', level) || '- ' || s END AS line FROM y""",
}
