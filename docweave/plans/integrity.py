"""Queries on references between the tables of a mind-map store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.orphans import Reference, orphan_graph, orphan_references, orphan_report
from docweave.session import table

REF_TO_BLOCK = Reference("content_refs", "element_id", "blocks", "element_id", "map_id", ("ref_id",), "created_at", "ingested_at")
REF_TO_NODE = Reference("content_refs", "target_node_id", "nodes", "node_id", "map_id", ("ref_id",), "created_at", "created_at")
ANSWER_TO_BLOCK = Reference("answers", "element_id", "blocks", "element_id", "map_id", ("answer_id",), "created_at", "ingested_at")
NODE_TO_NODE = Reference("nodes", "parent_id", "nodes", "node_id", "map_id", ("map_id", "node_id"), "created_at", "created_at")
BLOCK_TO_MAP = Reference("blocks", "map_id", "maps", "map_id", None, ("block_id",), "ingested_at", "created_at", None)
MAP_TO_CONFIG = Reference("maps", "config_name", "chunk_configs", "config_name", None, ("map_id",), "created_at", None, None)
GRAPH = [MAP_TO_CONFIG, BLOCK_TO_MAP, NODE_TO_NODE, REF_TO_BLOCK, REF_TO_NODE, ANSWER_TO_BLOCK]


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return orphan_references({t: table(spark, root, t) for t in ("content_refs", "blocks", "nodes")}, [REF_TO_BLOCK, REF_TO_NODE])


def p3_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Direct and inherited orphans among settings, maps, blocks, nodes, content references and answers."""
    return _cascade(spark, root).drop("made_at")


def _cascade(spark: SparkSession, root: str) -> DataFrame:
    return orphan_graph({t: table(spark, root, t) for t in ("chunk_configs", "maps", "blocks", "nodes", "content_refs", "answers")}, GRAPH)


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per table, field, kind, reason and month."""
    return orphan_report(_cascade(spark, root)).withColumn("period", F.date_format("period", "yyyy-MM"))


QUERIES = {"p3_found": p3_found, "p3_cascade": p3_cascade, "p3_report": p3_report}

_STATES = """
    WITH bk AS (SELECT map_id, element_id k, min(CASE WHEN deleted_at IS NULL THEN ingested_at END) f FROM blocks GROUP BY ALL),
    nk AS (SELECT map_id, node_id k, min(CASE WHEN deleted_at IS NULL THEN created_at END) f FROM nodes GROUP BY ALL),
    r AS (
        SELECT ref_id, c.map_id, 'element_id' AS field, element_id k, created_at, bk.f, bk.k IS NOT NULL AS there
        FROM content_refs c LEFT JOIN bk ON bk.map_id = c.map_id AND bk.k = c.element_id
        UNION ALL
        SELECT ref_id, c.map_id, 'target_node_id', target_node_id, created_at, nk.f, nk.k IS NOT NULL
        FROM content_refs c LEFT JOIN nk ON nk.map_id = c.map_id AND nk.k = c.target_node_id),
    d AS (
        SELECT DISTINCT ref_id, map_id, field, k, created_at,
               CASE WHEN NOT there THEN 'missing' WHEN f IS NULL THEN 'deleted' WHEN f > created_at THEN 'late' END AS reason
        FROM r WHERE k IS NOT NULL AND k <> '' AND (NOT there OR f IS NULL OR f > created_at))"""

# The whole graph: every reference as an edge, the state of every key, and the walk down from the direct orphans.
_CASCADE = """
    WITH RECURSIVE s AS (
        SELECT 'chunk_configs' AS parent, '' AS scope, config_name AS key, true AS live, NULL::TIMESTAMP AS since FROM chunk_configs GROUP BY ALL
        UNION ALL SELECT 'maps', '', map_id::VARCHAR, true, min(created_at) FROM maps GROUP BY ALL
        UNION ALL SELECT 'blocks', map_id::VARCHAR, element_id, bool_or(deleted_at IS NULL), min(CASE WHEN deleted_at IS NULL THEN ingested_at END) FROM blocks GROUP BY ALL
        UNION ALL SELECT 'nodes', map_id::VARCHAR, node_id, bool_or(deleted_at IS NULL), min(CASE WHEN deleted_at IS NULL THEN created_at END) FROM nodes GROUP BY ALL),
    e AS (
        SELECT 'maps' AS "table", '' AS own_scope, map_id::VARCHAR AS id, 'config_name' AS field, 'chunk_configs' AS parent, '' AS scope, config_name AS key, created_at AS made_at FROM maps
        UNION ALL SELECT 'blocks', map_id::VARCHAR, element_id, 'map_id', 'maps', '', map_id::VARCHAR, ingested_at FROM blocks
        UNION ALL SELECT 'nodes', map_id::VARCHAR, node_id, 'parent_id', 'nodes', map_id::VARCHAR, parent_id, created_at FROM nodes
        UNION ALL SELECT 'content_refs', map_id::VARCHAR, ref_id::VARCHAR, 'element_id', 'blocks', map_id::VARCHAR, element_id, created_at FROM content_refs
        UNION ALL SELECT 'content_refs', map_id::VARCHAR, ref_id::VARCHAR, 'target_node_id', 'nodes', map_id::VARCHAR, target_node_id, created_at FROM content_refs
        UNION ALL SELECT 'answers', map_id::VARCHAR, answer_id::VARCHAR, 'element_id', 'blocks', map_id::VARCHAR, element_id, created_at FROM answers),
    r AS (
        SELECT e.*, "table" IN ('maps', 'blocks', 'nodes') AS is_parent, CASE WHEN s.key IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN since > made_at THEN 'late' END AS reason
        FROM e LEFT JOIN s ON s.parent = e.parent AND s.scope = e.scope AND s.key = e.key WHERE e.key <> '' AND e.scope IS NOT NULL AND own_scope IS NOT NULL AND id IS NOT NULL),
    walk AS (
        SELECT DISTINCT "table", own_scope, id, 0 AS level FROM r WHERE is_parent AND reason IS NOT NULL
        UNION
        SELECT r."table", r.own_scope, r.id, walk.level + 1 FROM walk JOIN r ON is_parent AND r.parent = walk."table" AND r.scope = walk.own_scope AND r.key = walk.id),
    lv AS (SELECT "table", own_scope, id, min(level) AS level FROM walk GROUP BY ALL),
    o AS (
        SELECT "table", own_scope AS scope, id, field, 'direct' AS kind, min(reason) AS reason, 0 AS level, min(made_at) AS made_at FROM r WHERE is_parent AND reason IS NOT NULL GROUP BY ALL
        UNION ALL
        SELECT lv."table", lv.own_scope, lv.id, min(r.field), 'inherited', 'parent', lv.level, min(r.made_at) FROM lv JOIN r USING ("table", own_scope, id)
        JOIN lv p ON p."table" = r.parent AND p.own_scope = r.scope AND p.id = r.key AND p.level = lv.level - 1 WHERE lv.level > 0 GROUP BY ALL
        UNION ALL
        SELECT DISTINCT "table", own_scope, id, field, 'direct', reason, 0, made_at FROM r WHERE NOT is_parent AND reason IS NOT NULL
        UNION ALL
        SELECT DISTINCT r."table", r.own_scope, r.id, r.field, 'inherited', 'parent', p.level + 1, r.made_at FROM r
        JOIN lv p ON p."table" = r.parent AND p.own_scope = r.scope AND p.id = r.key WHERE NOT is_parent AND reason IS NULL)"""

ORACLE = {
    "p3_found": _STATES + " SELECT DISTINCT ref_id, field, reason FROM d",
    "p3_cascade": _CASCADE + " SELECT \"table\", scope, id, field, kind, reason, level FROM o",
    "p3_report": _CASCADE + """ SELECT "table", field, kind, reason, strftime(made_at, '%Y-%m') AS period, count(*) AS n FROM o GROUP BY ALL""",
}
