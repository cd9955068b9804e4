"""Queries on clustering, model steps, notes and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import camel
from docweave.models.backend import ask
from docweave.operators import blocks as B
from docweave.operators.chunks import chunk_texts, chunk_top_paths
from docweave.operators import clusters as K
from docweave.operators import concepts as P
from docweave.operators import notes as N
from docweave.plans.block_queries import LIVE
from docweave.plans.text_queries import _PACK, _packed
from docweave.plans.tree_queries import WALK, _walk
from docweave.session import table

#: Dimensions of the test vectors.
DIMENSIONS = 64


def cluster_texts(spark: SparkSession, root: str) -> DataFrame:
    """What represents each chunk: its heaviest paths and the tags of its map."""
    live = B.live_blocks(table(spark, root, "blocks"), ["heading_path"])
    paths = chunk_top_paths(_packed(spark, root), live)
    return paths.join(table(spark, root, "maps", ["map_id", "tags"]), "map_id").select("map_id", "chunk_index", K.cluster_text(F.array("paths"), F.col("tags")).alias("text"))


def cluster_tfidf(spark: SparkSession, root: str) -> DataFrame:
    """The three heaviest terms of every block with a text, over all blocks."""
    texts = B.live_blocks(table(spark, root, "blocks"), ["text"]).where("text is not null")
    weights = K.tfidf(texts, ["block_id"], "text").withColumn("weight", F.round("weight", 5))
    place = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("weight"), "term"))
    return weights.withColumn("place", place).where("place <= 3")


def cluster_centroids(spark: SparkSession, root: str) -> DataFrame:
    """Mean vector of each label, one row per dimension."""
    points = table(spark, root, "embeddings", ["label", "embedding"]).where("label is not null")
    means = K.centroids_of(points, "label", "embedding", DIMENSIONS)
    return means.select("label", F.posexplode(F.array(*[F.col(f"c{i}") for i in range(DIMENSIONS)])).alias("dim", "mean")).withColumn("mean", F.round("mean", 5))


def cluster_assignment(spark: SparkSession, root: str) -> DataFrame:
    """Nearest label centroid of every vector."""
    points = table(spark, root, "embeddings", ["vec_id", "label", "embedding"])
    means = K.centroids_of(points.where("label is not null"), "label", "embedding", DIMENSIONS).orderBy("label").collect()
    centroids = [(r["label"], [r[f"c{i}"] for i in range(DIMENSIONS)]) for r in means]  # one row per label
    return K.nearest(points, centroids, "embedding").select("vec_id", "cluster")


def cluster_groups(spark: SparkSession, root: str) -> DataFrame:
    """Clusters of the chunks of every map by their texts."""
    texts = cluster_texts(spark, root)
    points = K.hashed_vectors(K.tfidf(texts, ["map_id", "chunk_index"], "text", ["map_id"]), ["map_id", "chunk_index"])
    return K.grouped_kmeans(points, "map_id", "chunk_index")


def cluster_svd(spark: SparkSession, root: str) -> DataFrame:
    """Coordinates of the vectors along the four largest singular directions."""
    points = table(spark, root, "embeddings", ["vec_id", "embedding"]).where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    basis = K.truncated_svd(points, "v", DIMENSIONS, 4)
    return K.project(points, basis).select("vec_id", *[F.round(F.col("p")[i], 4).alias(f"p{i}") for i in range(len(basis))])


def concept_tree(spark: SparkSession, root: str) -> DataFrame:
    """Trees of headings, merged over the chunks of a map."""
    tree = P.refine(P.heading_tree(B.live_blocks(table(spark, root, "blocks"), ["map_id", "pos", "heading_path"])))
    return tree.select("map_id", F.array_join("path", "/").alias("path"), "title", "first_pos", "n_blocks", "depth", "sibling_idx", "more")


def concept_mapping(spark: SparkSession, root: str) -> DataFrame:
    """One node per block by the heaviest term that a title holds."""
    live = B.live_blocks(table(spark, root, "blocks"), ["map_id", "type", "text"]).where("type <> 'heading' and text is not null")
    weights = K.tfidf(live.select("map_id", "block_id", "text"), ["map_id", "block_id"], "text", ["map_id"])
    return P.place_blocks(weights, _walk(spark, root))


def model_tags(spark: SparkSession, root: str) -> DataFrame:
    texts = chunk_texts(_packed(spark, root), B.live_blocks(table(spark, root, "blocks"), ["markdown"]))
    return ask(texts, ["map_id", "chunk_index"], ["md_text"], "tags", "tags", "array<string>")


def model_questions(spark: SparkSession, root: str) -> DataFrame:
    live = B.live_blocks(table(spark, root, "blocks"), ["type", "markdown", "element_caption"]).where("type <> 'heading'")
    return ask(live, ["block_id"], ["markdown", "element_caption", "type"], "questions", "questions", "array<string>")


def model_bullets(spark: SparkSession, root: str) -> DataFrame:
    return ask(B.live_blocks(table(spark, root, "blocks"), ["markdown"]), ["block_id"], ["markdown"], "bullets", "bullets")


def notes_front_matter(spark: SparkSession, root: str) -> DataFrame:
    """A note for every node, as the plans write them: leaves, digests of children, branches, picked prerequisites of leaves."""
    maps = table(spark, root, "maps", ["map_id", "run_name"])
    notes = N.write_notes(_walk(spark, root), maps, camel("run_name"), ask, "extractive", F.lit("run"))
    return notes.select("map_id", "node_id", "ntype", F.md5("markdown").alias("md5"))


def trace_events(spark: SparkSession, root: str) -> DataFrame:
    """Calls per event type and day from an event table."""
    events = table(spark, root, "events", ["event_type", "ts", "value"])
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        cluster_texts, cluster_tfidf, cluster_centroids, cluster_assignment, cluster_groups, cluster_svd, concept_tree, concept_mapping,
        model_tags, model_questions, model_bullets, notes_front_matter, trace_events,
    )
}

# The sentences of the text ``t``: it is cut after full stops and at line ends; headings, rows and images are left out.
_SAID = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(array_to_string(list_filter(string_split({t}, chr(10)), lambda x: NOT regexp_matches(x, '^[\s\p{{Z}}\x1C-\x1F\x{{85}}]*(#|\||!\[)')), chr(10)),
    '([.!?。])[\s\p{{Z}}\x1C-\x1F\x{{85}}]+', '\1' || chr(1), 'g'), '[\n\x01]+'), lambda x: regexp_replace(x, '^[\s\p{{Z}}\x1C-\x1F\x{{85}}]+|[\s\p{{Z}}\x1C-\x1F\x{{85}}]+$', '', 'g')), lambda x: x <> '')"""
_BARE = r"regexp_replace(coalesce(markdown, ''), '(?ms)^```.*?^```[ \t]*$', '', 'g')"

ORACLE = {
    "model_tags": f"""{_PACK}, tx AS (SELECT pk.map_id, chunk_index, string_agg(markdown, chr(10) || chr(10) ORDER BY ord) AS md FROM pk JOIN live USING (block_id) WHERE coalesce(markdown, '') <> '' GROUP BY ALL),
        wd AS (SELECT map_id, chunk_index, unnest(regexp_extract_all(lower(md), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{4,}}')) AS w FROM tx), ct AS (SELECT map_id, chunk_index, w, count(*) AS n FROM wd GROUP BY ALL),
        rk AS (SELECT *, row_number() OVER (PARTITION BY map_id, chunk_index ORDER BY n DESC, w) AS r FROM ct),
        tg AS (SELECT map_id, chunk_index, list(w ORDER BY w) AS tags FROM rk WHERE r <= 5 GROUP BY ALL) SELECT tx.map_id, tx.chunk_index, coalesce(tags, []) AS tags FROM tx LEFT JOIN tg USING (map_id, chunk_index)""",
    "model_questions": f"""WITH {LIVE}, b AS (SELECT block_id, type, regexp_replace(trim(coalesce(element_caption, '')), '[.]+$', '') AS cap, {_SAID.format(t=_BARE)} AS said FROM live WHERE type <> 'heading'),
        a AS (SELECT block_id, type, CASE WHEN cap <> '' THEN cap ELSE regexp_replace(left(coalesce(said[1], 'this part'), 80), '[.]+$', '') END AS about FROM b)
        SELECT block_id, [CASE type WHEN 'code' THEN 'What does the code for “' || about || '” do?' WHEN 'table' THEN 'What does the table “' || about || '” show?'
            WHEN 'image' THEN 'What does the image “' || about || '” show?' ELSE 'What is said about “' || about || '”?' END] AS questions FROM a""",
    "model_bullets": f"""WITH {LIVE}, l AS (SELECT block_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT block_id, string_split(coalesce(markdown, ''), chr(10)) AS ls FROM live)),
        o AS (SELECT block_id, i, CASE WHEN starts_with(line, '#') THEN [line] ELSE list_transform({_SAID.format(t="line")}, lambda x: '- ' || x) END AS shown FROM l)
        SELECT block_id, coalesce(string_agg(array_to_string(shown, chr(10)), chr(10) ORDER BY i) FILTER (len(shown) > 0), '') AS bullets FROM o GROUP BY block_id""",
    "cluster_texts": f"""{_PACK}, pp AS (SELECT pk.map_id, chunk_index, array_to_string(heading_path, ' › ') AS path, sum(CASE WHEN pk.token_count = 0 THEN 1 ELSE pk.token_count END) AS wt, min(ord) AS o FROM pk JOIN live USING (block_id) WHERE len(heading_path) > 0 GROUP BY ALL),
        rr AS (SELECT *, row_number() OVER (PARTITION BY map_id, chunk_index ORDER BY wt DESC, o, path) AS r FROM pp), ps AS (SELECT map_id, chunk_index, string_agg(path, ' ; ' ORDER BY r) AS paths FROM rr WHERE r <= 3 GROUP BY ALL)
        SELECT map_id, chunk_index, paths || ' || ' || coalesce(array_to_string(tags, ' '), '') AS text FROM ps JOIN maps USING (map_id)""",
    "cluster_tfidf": f"""WITH {LIVE}, h AS (SELECT block_id, text FROM live WHERE text IS NOT NULL),
        t AS (SELECT block_id, term, count(*) AS tf FROM (SELECT block_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM h) GROUP BY ALL),
        d AS (SELECT term, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM h),
        w AS (SELECT block_id, term, tf, df, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM t JOIN d USING (term), n),
        s AS (SELECT block_id, term, tf, df, n.n, w.w, round(w.w / sqrt(sum(w.w * w.w) OVER (PARTITION BY block_id)), 5) AS weight FROM w, n),
        r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY weight DESC, term) AS place FROM s)
        SELECT block_id, term, weight, place FROM r WHERE place <= 3""",
    "cluster_centroids": """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings WHERE label IS NOT NULL)
        SELECT label, dim::INTEGER AS dim, round(avg(x), 5) AS mean FROM e GROUP BY ALL""",
    "cluster_assignment": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), c AS (SELECT label, dim, avg(x) AS m FROM e WHERE label IS NOT NULL GROUP BY ALL),
        d AS (SELECT e.vec_id, c.label, sum((x - m) * (x - m)) AS d FROM e JOIN c USING (dim) GROUP BY ALL)
        SELECT vec_id, arg_min(label, d) AS cluster FROM d GROUP BY vec_id""",
    "concept_tree": f"""WITH {LIVE}, p AS (SELECT map_id, pos, unnest(list_transform(range(1, len(heading_path) + 1), lambda i: heading_path[1:i])) AS hp FROM live WHERE len(heading_path) > 0),
        k AS (SELECT *, list_transform(hp, lambda x: lower(trim(regexp_replace(regexp_replace(coalesce(x, ''), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '[\\p{{Z}}\\t\\n\\x0B\\f\\r\\x1C-\\x1F\\x{{85}}]+', ' ', 'g')))) AS path FROM p),
        g AS (SELECT map_id, path, arg_min(hp[len(hp)], pos) AS title, min(pos) AS first_pos, count(*) AS n_blocks FROM k GROUP BY ALL),
        o AS (SELECT *, (row_number() OVER (PARTITION BY map_id, path[1:len(path) - 1] ORDER BY first_pos, path) - 1)::INTEGER AS sibling_idx FROM g)
        SELECT map_id, array_to_string(path, '/') AS path, title, first_pos, n_blocks, (len(path) - 1)::INTEGER AS depth, sibling_idx, sibling_idx >= 6 AS more FROM o""",
    "concept_mapping": f"""WITH RECURSIVE {LIVE}, {WALK}, x AS (SELECT map_id, block_id, text FROM live WHERE type <> 'heading' AND text IS NOT NULL),
        t AS (SELECT map_id, block_id, term, count(*) AS tf FROM (SELECT map_id, block_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM x) GROUP BY ALL),
        df AS (SELECT map_id, term, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT map_id, count(*) AS n FROM x GROUP BY ALL),
        wt AS (SELECT t.map_id, block_id, t.term, tf * (ln((n + 1) / (df + 1)) + 1) AS wt FROM t JOIN df ON df.map_id = t.map_id AND df.term = t.term JOIN n ON n.map_id = t.map_id),
        nw AS (SELECT map_id, block_id, term, wt / sqrt(sum(wt * wt) OVER (PARTITION BY block_id)) AS weight FROM wt),
        nt AS (SELECT map_id, term, arg_min(node_id, place) AS target FROM (SELECT map_id, node_id, place, unnest(regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM w) GROUP BY ALL)
        SELECT nw.map_id, block_id, arg_max(target, {{'w': round(weight, 9), 't': nw.term}}) AS target_node_id, round(max(weight), 6) AS score FROM nw JOIN nt ON nt.map_id = nw.map_id AND nt.term = nw.term GROUP BY ALL""",
    "trace_events": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
}
