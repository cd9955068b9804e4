"""Whole plans over a table of documents.

A plan is a set of steps that run in one fixed order; each step is a
DataFrame built from those of earlier steps, so what no output needs is never
computed.  Results: a dict of named DataFrames.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import ids, tokens
from docweave.functions import text as X
from docweave.models.backend import ExtractiveBackend, ModelBackend, ask
from docweave.models.prompts import BUILT_IN, prompt
from docweave.operators import blocks as B
from docweave.operators import chunks as C
from docweave.operators import clusters as K
from docweave.operators import concepts as P
from docweave.operators import export as E
from docweave.operators import links as L
from docweave.operators import mapping as M
from docweave.operators import notes as N
from docweave.operators import trees as T
from docweave.plans.artifacts import Store, Trace, exists
from docweave.plans.config import Options
from docweave.session import cut
from docweave.sources import files, markdown

DOC = "doc_id"


def parsed_blocks(documents: DataFrame, tokenizer: str = tokens.WORD_PUNCT_NAME) -> DataFrame:
    """Blocks of the documents with paths, ids, Markdown and sizes; ``block_id`` is unique and follows the order."""
    raw = markdown.markdown_blocks(documents, DOC)
    pathed = B.heading_paths(raw, DOC, "pos").withColumnRenamed("path", "heading_path")
    md = B.block_markdown(F.col("type"), F.col("level"), F.col("text"), F.col("language"), F.col("src"), F.col("alt"))
    sized = pathed.withColumn("markdown", md).withColumn("token_count", tokens.count("markdown", tokenizer)).withColumn("is_atomic", F.col("type").isin("code", "table", "image"))
    content = ids.block_content(F.col("type"), F.col("text"), F.col("markdown"), F.col("src"), F.col("alt"), F.col("heading_path"))
    named = sized.withColumn("element_id", ids.element_id(F.col("type"), content)).withColumn("element_caption", F.when(F.col("type") == "image", F.col("alt")))
    return named.withColumn("block_id", F.xxhash64(DOC, "pos"))


def outline_tree(documents: DataFrame) -> DataFrame:
    """Adjacency rows of imported outlines."""
    raw = markdown.outline_nodes(documents, DOC)
    number = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 9, "0"))
    # A second root replaces the first: nodes before it are dropped.
    last = raw.where("parent_no is null").groupBy(DOC).agg(F.max("node_no").alias("_root"))
    kept = raw.join(last, DOC).where("node_no >= _root")
    return kept.select(DOC, number("node_no").alias("node_id"), F.when(F.col("parent_no").isNotNull(), number("parent_no")).alias("parent_id"), "sibling_idx", "title")


def _identified(walked: DataFrame) -> DataFrame:
    """Walked nodes under their stable ids.  The old id stays inside ``place``, which keeps ids that collide apart in order."""
    named = T.with_ids(walked)
    parents = named.select(DOC, F.col("node_id").alias("parent_id"), F.col("new_id").alias("_parent"))
    return named.join(parents, [DOC, "parent_id"], "left").select(DOC, F.col("new_id").alias("node_id"), F.col("_parent").alias("parent_id"), "sibling_idx", "title", "level", "path", "place")


def run(
    spark: SparkSession, documents: DataFrame | None, options: Options, outlines: DataFrame | None = None, guides: DataFrame | None = None, factory: Callable[[], ModelBackend] = ExtractiveBackend
) -> dict[str, DataFrame]:
    """Run a plan.

    ``documents``, ``outlines`` and ``guides`` are tables (doc_id, text); an
    outline and a guide belong to the document of the same id.
    """
    steps = options.resolved_steps()
    name = options.resolved_name()
    store = Store(spark, options.debug_dir, name, options.debug, options.use_debug_io)
    trace = Trace()
    if "prompts" in inspect.signature(factory).parameters:  # a client that takes prompts gets them, overrides first
        factory = partial(factory, prompts={key: prompt(key, options.prompts) for key in BUILT_IN})
    out: dict[str, DataFrame] = {}
    calls: list[DataFrame] = []

    def asked(frame: DataFrame, keys: list[str], inputs: list[str], method: str, column: str, kind: str = "string") -> DataFrame:
        made = ask(frame, keys, inputs, method, column, kind, factory, options.max_retries, options.min_delay_sec if factory is not ExtractiveBackend else 0.0, options.tracing)
        if not options.tracing:
            return made
        made = cut(made)  # asked once, whoever reads the answers
        given, said = F.to_json(F.struct(*inputs)), F.to_json(F.struct(column))
        calls.append(made.select(F.lit(method).alias("chain_name"), F.lit(trace.run_id).alias("run_id"), F.to_json(F.struct(*keys)).alias("record"), given.alias("inputs"), said.alias("outputs"), F.col("_started").alias("started_at"), F.round("_seconds", 4).alias("duration_sec"), X.token_count(given).alias("input_tokens"), X.token_count(said).alias("output_tokens")))
        out["calls"] = reduce(DataFrame.unionByName, calls)
        return made.select(*keys, column)

    def step(key: str, make: Callable[[], DataFrame]) -> DataFrame:
        out[key] = trace.step(key, lambda: store.through(key, make), (f"step:{key}",))
        return out[key]

    if "subs_list" in steps:
        step("manifest", lambda: files.list_subtitles(spark, options.input, options.include_html))
        out["trace"] = trace.frame(spark)
        return out
    if "subs_merge" in steps:
        places = [options.manifest, f"{options.output_dir.rstrip('/')}/{name}/{options.manifest}"]
        manifest = next((p for p in places if exists(spark, p)), None)
        step("transcript", lambda: E.transcript_lines(files.read_subtitles(spark, options.input, options.include_html, manifest)))
        out["trace"] = trace.frame(spark)
        return out

    if "chunk" in steps:
        step("blocks", lambda: parsed_blocks(documents, options.tokenizer))
        limited = out["blocks"].withColumn("max_tokens", F.lit(options.max_tokens)).withColumn("overlap_tokens", F.lit(options.overlap_tokens))
        step("packed", lambda: C.pack(limited, DOC, strict_overlap=options.strict_overlap))
        step("chunks", lambda: C.chunk_texts(out["packed"], out["blocks"], DOC))
    for s, method in (("reformat", "reformat"), ("bullets", "bullets"), ("clean_for_map", "clean")):
        if s in steps:
            filled = out["chunks"].where(X.strip("md_text") != "").withColumn("md_text", X.sanitize_markdown("md_text"))
            step(s, lambda filled=filled, method=method: E.join_parts(asked(filled, [DOC, "chunk_index"], ["md_text"], method, "answer"), DOC, "chunk_index", "answer"))
    if "qa" in steps:
        source = out["blocks"].where("type <> 'heading'").withColumn("caption", F.coalesce("element_caption", F.substring(F.coalesce("text", F.lit("")), 1, 80)))
        questions = asked(source, [DOC, "block_id", "pos"], ["markdown", "caption", "type"], "questions", "questions", "array<string>")
        one = questions.select(DOC, "block_id", "pos", F.posexplode("questions").alias("n", "question"))
        answered = asked(one.join(out["blocks"].select("block_id", "markdown", "heading_path"), "block_id"), [DOC, "block_id", "pos", "n", "question", "heading_path"], ["question", "markdown"], "answer", "answer")
        step("qa", lambda: answered)
        step("qa_export", lambda: E.nested_qa_lines(out["qa"], DOC, ["pos", "n"]))
    if "tree" in steps:
        step("tags", lambda: asked(out["chunks"], [DOC, "chunk_index"], ["md_text"], "tags", "tags", "array<string>"))
        of_chunk = out["packed"].select("block_id", "chunk_index").distinct()
        step("chunk_trees", lambda: P.heading_tree(out["blocks"].join(of_chunk, "block_id"), DOC, [DOC, "chunk_index"]))
        step("tree", lambda: P.heading_tree(out["blocks"], DOC))
    if "cluster" in steps:
        paths = C.chunk_top_paths(out["packed"], out["blocks"], DOC)
        texts = out["tags"].join(paths, [DOC, "chunk_index"], "left").select(DOC, "chunk_index", K.cluster_text(F.array("paths"), F.col("tags")).alias("text"))
        points = K.hashed_vectors(K.tfidf(texts, [DOC, "chunk_index"], "text", [DOC]), [DOC, "chunk_index"])
        step("clusters", lambda: K.grouped_kmeans(points, DOC, "chunk_index"))
    if "merge" in steps or "refine" in steps:
        if "merge" in steps and "clusters" in out:
            by_cluster, merged = P.merged_trees(out["chunk_trees"], out["clusters"], DOC)
            step("cluster_trees", lambda: by_cluster)
            step("merged", lambda: merged)
        made = P.as_nodes(P.refine(out.get("merged", out["tree"]), DOC), DOC)
        step("nodes", lambda: _identified(T.walk(made.select(DOC, "node_id", "parent_id", "sibling_idx", "title"), DOC)))
    if "qa_parse" in steps:
        guide = guides if guides is not None else documents
        parsed = markdown.question_blocks(guide, DOC)
        pair = F.concat("q", F.lit(" || "), "a")
        step("questions", lambda: parsed.withColumn("element_id", ids.element_id(F.lit("qa"), pair)).withColumn("block_id", F.xxhash64(DOC, "pos", F.lit("qa"))))
    if "import_markmap" in steps:
        step("nodes", lambda: _identified(T.walk(outline_tree(outlines), DOC)))
    if "map" in steps:
        sources = []
        if "questions" in out:
            sources.append(out["questions"].select(DOC, "block_id", "pos", "element_id", F.lit("qa").alias("type"), F.lit("").alias("element_caption"), F.concat(F.lit("## "), "q", F.lit("\n"), "a").alias("markdown"), F.col("q").alias("text"), "q", "a"))
        if "blocks" in out and "import_markmap" not in steps:
            plain = out["blocks"].where(F.col("type") != "heading")
            sources.append(plain.select(DOC, "block_id", "pos", "element_id", "type", F.coalesce("element_caption", F.lit("")).alias("element_caption"), "markdown", F.coalesce("text", "alt", F.lit("")).alias("text"), F.lit(None).cast("string").alias("q"), F.lit(None).cast("string").alias("a")))
        queue = sources[0] if len(sources) == 1 else sources[0].unionByName(sources[1])
        step("map_queue", lambda: M.batches(queue.select(DOC, "block_id", "pos", "element_id", "type"), DOC, options.map_batch_override))
        plain = queue.where("type <> 'qa'")
        placed = [P.place_blocks(K.tfidf(plain, [DOC, "block_id"], "text", [DOC]), out["nodes"], DOC)] if len(sources) == 2 or "questions" not in out else []
        if "questions" in out:
            placed += _place_questions(out["questions"], out["nodes"], 3 if len(sources) == 1 else 1)
        step("mapping", lambda: reduce(DataFrame.unionByName, placed))
        first = queue.groupBy(DOC, "element_id").agg(F.min_by("block_id", "pos").alias("block_id"))
        refs = queue.join(first, [DOC, "element_id", "block_id"], "left_semi").join(out["mapping"], [DOC, "block_id"])
        step("refs", lambda: refs.select(DOC, F.col("target_node_id").alias("node_id"), F.col("pos").cast("long").alias("ord"), "element_id", "type", "element_caption", "markdown", "q", "a", ids.content_hash(F.col("markdown")).alias("hash")))
    if "enrich_markmap_notes" in steps:
        step("refs", lambda: _notes(out["nodes"], name, asked, trace.run_id))
    if "nodes" in out:
        refs = out.get("refs")
        if refs is None:
            refs = spark.createDataFrame([], f"{DOC} {out['nodes'].schema[DOC].dataType.simpleString()}, node_id string, ord long, element_id string, type string, element_caption string, markdown string, q string, a string")
        out["markmap"] = E.markmap_lines(out["nodes"], refs, F.lit(None).cast("string") if name is None else X.camel(F.lit(name)), DOC)
        out["pages"] = E.page_lines(out["nodes"], refs, DOC)
        out["tree_json"] = E.mindmap_json_lines(out["nodes"], refs if "hash" in refs.columns else refs.withColumn("hash", ids.content_hash(F.coalesce("markdown", F.lit("")))), DOC)
        paged = out["nodes"].join(refs.select(DOC, "node_id").distinct(), [DOC, "node_id"], "left_semi")
        out["missing_links"] = L.missing_links(out["pages"], L.page_names(paged, DOC), DOC, text="part")
    out["trace"] = trace.frame(spark)
    return out


def _place_questions(questions: DataFrame, nodes: DataFrame, passes: int) -> list[DataFrame]:
    """A node per question; further passes take those without one, by their path too, and by their answer too."""
    said = [F.col("q"), F.concat_ws(" ", "q", F.array_join("heading_path", " ")), F.concat_ws(" ", "q", F.array_join("heading_path", " "), "a")]
    found: list[DataFrame] = []
    for text in said[:passes]:
        left = questions
        for before in found:
            left = left.join(before.select(DOC, "block_id"), [DOC, "block_id"], "left_anti")
        found.append(P.place_blocks(K.tfidf(left.select(DOC, "block_id", text.alias("text")), [DOC, "block_id"], "text", [DOC]), nodes, DOC))
    return found


def _notes(nodes: DataFrame, name: str, asked: Callable[..., DataFrame], run_id: str) -> DataFrame:
    """Notes of all nodes as their first content: leaves from their path, branches from the summaries of their children."""
    notes = N.write_notes(nodes, None, X.camel(F.lit(name)), asked, "extractive", F.lit(run_id), DOC)
    return notes.select(DOC, "node_id", F.lit(-1).cast("long").alias("ord"), "element_id", F.lit("paragraph").alias("type"), F.lit("").alias("element_caption"), "markdown", F.lit(None).cast("string").alias("q"), F.lit(None).cast("string").alias("a"))


def envelope(out: dict[str, DataFrame], source: str, run_id: str) -> DataFrame:
    """One row per tree: schema version, id, dates, source, sorted tags (those of the chunks, else the first titles)."""
    nodes = out["nodes"].select(DOC).distinct()
    if "tags" in out:
        tags = out["tags"].select(DOC, F.explode("tags").alias("t")).groupBy(DOC).agg(F.array_sort(F.collect_set("t")).alias("tags"))
    else:
        tags = T.fallback_tags(out["nodes"], DOC).select(DOC, F.split("tags", ",").alias("tags"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return nodes.join(tags, DOC, "left").select(DOC, F.lit("1.0.0").alias("schema_version"), F.expr("uuid()").alias("map_id"), now.alias("created_at"), now.alias("updated_at"), F.lit(1).alias("revision"), F.lit(source).alias("source_path"), F.lit(run_id).alias("run_id"), "tags")
