"""Command line: run a plan over files and write its outputs."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docweave.plans import config, pipeline
from docweave.plans.artifacts import Trace
from docweave.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docweave", description="Mind maps, questions, outlines and notes from Markdown and subtitles.")
    p.add_argument("--config", help="configuration file (.toml, .json, .yaml)")
    p.add_argument("--recipe", help="named plan")
    p.add_argument("--list-recipes", action="store_true")
    p.add_argument("--input", help="file or folder of notes")
    p.add_argument("--input-qa", help="question guide")
    p.add_argument("--input-markmap", help="outline to import")
    p.add_argument("--run-name")
    p.add_argument("--output-dir")
    p.add_argument("--debug-dir")
    p.add_argument("--steps", help="steps separated by commas; wins over --preset")
    p.add_argument("--preset")
    p.add_argument("--debug", action="store_true", help="store the result of each step")
    p.add_argument("--use-debug-io", action="store_true", help="reuse stored results")
    p.add_argument("--enable-tracing", action="store_true")
    p.add_argument("--folders", action="store_true", help="one folder of plain text per document and page; for a few documents")
    p.add_argument("--max-workers", type=int, help="parallel tasks of a local run")
    return p


def options_of(args: argparse.Namespace) -> config.Options:
    options = config.recipe(args.recipe) if args.recipe else config.load(args.config)
    given = {"input": args.input_qa or args.input, "qa_input": args.input_qa, "markmap_input": args.input_markmap, "run_name": args.run_name, "output_dir": args.output_dir, "debug_dir": args.debug_dir, "preset": args.preset}
    for name, value in given.items():
        if value is not None:
            setattr(options, name, value)
    if args.preset:
        options.steps = None
    if args.steps:
        options.steps = tuple(s.strip() for s in args.steps.split(",") if s.strip())
    options.debug |= args.debug
    options.folders |= args.folders
    options.use_debug_io |= args.use_debug_io
    options.tracing |= args.enable_tracing
    options.resolved_steps()
    return options


def session(workers: int | None = None) -> SparkSession:
    """The session of the run: the master that spark-submit or the configuration names, else this machine."""
    builder = SparkSession.builder.appName("docweave").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    running = SparkContext._active_spark_context is not None
    if not running and not SparkConf().get("spark.master", None):
        builder = builder.master(f"local[{workers or '*'}]")
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.list_recipes:
        print("\n".join(sorted(config.RECIPES)))
        return 0
    options = options_of(args)
    if not options.input and not options.markmap_input:
        raise SystemExit("an input is needed")
    spark = session(args.max_workers)
    subtitles = bool({"subs_list", "subs_merge"} & set(options.resolved_steps()))
    one = lambda path: files.read_documents(spark, path, "*").select(F.xxhash64("path").alias("doc_id"), "text") if path else None
    single = lambda path: one(path).withColumn("doc_id", F.lit(0).cast("long")) if path else None
    if options.markmap_input:  # the guide belongs to the one outline
        documents, outlines = single(options.input), single(options.markmap_input)
    else:
        documents, outlines = (None if subtitles else one(options.input)), None
    out = pipeline.run(spark, documents, options, outlines)
    target, trace = f"{options.output_dir.rstrip('/')}/{options.resolved_name()}", Trace()

    def write(name: str, how: Callable[[], object]) -> None:
        trace.step(f"write:{name}", how, (f"output:{name}",))

    by_document = {"by": "doc_id", "folders": options.folders}
    if "manifest" in out:
        write("manifest", lambda: files.write_manifest(out["manifest"], f"{target}/{options.manifest}", None if options.manifest.startswith("/") else f"{options.output_dir.rstrip('/')}/{options.manifest}"))
    if "transcript" in out:
        write("transcript", lambda: files.write_lines(out["transcript"], f"{target}/subtitles_merged.md", ["sort_key", "sub"]))
    if "markmap" in out:
        write("markmap", lambda: files.write_lines(out["markmap"], f"{target}/mindmap.md", ["place"], **by_document))
        write("tree_json", lambda: files.write_lines(out["tree_json"], f"{target}/tree.json", ["place", "part", "ord"], **by_document))
        write("pages", lambda: files.write_pages(out["pages"], f"{target}/pages", "doc_id", options.folders))
        links = out["missing_links"].select(F.concat_ws(": ", "node_id", F.concat(F.lit("[["), "target", F.lit("]] not found"))))
        write("link_validation", lambda: links.write.mode("overwrite").text(f"{target}/link_validation.txt"))
        write("mindmap", lambda: pipeline.envelope(out, options.input or options.markmap_input, "cli").write.mode("overwrite").json(f"{target}/mindmap.json"))
        write("nodes", lambda: out["nodes"].write.mode("overwrite").json(f"{target}/nodes.json"))
    if "qa_export" in out:
        write("qa", lambda: files.write_lines(out["qa_export"], f"{target}/qa.md", ["pos", "n", "sub"], **by_document))
    for name in ("reformat", "bullets", "clean_for_map"):
        if name in out:
            write(name, lambda name=name: files.write_lines(out[name], f"{target}/{name}.md", ["chunk_index"], line="part", **by_document))
    if options.tracing and "calls" in out:
        write("calls", lambda: out["calls"].write.mode("append").json(f"{target}/trace_calls"))
    if options.tracing:
        out["trace"].unionByName(trace.frame(spark)).write.mode("append").json(f"{target}/traces")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
