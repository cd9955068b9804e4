import pytest
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.models.backend import ExtractiveBackend, Limiter, ask, call
from docweave.operators import clusters as K
from docweave.plans import config, pipeline
from docweave.plans import text_queries as Q
from docweave.plans.artifacts import Store, Trace
from docweave.sources import files
from docweave.sources import json_trees as J
from docweave.sources import markdown as R
from tests.conftest import rows

NOTE = "# A\n\nText with `code` and [link](x) ![pic](p.png)\nsecond line\n\n### C\n- one\n  more\n- two\n\n> quote\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\n# no heading\n```\n\nSet\n===\n\n    indented\n"


def test_blocks():
    got = [(b.type, b.level, b.text or b.src) for b in R.parse_blocks(NOTE)]
    assert got == [
        ("heading", 1, "A"), ("image", None, "p.png"), ("paragraph", None, "Text with  and linksecond line"), ("heading", 3, "C"), ("paragraph", None, "onemore"), ("paragraph", None, "two"),
        ("paragraph", None, "quote"), ("table", None, "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("code", None, "# no heading"), ("heading", 1, "Set"),
    ]
    assert R.parse_blocks(None) == [] and R.parse_blocks(" \n") == [] and [b.type for b in R.parse_blocks("```\nopen")] == ["code"]
    assert [b.text for b in R.parse_blocks("[![alt](i.png)](l)")] == [None]


def test_questions():
    text = "# S\r\n\r\n## T\r\n### Q1\r\n\r\nans\r\n\r\n```\r\n# x\r\n```\r\n## Q2\r\ntext\r\n# E\r\n"
    assert R.parse_questions(text) == [(["S", "T"], "Q1", "ans\n\n```\n# x\n```"), (["S", "T"], "Q2", "text")]
    assert R.parse_questions(None) == []


def test_outline():
    assert [(n[1], n[2], n[3], n[4]) for n in R.parse_outline("# R\n- a\n  - [b](x.md)\n- c\n## H\n- d")] == [(None, 0, 0, "R"), (0, 1, 0, "a"), (1, 2, 0, "b"), (0, 1, 1, "c"), (3, 2, 0, "H"), (0, 1, 2, "d")]
    assert R.parse_outline("text") == []


def test_html():
    html = "<html><head><style>x</style></head><body><h2>T</h2><p>a <b>b</b> &amp; <a href='/x'>l</a></p><ol><li>1<li>2</ol><pre>k  k</pre></body></html>"
    assert R.html_to_markdown(html) == "## T\n\na **b** & [l](/x)\n\n1. 1\n2. 2\n\n```\nk  k\n```"
    assert R.html_to_markdown(None) is None and R.html_to_markdown("") == ""


def test_readers_on_tables(spark):
    frame = spark.createDataFrame([(1, NOTE, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, type string")
    assert R.markdown_blocks(frame).count() == 10
    assert R.markdown_blocks(frame.limit(0)).count() == 0
    assert R.html_markdown(frame).count() == 3
    assert R.outline_nodes(spark.createDataFrame([(1, "# a\n- b")], "doc_id long, text string")).where("parent_no = 0").count() == 1


def test_files(spark, tmp_path):
    for name, text in (("a/file2.srt", "1\n00:01 --> 00:02\ntwo"), ("a/file10.srt", "ten"), ("b/x.vtt", "WEBVTT\n\nx"), ("b/y.txt", "no")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    listed = files.list_subtitles(spark, str(tmp_path / "in"))
    assert [r["path"].rsplit("/", 1)[1] for r in listed.orderBy("sort_key").collect()] == ["file2.srt", "file10.srt", "x.vtt"]
    files.write_manifest(listed, str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")).count() == 3
    # A manifest chooses the files and their order; pages are read as Markdown.
    (tmp_path / "in" / "b" / "p.HTML").write_text("<html><body><h1>T</h1><p>q</p></body></html>")
    (tmp_path / "in" / "b" / "z.Srt").write_text("z")
    lines = [str(tmp_path / "in" / "b" / "z.Srt"), str(tmp_path / "in" / "nowhere.srt"), "", str(tmp_path / "in" / "b" / "p.HTML"), str(tmp_path / "in" / "a" / "file10.srt")]
    (tmp_path / "list.txt").write_text("\n".join(lines))
    read = files.read_subtitles(spark, str(tmp_path / "in"), True, str(tmp_path / "list.txt"))
    assert [r["body"] for r in read.orderBy("sort_key").collect()] == ["z", "# T\n\nq", "ten"]
    assert files.read_subtitles(spark, str(tmp_path / "in")).count() == 4 and files.read_subtitles(spark, str(tmp_path / "in"), True).count() == 5
    files.write_manifest(listed, str(tmp_path / "m1"), str(tmp_path / "m2"))
    assert files.read_manifest(spark, str(tmp_path / "m2")).count() == 3
    many = spark.createDataFrame([(1, 0, "a"), (2, 0, "c"), (1, 1, "b")], "d int, o int, line string")
    files.write_lines(many, str(tmp_path / "many"), ["o"], by="d")
    assert [(r["d"], r["value"]) for r in spark.read.json(str(tmp_path / "many")).collect()] == [(1, "a"), (1, "b"), (2, "c")]
    files.write_lines(many, str(tmp_path / "apart"), ["o"], by="d", folders=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "apart" / "d=1")).collect()] == ["a", "b"]
    pages = many.selectExpr("d AS map_id", "line AS page", "line AS node_id", "o AS ord", "line AS part")
    files.write_pages(pages, str(tmp_path / "pages"))
    assert spark.read.json(str(tmp_path / "pages")).count() == 3
    assert sorted(r["body"] for r in files.read_subtitles(spark, str(tmp_path / "in")).collect()) == ["ten", "two", "x", "z"]
    files.write_lines(spark.createDataFrame([(1, "b"), (0, "a")], "o int, line string"), str(tmp_path / "o"), ["o"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["a", "b"]


def test_config(tmp_path):
    assert config.recipe("clarify_markdown").max_tokens == 2048
    for bad in (lambda: config.recipe("nope"), lambda: config.Options(preset="nope").resolved_steps(), lambda: config.Options(steps=("x",)).resolved_steps(), lambda: config.Options(preset="map_qa_onto_markmap").resolved_steps()):
        with pytest.raises(ValueError):
            bad()
    path = tmp_path / "c.toml"
    path.write_text("﻿[pipeline]\nsteps = ['map', 'chunk']\npreset = 'qa'\n[chunk]\nmax_tokens = 7\n[paths]\nfile_id = 'r'\n[presets.named]\nmine = ['chunk']\n", encoding="utf-8")
    with pytest.warns(UserWarning):
        options = config.load(str(path))
    assert options.resolved_steps() == ("chunk", "map") and options.max_tokens == 7 and options.run_name == "r" and "qa" in options.presets and options.presets["mine"] == ("chunk",)
    assert config.parse('{"a": 1}', ".json") == {"a": 1}


def test_call_and_limiter():
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ValueError
        return "ok"

    assert call(flaky, sleep=waits.append) == "ok" and len(waits) == 2 and 1 <= waits[0] < 1.26 and 2 <= waits[1] < 2.26
    with pytest.raises(ZeroDivisionError):
        call(lambda: 1 / 0, attempts=0, sleep=waits.append)
    limiter = Limiter(0.01)
    for _ in range(3):
        limiter.wait()


def test_ask(spark):
    frame = spark.createDataFrame([(1, "Alpha beta. Gamma!"), (2, None)], "k int, md string")
    assert {r["k"]: r["b"] for r in ask(frame, ["k"], ["md"], "bullets", "b").collect()} == {1: "- Alpha beta.\n- Gamma!", 2: ""}
    class Client(ExtractiveBackend):
        def tags(self, markdown):
            return '["x", 1, "y"]' if markdown else "no list"

    assert {r["k"]: r["t"] for r in ask(frame, ["k"], ["md"], "tags", "t", "array<string>", Client).collect()} == {1: ["x", "y"], 2: []}
    assert len(ExtractiveBackend().pick_prereqs("a", list("abcdefgh"))) == 5
    assert ExtractiveBackend().clean("x\n\nx\n\ny") == "x\n\ny"


def test_plans(spark, tmp_path):
    docs = spark.createDataFrame([(1, NOTE), (2, "# B\n\n## Why yes?\n\nyes it is\n"), (3, None)], "doc_id long, text string")
    out = pipeline.run(spark, docs, config.Options(preset="detailed_mindmap", max_tokens=20, run_name="my run"))
    assert {"blocks", "chunks", "clusters", "nodes", "refs", "markmap", "pages", "trace"} <= set(out)
    assert {r["line"] for r in out["markmap"].where("doc_id = 2").collect()} >= {"# B"} or out["markmap"].where("doc_id = 2").count() == 2
    for preset, key in (("qa", "qa_export"), ("bullets", "bullets")):
        assert pipeline.run(spark, docs, config.Options(preset=preset))[key].count() > 0
    outlines = spark.createDataFrame([(2, "# B\n- yes\n  - deep\n- no")], "doc_id long, text string")
    notes = pipeline.run(spark, docs, config.Options(preset="enrich_markmap_notes", markmap_input="x"), outlines)
    assert notes["refs"].count() == 4 and notes["refs"].where("markdown not like '---%'").count() == 0
    mapped = pipeline.run(spark, docs, config.Options(preset="map_qa_onto_markmap", markmap_input="x"), outlines, docs)
    assert mapped["refs"].where("type = 'qa' and q = 'Why yes?'").count() == 1
    import json

    text = "".join(r["line"] for r in notes["tree_json"].orderBy("place", "part", "ord").collect())
    assert json.loads(text)["children"][0]["children"][0]["title"] == "deep"
    assert pipeline.envelope(notes, "s", "r").first()["tags"] == ["b", "deep", "no", "yes"]


def test_store_and_trace(spark, tmp_path):
    store = Store(spark, str(tmp_path), "r", True, True)
    assert not store.exists("x")
    assert store.through("x", lambda: spark.range(3)).count() == 3
    assert store.through("x", lambda: spark.range(9)).count() == 3
    trace = Trace()
    trace.step("a", lambda: 1)
    with pytest.raises(ZeroDivisionError):
        trace.step("b", lambda: 1 / 0)
    assert rows(trace.frame(spark), "seq", "chain_name", "error") == [(1, "a", None), (2, "b", "division by zero")]


def test_clusters(spark):
    texts = spark.createDataFrame([(1, i, t) for i, t in enumerate(["sun star sky", "star sky sun moon", "soup bread salt", "bread soup pepper"])] + [(2, 0, "alone"), (3, 0, "same"), (3, 1, "same")], "g long, i long, t string")
    weights = K.tfidf(texts, ["g", "i"], "t", ["g"])
    assert all(abs(r["s"] - 1) < 1e-9 for r in weights.groupBy("g", "i").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    got = {(r["g"], r["i"]): r["cluster"] for r in K.grouped_kmeans(K.hashed_vectors(weights, ["g", "i"]), "g", "i").collect()}
    assert got[1, 0] == got[1, 1] != got[1, 2] == got[1, 3] and got[2, 0] == got[3, 0] == got[3, 1] == 0
    points = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "i int, v array<double>")
    assert K.truncated_svd(points, "v", 2) == [[1.0, 0.0], [0.0, 1.0]]
    near = K.nearest(points.where("v is not null"), [(0, [0.0, 0.0]), (1, [3.0, 1.0])])
    assert rows(near, "i", "cluster") == [(1, 1), (2, 0)]


def test_stream(spark, tmp_path):
    from docweave.streaming.ingest import arrivals, stream_blocks, stream_documents, stream_transcripts

    spark.createDataFrame([(1, "# a\n\nb", "s"), (2, "1\n00:01 --> 00:02\nhi", "s")], "doc_id long, text string, source string").selectExpr("*", "timestamp'2024-01-01' as fetched_at").write.parquet(str(tmp_path / "in"))
    docs = stream_documents(spark, str(tmp_path / "in"))
    for name, frame, mode, n in (("t_blocks", stream_blocks(docs), "append", 3), ("t_subs", stream_transcripts(docs), "append", 1), ("t_arr", arrivals(docs), "complete", 1)):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() >= n


def test_sql_functions(spark):
    from docweave.functions.udtf import register

    register(spark)
    spark.createDataFrame([(1, "# a\n- b\n  - c"), (2, None)], "doc_id long, text string").createOrReplaceTempView("t_docs")
    assert spark.sql("SELECT t.doc_id, b.type FROM t_docs t, LATERAL markdown_blocks(t.text) b").count() == 3
    assert spark.sql("SELECT n.title FROM t_docs t, LATERAL outline_nodes(t.text) n WHERE n.parent_no = 1").first()[0] == "c"


def test_prompts_and_recipes(tmp_path):
    from docweave.models.prompts import prompt

    (tmp_path / "p.txt").write_text("mine")
    assert prompt("merge", {"merge": str(tmp_path / "p.txt")}) == "mine"
    with pytest.warns(UserWarning):
        assert prompt("merge", {"merge": str(tmp_path / "none.txt")}).startswith("Merge")
    with pytest.raises(KeyError):
        prompt("nope")
    assert len(config.write_recipes(str(tmp_path / "r"))) == len(config.RECIPES) and config.write_recipes(str(tmp_path / "r")) == []
    assert config.load(str(tmp_path / "r" / "focus_markdown.toml")).resolved_steps() == ("chunk", "clean_for_map")


def test_long_odd_texts_take_linear_time():
    import time

    for p in ("![", "[[", "[a](", "<!--", "<a ", "\n    x", "| ", "```\n", "> ", "**a"):
        text = p * (40000 // len(p))
        for read in (R.parse_blocks, R.parse_questions, R.parse_outline, R.html_to_markdown):
            began = time.time()
            read(text)
            assert time.time() - began < 5, (p, read)


def test_pages_and_notes_are_told_apart(spark, tmp_path):
    body = "<body><p>a</p></body></html>"
    pages = [f"<html>{body}", f"﻿<html>{body}", f"<!DOCTYPE html>\n<html lang='en'>{body}", f"\n  <HTML>{body}", f"﻿\r\n<!doctype HTML PUBLIC 'x'><html>{body}", f"<?xml version='1.0'?>\n<!-- made --><!-- so -->\n<html>{body}"]
    notes = ["# A\n\nx <!-- hidden --> y", "# A\n\nin --> out", "# A\n\n```\n1\n00:00:01,000 --> 00:00:02,000\nx\n```\n", "﻿# A", "<!-- a -->\n\n# A", "Text on <html> and <body>."]
    cues = ["1\n00:00:01,000 --> 00:00:02,000\nx", "WEBVTT\n\n00:01.000 --> 00:02.000 align:start\nx", "﻿00:00:01.000 --> 00:00:02.000\r\nx"]
    spark.createDataFrame([*enumerate(pages + notes + cues), (99, None), (98, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    read = Q.read_html(spark, str(tmp_path))
    assert rows(read) == [(i, "a") for i in range(len(pages))]
    assert {r[0] for r in rows(Q.read_markdown_blocks(spark, str(tmp_path)), "doc_id")} == {len(pages) + i for i in range(len(notes))}
    many = spark.createDataFrame([(1, "<!-- x -->" * 20000 + "z"), (2, "```\n" * 20001), (3, "00:00" * 50000)], "doc_id long, text string")
    assert rows(many.select("doc_id", X.is_html_page(F.col("text")), X.is_subtitles(F.col("text")))) == [(1, False, False), (2, False, False), (3, False, False)]


def test_values_of_any_size(spark):
    url = "data:image/png;base64," + "iVBORw0KGgo" * 2000
    assert [(b.type, b.src) for b in R.parse_blocks(f"![a]({url})")] == [("image", url)]
    assert [(b.type, b.text, b.src, b.alt) for b in R.parse_blocks('x ![a](p(1).png "t") y ![](<a b.png>) z ![b](no end')] == [("image", None, "p(1).png", "a"), ("image", None, "a b.png", ""), ("paragraph", "x  y  z ![b](no end", None, None)]
    assert R.plain_inline("[a](" + "x" * 5000 + ") b") == "a b" and R.plain_inline("**_~~**a**~~_**") == "a"
    names = ["f9", "f10", "f" + "1" * 25, "f" + "2" * 25, "f" + "1" * 26, "f007", "g1"]
    frame = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r["p"] for r in frame.orderBy(X.natural_key("p")).collect()] == ["f007", "f9", "f10", "f" + "1" * 25, "f" + "2" * 25, "f" + "1" * 26, "g1"]


def test_deep_json(spark):
    import json

    n = 20000
    deep = '{"title":"t","children":[' * n + "]}" * n
    assert [x[2] for x in J.parse_tree(deep)] == list(range(n))
    frame = spark.createDataFrame([(1, deep), (2, "[" * n), (3, "{" * n), (4, None), (5, '{"root": "r", "nodes": [1, {"title": " "}]}')], "doc_id long, text string")
    assert rows(J.tree_nodes(frame).groupBy("doc_id").count()) == [(1, n), (5, 3)]
    assert J.parse_picks("[" * n) == [] and J.parse_picks('["a", 1, "b"]') == ["a", "b"]
    for text in ('{"a": [1, -2.5e3, "x\\u0041", true, null, {}], "b": {"c": []}}', "[]", "[[1], {}]", '"s"', "7", ' [ 1 , 2 ] '):
        assert J._deep(text) == json.loads(text)
    for text in ("", "[1", '{"a"', '{"a":', "[1}", "[1] 2", "[,]", '{"a" 1}', "[1,]"):
        assert J._parsed(text) is None
        with pytest.raises((ValueError, IndexError)):
            J._deep(text)


def test_checkpoints_need_a_shared_folder(monkeypatch):
    from docweave import session

    class Context:
        master, folder = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

        def getConf(self):
            return {}

    class Session:
        def __init__(self, conf):
            self.conf, self.sparkContext = conf, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session({}))
    assert session.ensure_checkpoint_dir(Session({"spark.checkpoint.dir": "hdfs:/shared"})) == "hdfs:/shared"
    local = Session({})
    local.sparkContext.master = "local[2]"
    assert "docweave-checkpoint" in session.ensure_checkpoint_dir(local)
    assert not session._is_local("local-cluster[3,2,1000]") and session._is_local("local")


def test_spread(spark, tmp_path):
    from docweave.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 100
    spark.range(100).repartition(2 * cores).write.option("maxRecordsPerFile", 2).parquet(str(tmp_path / "many"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        assert "Exchange" not in spread(spark.read.parquet(str(tmp_path / "many")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    grouped = one.groupBy("id").count()
    assert spread(grouped) is grouped


def test_command_line(spark, tmp_path):
    from docweave.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "n.md").write_text(NOTE)
    (tmp_path / "in" / "a.srt").write_text("1\n00:01 --> 00:02\nhello")
    out = tmp_path / "out"
    assert main(["--recipe", "mindmap_from_markdown", "--input", str(tmp_path / "in" / "n.md"), "--output-dir", str(out), "--run-name", "r", "--enable-tracing"]) == 0
    assert spark.read.json(str(out / "r" / "mindmap.md")).count() > 0 and spark.read.json(str(out / "r" / "traces")).where("chain_name like 'write:%' and duration_sec > 0").count() > 3
    for recipe in ("list_notes_in_dir", "merge_notes_from_manifest"):
        assert main(["--recipe", recipe, "--input", str(tmp_path / "in"), "--output-dir", str(out), "--run-name", "s"]) == 0
    assert [r[0] for r in spark.read.text(str(out / "s" / "subtitles_merged.md")).collect()] == ["# in", "## a", "hello"]
    assert main(["--list-recipes"]) == 0


def test_prompts_reach_a_client(spark):
    docs = spark.createDataFrame([(1, NOTE)], "doc_id long, text string")

    class Client(ExtractiveBackend):
        def __init__(self, prompts=None):
            self.prompts = prompts

        def bullets(self, markdown):
            return self.prompts["bullets"][:7]

    out = pipeline.run(spark, docs, config.Options(preset="bullets"), factory=Client)
    assert {r["part"].strip() for r in out["bullets"].collect()} == {"Rewrite"}


def test_questions_get_further_passes(spark):
    guide = "# Tools\n\n## Nothing here fits\n\nthe kiln\n\n## Kiln?\n\nyes\n\n# Looms\n\n## Why?\n\nso\n"
    docs = spark.createDataFrame([(2, guide)], "doc_id long, text string")
    outlines = spark.createDataFrame([(2, "# Map\n- kiln\n- looms")], "doc_id long, text string")
    out = pipeline.run(spark, docs, config.Options(preset="map_qa_onto_markmap", markmap_input="x", map_batch_override=2), outlines, docs)
    placed = out["refs"].join(out["nodes"], ["doc_id", "node_id"])
    assert rows(placed, "q", "title") == [("Kiln?", "kiln"), ("Nothing here fits", "kiln"), ("Why?", "looms")]
    assert rows(out["map_queue"].groupBy("batch").count()) == [(0, 2), (1, 1)]


def test_traced_calls(spark):
    docs = spark.createDataFrame([(1, NOTE)], "doc_id long, text string")
    out = pipeline.run(spark, docs, config.Options(preset="qa", tracing=True))
    calls = out["calls"].collect()
    assert {c["chain_name"] for c in calls} == {"questions", "answer"} and len({c["run_id"] for c in calls}) == 1
    assert all(c["duration_sec"] >= 0 and c["started_at"] > 1e9 and c["input_tokens"] > 0 and c["output_tokens"] > 0 and "doc_id" in c["record"] for c in calls)
    assert any("What is said about" in c["outputs"] for c in calls if c["chain_name"] == "questions")
    assert out["qa"].count() == sum(c["chain_name"] == "answer" for c in calls)
    assert "calls" not in pipeline.run(spark, docs, config.Options(preset="qa"))
