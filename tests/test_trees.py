import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from docweave.models.backend import ExtractiveBackend, ask
from docweave.operators import concepts as P
from docweave.operators import export as E
from docweave.operators import links as L
from docweave.operators import mapping as M
from docweave.operators import notes as N
from docweave.operators import ordering as O
from docweave.operators import trees as T
from docweave.plans import cluster_queries as Q
from tests.conftest import rows

NODES = "map_id long, node_id string, parent_id string, depth int, sibling_idx int, title string, created_at string, deleted_at string"


def sample(spark):
    return spark.createDataFrame([
        (1, "r", None, 0, 0, "Root", "1", None), (1, "r", None, 0, 0, "Root", "1", None), (1, "a", "r", 1, 1, "Same", "1", None), (1, "b", "r", 1, 0, None, "1", None),
        (1, "a1", "a", 2, 0, "Leaf\none", "1", None), (1, "dead", "a", 2, 1, "x", "1", "2"), (1, "lost", "nowhere", 1, 0, "y", "1", None), (2, "r", None, 0, 0, "Other", "1", None),
    ], NODES)


def test_walk(spark):
    walked = T.walk(T.live_nodes(sample(spark)))
    order = [(r["map_id"], r["node_id"], r["level"]) for r in walked.orderBy("map_id", "place").collect()]
    assert order == [(1, "r", 0), (1, "b", 1), (1, "a", 1), (1, "a1", 2), (2, "r", 0)]
    assert rows(T.node_types(walked), "node_id", "ntype", "map_id") == sorted([("r", "hub", 1), ("b", "leaf", 1), ("a", "hub", 1), ("a1", "leaf", 1), ("r", "leaf", 2)], key=repr)
    assert rows(T.walk(T.live_nodes(sample(spark)).limit(0))) == []
    ids = T.with_ids(walked).where("map_id = 1").select("new_id").collect()
    assert len({r[0] for r in ids}) == 4
    tags = {r["map_id"]: r["tags"] for r in T.fallback_tags(walked).collect()}
    assert tags == {1: "leaf\none,root,same", 2: "other"}


def test_lists_against_a_loop(spark):
    rnd = random.Random(1)
    data, kids, parent = [(1, "n0", None, 0, 0, "t0", "1", None)], {}, {"n0": None}
    for i in range(1, 60):
        p = f"n{rnd.randrange(max(1, i // 2))}"
        data.append((1, f"n{i}", p, 0, len(kids.get(p, [])), f"t{i}", "1", None))
        kids.setdefault(p, []).append(f"n{i}")
        parent[f"n{i}"] = p
    walked = T.walk(T.live_nodes(spark.createDataFrame(data, NODES)))

    def near(n):
        p = parent[n]
        sib = [x for x in kids.get(p, []) if x != n] if p else []
        g = parent[p] if p else None
        return p, sib, [c for u in kids.get(g, []) for c in kids.get(u, [])] if g else []

    want = {}
    for n in parent:
        p, sib, cous = near(n)
        want[n] = [x for x in dict.fromkeys([*sib, *([p] if p else []), *cous]) if x != n][:5]
    assert {r["node_id"]: r["see_also"] for r in T.see_also(walked).collect()} == want
    want = {n: [x for x in dict.fromkeys([*near(n)[1], *near(n)[2]]) if x != n][:30] for n in parent}
    assert {r["node_id"]: r["candidates"] for r in T.prereq_candidates(walked).collect()} == want
    picks = spark.createDataFrame([(1, "n0", 0, "n0"), (1, "n0", 1, "n1"), (1, "n0", 2, "ghost"), (1, "n1", 0, "n0"), (1, "n1", 1, "n0")], "map_id long, node_id string, ord int, pick string")
    assert ("n1", "n0", 1) in rows(T.valid_picks(picks, walked), "node_id", "pick", "place")
    assert not [r for r in rows(T.valid_picks(picks, walked), "node_id", "pick") if r[0] == "n0"]


def test_merge_schedule(spark):
    frame = spark.createDataFrame([(g, i) for g, n in (("a", 1), ("b", 2), ("c", 5)) for i in range(n)], "g string, i int")
    got = rows(T.merge_schedule(frame, "g", ["i"]), "g", "round", "left", "right")
    assert got == [("b", 1, 0, 1), ("c", 1, 0, 1), ("c", 1, 2, 3), ("c", 2, 0, 1), ("c", 3, 0, 1)]


def test_exports(spark):
    walked = T.walk(T.live_nodes(sample(spark)))
    refs = spark.createDataFrame([
        (1, "a", 1, "e1", "paragraph", "", "---\nid: x\n---\n# same\nbody", None, None), (1, "a", 2, "e2", "qa", "", "", "Why?", " because "), (1, "a1", 3, "e3", "code", "Cap", "```\nx\n```", None, None), (1, "gone", 4, "e4", "paragraph", "", "z", None, None),
    ], "map_id long, node_id string, ord long, element_id string, type string, element_caption string, markdown string, q string, a string")
    lines = [r["line"] for r in E.markmap_lines(walked, refs, F.lit("F")).where("map_id = 1").orderBy("place").collect()]
    assert lines == ["# Root", "  - Untitled", "  - [Same](F/Same.md)", "    - [Leaf one](F/LeafOne.md)"]
    inline = [r["line"] for r in E.inline_markmap_lines(walked, refs).where("map_id = 1").orderBy("place", "ord", "sub").collect()]
    assert inline[-4:] == ["      - 🧩 Cap", "        ```", "        x", "        ```"]
    parts = [r["part"] for r in E.page_lines(walked, refs).where("node_id = 'a'").orderBy("ord").collect()]
    assert parts == ["---\nid: x\n---", "# same\nbody", "### ❓ Why?\nbecause"]
    qa = spark.createDataFrame([(1, 5, ["A", "B"], " q1 ", "x"), (1, 7, ["A", "C"], "q2", None), (1, 9, ["A", "B"], "q3", "z"), (1, 10, None, "q4", "")], "d long, pos int, heading_path array<string>, question string, answer string")
    shown = [r["line"] for r in E.nested_qa_lines(qa, "d", ["pos"]).orderBy("pos", "sub").collect()]
    assert shown == ["# A", "## B", "### q1", "x", "## C", "### q2", "", "### q3", "z", "# q4", ""]
    files = spark.createDataFrame([("/x/a/1.srt", "k1", "one"), ("/x/a/2.srt", "k2", "two"), ("/x/b/1.srt", "k3", None), ("/x/a/z.srt", "k4", "q")], "path string, sort_key string, body string")
    assert [r["line"] for r in E.transcript_lines(files).orderBy("sort_key", "sub").collect()] == ["# a", "## 1", "one", "## 2", "two", "# b", "## 1", "", "# a", "## z", "q"]


def test_links(spark):
    texts = spark.createDataFrame([(1, "p", 0, "see [[X/alpha.md|Al]] and [[beta]]\n[[none|n]] end"), (1, "q", 0, None), (1, "r", 0, ""), (1, "s", 0, "x y " * 60000 + "[[ALPHA]]")], "map_id long, node_id string, ord int, line string")
    allowed = spark.createDataFrame([(1, "Alpha", "F/Alpha.md"), (1, "Beta", "F/Beta.md")], "map_id long, slug string, canonical string")
    fixed = {r["node_id"]: r["fixed"] for r in L.repair_links(texts, allowed, ["map_id", "node_id", "ord"], "line", "fixed").collect()}
    assert fixed["p"] == "see [[F/Alpha.md|Al]] and [[F/Beta.md]]\nnone|n end" and fixed["q"] is None and fixed["r"] == ""
    assert fixed["s"] == "x y " * 60000 + "[[F/Alpha.md]]"
    names = spark.createDataFrame([(1, "alpha")], "map_id long, target string")
    assert rows(L.missing_links(texts, names), "target") == [("ALPHA",), ("beta",), ("none",)]


def test_ordinal_and_first(spark):
    frame = spark.createDataFrame([(g, i * 3) for g in "ab" for i in range(50)], "g string, pos int")
    got = O.ordinal(frame, ["g"], ["pos"], F.floor(F.col("pos") / 10), "k")
    assert all(r["k"] * 3 == r["pos"] for r in got.collect())
    dup = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, None, None)], "k int, o int, v string")
    assert rows(O.keep_first(dup, ["k"], ["o"])) == [(1, 1, "a"), (2, None, None)]


def test_mapping(spark):
    blocks = spark.createDataFrame([
        (1, 1, 0, "heading", "T", None, None, None, None, [], "h1", "# T"), (2, 1, 1, "paragraph", "one\ntwo", None, None, None, None, ["T"], "p1", "one\ntwo"), (3, 1, 2, "paragraph", "one\ntwo", None, None, None, None, ["T"], "p1", "one\ntwo"),
        (4, 1, 3, "image", None, None, "data:xyz", " A ", None, ["T", "U", "V", "W"], "i1", "![A](data:xyz)"), (5, 1, 4, "paragraph", "x", None, None, None, None, [], None, "x"), (6, 1, 5, "image", None, None, "s" * 300, None, None, [], "i2", "m"),
    ], "block_id long, map_id long, pos int, type string, text string, language string, src string, alt string, element_caption string, heading_path array<string>, element_id string, markdown string")
    marked = M.with_reason(blocks)
    assert rows(marked, "block_id", "reason") == sorted([(1, "unsupported_type"), (2, None), (3, "dup_id"), (4, None), (5, "no_id"), (6, None)], key=repr)
    shown = {r[0]: (r[1], r[2]) for r in marked.where("reason is null").select("block_id", M.caption(), M.payload()).collect()}
    assert shown[2] == ("one", "one\ntwo") and shown[4] == ("A — U / V / W", "![A]([data-url])") and shown[6][1] == "![](" + "s" * 200 + "…)"
    sizes = spark.range(1, 2000).select("id", M.batch_size(F.col("id")).alias("b")).collect()

    def rule(n):
        import math

        return n if n < 20 else max(20, min(80, math.ceil(n / min(max(6, round(n / 60)), 10))))

    assert all(r["b"] == rule(r["id"]) for r in sizes)
    assert M.batches(marked.where("reason is null")).count() == 3


def test_front_matter(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    text = spark.range(1).select(N.front_matter(F.lit("i"), F.lit("leaf"), F.lit(None).cast("string"), arr("a", "b"), arr(), arr("c"), F.lit("s" * 500), F.lit("m"), F.lit("r"))).first()[0]
    assert text.startswith("---\nid: i\ntype: leaf\nchildren:\n  - a\n  - b\nprereqs:\nsee_also:\n  - c\nsummary: " + "s" * 480 + "\nmodel: m") and text.endswith("run_id: r\n---")


def test_nested_json(spark):
    import json

    from docweave.sources.json_trees import parse_picks, parse_tree

    walked = T.walk(T.live_nodes(sample(spark)))
    refs = spark.createDataFrame([(1, "a", 2, "e2", "qa", None, "x\"y", "h"), (1, "a", 1, "e1", "code", "c", "z", "h")], "map_id long, node_id string, ord long, element_id string, type string, element_caption string, markdown string, hash string")
    texts = {}
    for r in E.mindmap_json_lines(walked, refs).orderBy("map_id", "place", "part", "ord").collect():
        texts[r["map_id"]] = texts.get(r["map_id"], "") + r["line"]
    one = json.loads(texts[1])
    assert [c["title"] for c in one["children"]] == ["Untitled", "Same"] and one["children"][1]["children"][0]["title"] == "Leaf\none"
    assert [x["element_id"] for x in one["children"][1]["content_refs"]] == ["e1", "e2"] and json.loads(texts[2])["children"] == []
    assert parse_tree('{"root": "R", "nodes": [{"title": ""}, 5, {"title": "x", "children": [{"title": "y"}], "z": 1}]}') == [(0, None, 0, 0, "R"), (1, 0, 1, 0, "Untitled"), (2, 0, 1, 1, "Untitled"), (3, 0, 1, 2, "x"), (4, 3, 2, 0, "y")]
    assert parse_tree("no") == [] and parse_tree(None) == [] and parse_picks('["a", 1, "b"]') == ["a", "b"] and parse_picks("x") == []


def test_previous(spark):
    frame = spark.createDataFrame([(i, i * i) for i in range(300)], "i int, v int")
    got = O.previous(frame.repartition(3), ["i"], ["v"]).collect()
    assert all(r["v_before"] == (None if r["i"] == 0 else (r["i"] - 1) ** 2) for r in got)


def test_place_of_ids_that_extend_each_other(spark):
    nodes = spark.createDataFrame([(1, "r", None, 0, 0, "R", "1", None), (1, "a", "r", 1, 0, "a", "1", None), (1, "a-b", "r", 1, 0, "b", "1", None), (1, "c", "a", 2, 0, "c", "1", None)], NODES)
    walked = T.walk(T.live_nodes(nodes))
    assert [r["node_id"] for r in walked.orderBy("place").collect()] == ["r", "a", "c", "a-b"]


def test_notes_hold_all_children(spark):
    n = 1100
    nodes = spark.createDataFrame([(1, "r", None, 0, 0, "Root", "1", None)] + [(1, f"c{i:04}", "r", 1, i, f"Child {i:04}", "1", None) for i in range(n)], NODES)
    walked = T.walk(T.live_nodes(nodes))
    edges = T.children(walked)
    summaries = walked.select("map_id", "node_id", "title", F.array_join("path", " / ").alias("where_"), F.concat(F.lit("about "), "node_id").alias("summary"))
    (digest,) = rows(N.child_digest(edges, summaries), "digest")
    assert digest[0].split("\n") == [f"- Child {i:04} :: [[Root / Child {i:04}]] :: about c{i:04}" for i in range(n)]
    none = walked.select("map_id", "node_id", F.array().cast("array<string>").alias("prereqs"))
    bodies = walked.select("map_id", "node_id", F.lit("# T").alias("body"))
    notes = N.assemble(T.node_types(walked), edges, T.see_also(walked), none, bodies, F.lit("Map"), "m", F.lit("run"))
    text = notes.where("node_id = 'r'").first()["markdown"]
    assert text[text.index("children:") : text.index("\nprereqs:")].split("\n")[1:] == [f"  - Map/Child{i:04}.md" for i in range(n)]


def test_note_query_takes_the_path_of_the_plans(spark, tmp_path):
    n = [(1, "r", None, 0, 0, "Root", "1", None), (1, "a", "r", 1, 0, "Apples", "1", None), (1, "b", "r", 1, 1, "Pears", "1", None), (1, "a1", "a", 2, 0, "Cox", "1", None), (1, "a2", "a", 2, 1, "Elstar", "1", None)]
    spark.createDataFrame(n, NODES).write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([(1, "my run")], "map_id long, run_name string").write.parquet(f"{tmp_path}/maps.parquet")
    told = {r["node_id"]: r["md5"] for r in Q.notes_front_matter(spark, str(tmp_path)).collect()}
    assert set(told) == {x[1] for x in n}
    backend = ExtractiveBackend()
    # A path is no page, so the links of the digest lose their brackets; those to the children are pages.
    branch = backend.branch_note("Apples", "Root / Apples", "- Cox :: Root / Apples / Cox :: Cox\n- Elstar :: Root / Apples / Elstar :: Elstar")
    branch += "\n\n## Children\n- [[MyRun/Cox.md|Cox]]\n- [[MyRun/Elstar.md|Elstar]]"
    front = "---\nid: a\ntype: hub\nparent: MyRun/Root.md\nchildren:\n  - MyRun/Cox.md\n  - MyRun/Elstar.md\nprereqs:\nsee_also:\n  - MyRun/Pears.md\n  - MyRun/Root.md\nsummary: Root / Apples\nmodel: extractive\nrun_id: run\n---"
    note = f"{front}\n{branch}\n\n{N.PREREQS_BLOCK}{N.SEE_ALSO_BLOCK}"
    assert told["a"] == hashlib.md5(note.encode()).hexdigest()


def test_walk_of_any_depth(spark):
    n = 150
    chain = spark.createDataFrame([(1, f"n{i:03}", f"n{i - 1:03}" if i else None, i, 0, f"T{i}", "1", None) for i in range(n)], NODES)
    walked = T.walk(T.live_nodes(chain))
    assert [r["node_id"] for r in walked.orderBy("place").collect()] == [f"n{i:03}" for i in range(n)]


def test_nodes_without_a_root_are_left_out(spark):
    n = [(1, "r", None, 0, 0, "R", "1", None), (1, "p", "q", 1, 0, "P", "1", None), (1, "q", "p", 1, 0, "Q", "1", None), (1, "s", "p", 2, 0, "S", "1", None), (1, "x", "ghost", 1, 0, "X", "1", None), (1, "y", "x", 2, 0, "Y", "1", None), (2, "x", "r", 1, 0, "X", "1", None)]
    assert rows(T.walk(spark.createDataFrame(n, NODES)), "map_id", "node_id", "level") == [(1, "r", 0)]
    assert T.walk(spark.createDataFrame(n, NODES).limit(0)).count() == 0


def test_walk_ends_on_a_node_below_itself(spark):
    loop = spark.createDataFrame([(1, "r", None, 0, 0, "R", "1", None), (1, "a", "r", 1, 0, "A", "1", None), (1, "b", "a", 2, 0, "B", "1", None), (1, "a", "b", 3, 0, "A", "1", None)], NODES)
    with pytest.raises(ValueError, match="ancestor"):
        T.walk(loop)


def heads(spark, rows_):
    return spark.createDataFrame(rows_, "map_id long, pos long, block_id long, heading_path array<string>, chunk_index int")


def test_heading_tree_and_more(spark):
    paths = [["A"], ["A", "x"], ["a ", "X"], ["B"], None, []] + [["A", f"t{i}"] for i in range(8)] + [["A", "t7", "deep"]]
    blocks = heads(spark, [(1, i, i, p, i % 2) for i, p in enumerate(paths)])
    tree = P.heading_tree(blocks)
    assert {(tuple(r["path"]), r["title"], r["first_pos"], r["n_blocks"]) for r in tree.collect() if len(r["path"]) < 2 or r["path"][1] == "x"} == {(("a",), "A", 0, 12), (("a", "x"), "x", 1, 2), (("b",), "B", 3, 1)}
    refined = P.refine(tree)
    assert rows(refined.where("more"), "title") == [("t5",), ("t6",), ("t7",)]
    walked = T.walk(P.as_nodes(refined)).orderBy("place").collect()
    assert [" / ".join(r["path"]) for r in walked] == ["A", "A / x", *[f"A / t{i}" for i in range(5)], "A / More", "A / More / t5", "A / More / t6", "A / More / t7", "A / More / t7 / deep", "B"]
    assert P.as_nodes(P.refine(P.heading_tree(blocks.limit(0)))).count() == 0
    # The trees of the chunks, merged by cluster and over all clusters, hold the same nodes; siblings of an earlier cluster come first.
    chunks = P.heading_tree(blocks, keys=["map_id", "chunk_index"])
    clusters = spark.createDataFrame([(1, 0, 1), (1, 1, 0)], "map_id long, chunk_index int, cluster int")
    by_cluster, merged = P.merged_trees(chunks, clusters)
    assert rows(merged, "path", "n_blocks") == rows(tree, "path", "n_blocks") and by_cluster.select("cluster").distinct().count() == 2
    ordered = P.refine(merged).where("size(path) = 2").orderBy("sibling_idx")
    assert [r["title"] for r in ordered.collect()] == ["X", "t0", "t2", "t4", "t6", "t7", "t1", "t3", "t5"]


def test_merge_in_rounds(spark):
    data = [("g", i, f'{{"title": "R", "children": [{{"title": "t{i % 3}", "children": [{{"title": "n{i}", "children": []}}]}}]}}') for i in range(7)] + [("h", 0, '{"title": "S"}')]
    frame = spark.createDataFrame(data, "g string, i int, tree string")
    merged = {r["g"]: json.loads(r["tree"]) for r in P.merge_in_rounds(frame, ["g"], "i", "tree", lambda f, keys: ask(f, keys, ["left", "right"], "merge", "tree")).collect()}
    assert {c["title"]: [x["title"] for x in c["children"]] for c in merged["g"]["children"]} == {"t0": ["n0", "n3", "n6"], "t1": ["n1", "n4"], "t2": ["n2", "n5"]} and merged["h"] == {"title": "S"}
    assert P.merge_in_rounds(frame.limit(0), ["g"], "i", "tree", lambda f, keys: f).count() == 0


def test_place_blocks(spark):
    nodes = spark.createDataFrame([(1, "a", "1", "Old kilns"), (1, "b", "2", "Kilns"), (1, "c", "3", None), (2, "d", "1", "Maps")], "map_id long, node_id string, place string, title string")
    weights = spark.createDataFrame([(1, 7, "kilns", 0.9), (1, 7, "old", 0.2), (1, 8, "maps", 0.5), (2, 9, "maps", 0.5), (2, 9, "kilns", 0.9)], "map_id long, block_id long, term string, weight double")
    assert rows(P.place_blocks(weights, nodes), "block_id", "target_node_id") == [(7, "a"), (9, "d")]


def test_refs_and_coverage(spark):
    T1 = "2024-01-0"
    refs = spark.createDataFrame([(1, 1, "p", "Paragraph", "cap", "n", T1 + "1"), (2, 1, "p", "paragraph", None, "m", T1 + "2"), (3, 1, "gone", "CODE", None, "n", T1 + "1"), (4, 1, "", "x", None, "n", T1 + "1"), (5, 1, "q", None, None, "ghost", T1 + "1"), (6, 1, "i", "image", None, "n", T1 + "1")], "ref_id long, map_id long, element_id string, type string, element_caption string, target_node_id string, created_at string")
    blocks = spark.createDataFrame([(1, 1, 0, "p", "paragraph", "old", None, None, None, "old"), (2, 1, 5, "p", "paragraph", "new", None, None, None, "new"), (3, 1, 6, "i", "image", None, None, "s.png", " alt ", "x")], "block_id long, map_id long, pos int, element_id string, type string, text string, language string, src string, alt string, markdown string")
    nodes = spark.createDataFrame([(1, "n"), (1, "m")], "map_id long, node_id string")
    # The first decision of an id holds, the last block of an id is shown, unknown nodes are dropped, unknown blocks keep their type.
    assert rows(M.insert_refs(refs, blocks, nodes), "ord", "node_id", "type", "markdown") == [(1, "n", "paragraph", "new"), (3, "n", "code", ""), (6, "n", "image", "![alt](s.png)")]
    questions = spark.createDataFrame([(1, "p", "Why?", "So."), (1, "p", "Why?", None), (1, "", "x", "y")], "map_id long, element_id string, q string, a string")
    assert rows(M.insert_refs(refs, blocks, nodes, questions=questions).where("type = 'qa'"), "ord", "q", "markdown") == [(1, "Why?", "## Why?\nSo.")]
    asked = spark.createDataFrame([(1, 1, "p"), (1, 1, "p"), (2, 1, "q"), (3, 1, "none"), (4, None, "p"), (5, 2, None)], "answer_id long, map_id long, element_id string")
    assert rows(M.coverage(asked, refs, nodes)) == [(1, 3, 2, 1, 1, 66.6667), (2, 1, 0, 1, 0, 0.0)]
    assert M.coverage(asked.limit(0), refs, nodes).count() == 0


def test_batches(spark):
    frame = spark.createDataFrame([(1, i, i) for i in range(130)] + [(2, i, i) for i in range(3)], "map_id long, pos int, block_id long")
    assert rows(M.batches(frame).groupBy("map_id").agg(F.max("batch"))) == [(1, 5), (2, 0)]
    assert rows(M.batches(frame, override=50).groupBy("map_id").agg(F.max("batch"))) == [(1, 2), (2, 0)]
