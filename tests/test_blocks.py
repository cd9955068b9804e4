import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import ids
from docweave.functions import text as X
from docweave.functions import tokens
from docweave.operators import blocks as B
from docweave.operators import chunks as C
from tests.conftest import rows


def test_heading_paths_against_a_stack(spark, monkeypatch):
    monkeypatch.setattr(B, "SEGMENT", 7)  # many segments, so that carries matter
    rnd = random.Random(3)
    data, want = [], {}
    for doc in (1, 2, 3):
        stack, pos = [], 0
        for _ in range(120 if doc < 3 else 0):
            pos += rnd.choice((1, 1, 1, 9))
            level = rnd.choice((None, None, None, 1, 2, 3, 4, 6))
            title = f"t{pos}" if rnd.random() > 0.1 else None
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, title or ""))
            data.append((doc, pos, "heading" if level else "paragraph", level, title))
            want[doc, pos] = [t for _, t in stack]
    frame = spark.createDataFrame(data, "map_id long, pos int, type string, level int, text string")
    got = {(r["map_id"], r["pos"]): r["path"] for r in B.heading_paths(frame).collect()}
    assert got == want
    assert rows(B.heading_paths(frame.limit(0))) == []


def fold(blocks, most, over, strict=False):
    """The packing rules as a plain loop."""
    chunks, pending, held = [], [], 0
    for b, kind, t, atomic in blocks:
        if t > most and (atomic or kind == "paragraph"):
            chunks.append([b])
            continue
        if held + t > most:
            if pending:
                chunks.append([x[0] for x in pending])
            carry, held = [], 0
            for x in reversed(pending):
                if strict and held >= over:
                    break
                if not x[2]:
                    carry.insert(0, x)
                    held += x[1]
                    if held >= over:
                        break
            pending = carry
        pending.append((b, t, atomic))
        held += t
    return chunks + ([[x[0] for x in pending]] if pending else [])


def test_packing(spark):
    rnd = random.Random(5)
    for over, strict in ((0, False), (0, True), (7, False), (30, True)):
        data, want = [], {}
        for doc in range(4):
            own = []
            for pos in range(40):
                kind = rnd.choice(("paragraph", "heading", "code", "table"))
                own.append((doc * 1000 + pos, kind, rnd.choice((0, 3, 9, 20, 70)), kind in ("code", "table")))
                data.append((doc, pos, own[-1][0], kind, own[-1][2], own[-1][3], 60, over))
            want[doc] = fold(own, 60, over, strict)
        frame = spark.createDataFrame(data, "map_id long, pos int, block_id long, type string, token_count int, is_atomic boolean, max_tokens int, overlap_tokens int")
        got = {}
        for r in C.pack(frame, strict_overlap=strict).orderBy("map_id", "chunk_index", "ord").collect():
            got.setdefault(r["map_id"], {}).setdefault(r["chunk_index"], []).append(r["block_id"])
        assert {d: [c[i] for i in sorted(c)] for d, c in got.items()} == want


def test_paragraph_parts():
    text = "One two three. Four five six seven.\nEight nine ten eleven twelve thirteen fourteen " + "x " * 30
    parts = C.split_paragraph(text, 8)
    assert all(len(p.split()) <= 9 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())


def test_ids(spark):
    frame = spark.createDataFrame(
        [("paragraph", "Ein  Größenvergleich"), ("paragraph", "Ein Größen​vergleich"), ("paragraph", "日本"), ("paragraph", ""), ("paragraph", None), ("image", None)],
        "type string, text string",
    )
    got = [r[0] for r in frame.select(ids.element_id(F.col("type"), F.col("text"))).collect()]
    assert got[0] == got[1] and got[0].startswith("paragraph_ein-gro")
    assert got[2].startswith("paragraph_item_")
    words = spark.createDataFrame([("Straße",), ("Привет, мир",), ("Щука ёлка",), ("Łódź Øre",), ("Ωμέγα",), ("ΐ é Å",)], "t string")
    assert [r[0] for r in words.select(X.slug("t")).collect()] == ["strasse", "privet-mir", "shchuka-iolka", "lodz-ore", "omega", "i-e-a"]
    assert got[3] == got[4] and got[3].startswith("paragraph_paragrap_")


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="abc \n\t​ ﻿", max_size=12))
def test_id_is_stable_under_noise(spark, s):
    import hashlib

    norm = " ".join(s.replace("​", "").replace("﻿", "").split())
    got = spark.createDataFrame([(s,)], "t string").select(ids.hash8(X.normalize_for_id("t"))).first()[0]
    assert got == hashlib.sha1(norm.encode()).hexdigest()[:8]


def test_text_functions(spark):
    def one(f, value):
        return spark.createDataFrame([(value,)], "t string").select(f("t")).first()[0]

    srt = "﻿WEBVTT - x\n\n1\r\n00:00:01.000 --> 00:00:02,5 \r\nHallo\r\n\r\n2\n01:02 --> 01:03\n12 apples\n34\n"
    assert one(X.clean_subtitles, srt) == "Hallo\r\n12 apples"
    assert one(X.clean_subtitles, "") == "" and one(X.clean_subtitles, None) is None
    keys = {name: one(X.natural_key, name) for name in ("File2", "file10", "a!", "a1", "file")}
    assert keys["File2"] < keys["file10"] and keys["a1"] < keys["a!"]
    assert one(X.camel, "the ÄBC of x_1") == "TheBcOfX1" and one(X.camel, "日本") == "Untitled" and one(X.camel, None) == "Untitled"
    assert sorted(one(X.wikilinks, "[[A/B.md|x]] `[[no]]` ```\n[[no]]\n``` [[c]] [[c]]")) == ["B", "c"]
    assert one(X.sanitize_markdown, "```a\r\n```") == "\n```a\n```"
    body = "# T\n\n## Summary\nOne\ntwo.\n\n## Next\nx"
    assert one(lambda c: X.section(c, "summary"), body) == "One two."
    assert one(lambda c: X.strip_section(c, "Summary"), body) == "# T\n\n## Next\nx"
    assert one(X.token_count, "a_b c-d 日本 é!") == 7 and one(X.token_count, None) == 0


def test_packing_in_segments_agrees_with_the_whole(spark, monkeypatch):
    rnd = random.Random(9)
    data = []
    for doc in range(4):
        most, over = rnd.choice([(10, 0), (10, 3), (25, 12), (8, 8)])
        kinds = [rnd.choice(("paragraph", "heading", "code")) for _ in range(60 if doc else 7)]
        data += [(doc, i if i != 3 else None, (1 << 62) + 100 * doc + i, k, rnd.choice((None, 0, 1, 2, 3, 5, 9, 14)), k == "code", most, over) for i, k in enumerate(kinds)]
    data += [(None, 0, 999, "paragraph", 3, False, 10, 0), (9, 0, 900, "paragraph", 3, False, None, None)]
    frame = spark.createDataFrame(data, "map_id long, pos int, block_id long, type string, token_count int, is_atomic boolean, max_tokens int, overlap_tokens int")
    for strict in (False, True):
        monkeypatch.setattr(C, "SEGMENT", 4096)
        whole = rows(C.pack(frame, strict_overlap=strict))
        assert {r[1] for r in whole} == {d[2] for d in data if d[0] is not None}
        for size in (5, 16):
            monkeypatch.setattr(C, "SEGMENT", size)
            assert rows(C.pack(frame, strict_overlap=strict)) == whole, (strict, size)
    assert C.pack(frame.limit(0)).count() == 0


def test_tokenizers_of_models(spark, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    words = tokenizers.models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?")
    made = tokenizers.Tokenizer(words)
    made.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    made.save(str(tmp_path / "mine.json"))
    frame = spark.createDataFrame([("a b c d",), (None,), ("",), ("a_b c",)], "t string")
    for name in (str(tmp_path / "mine.json"), "mine"):
        monkeypatch.setenv(tokens.FOLDER, str(tmp_path))
        assert [r[0] for r in frame.select(tokens.count("t", name)).collect()] == [4, 0, 0, 2]
    assert [r[0] for r in frame.select(tokens.count("t")).collect()] == [4, 0, 0, 2]
    with pytest.raises(FileNotFoundError):
        tokens.count("t", "nowhere")
