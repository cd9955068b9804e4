import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import splitting as S
from tests.conftest import rows

TOKEN = regex.compile(S.WORD_PUNCT)


def check(text, most, overlap):
    pieces = S.split_text(text, most, overlap)
    assert "".join(text[p.own : p.end] for p in pieces) == text
    spans = [m.span() for m in TOKEN.finditer(text)]
    for i, p in enumerate(pieces):
        n = len(TOKEN.findall(text[p.start : p.end]))
        assert n == p.tokens <= max(1, most)
        assert p.tokens - p.overlap >= 1 or len(pieces) == 1
        before = sum(a < p.own for a, _ in spans)
        limit = max(1, most)
        assert p.overlap == (0 if i == 0 else min(max(0, overlap) if overlap < limit else limit // 2, before))
        assert len(TOKEN.findall(text[p.start : p.own])) == p.overlap
    assert (len(pieces) > 1) == (len(spans) > max(1, most))
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", ". ", ", ", "\n", "\n\n", "# ", "。", "日本", "-", "(", ")", " ", "é"]), max_size=120).map("".join), st.integers(1, 20), st.integers(0, 25))
def test_any_text(text, most, overlap):
    check(text, most, overlap)


def test_natural_boundaries():
    text = "# One\nAlpha beta gamma. Delta epsilon zeta.\n\nEta theta iota kappa. Lambda mu.\n\n# Two\nNu xi omicron pi."
    pieces = check(text, 14, 0)
    assert [text[p.own : p.end].split("\n")[0] for p in pieces][-1] == "# Two"
    assert all(text[p.end - 1] in "\n. " or p.end == len(text) for p in pieces)
    check("x" * 50000, 5, 2)
    check("a-" * 20000, 64, 16)
    check("", 5, 1)
    assert len(check("word " * 5000, 100, 100)) < 110  # an overlap that can not be kept
    assert len(check("word " * 50, 0, 3)) == 50


def test_table(spark):
    blocks = spark.createDataFrame([
        (1, "c", "a b c d e f g", True, None, 1), (1, "c", "a b c d e f g", True, None, 1), (2, "c", "a b", False, None, 2), (3, "c", None, False, None, 3), (4, "c", "", False, None, 4), (5, "none", "a b c d e f", False, None, 5), (6, None, "a b c d e f", False, None, 6), (7, "z", "a b", False, "x", 7),
    ], "block_id long, config_name string, markdown string, is_atomic boolean, deleted_at string, max_tokens int")
    limits = spark.createDataFrame([("c", 4, 1, "x"), ("z", 1, None, "y")], "config_name string, max_tokens int, overlap_tokens int, markdown string")
    assert rows(S.oversized_items(blocks, limits)) == [(1,), (7,)]
    pieces = S.split_oversized(blocks, limits)
    assert rows(pieces.where("block_id = 1").distinct(), "piece_no", "piece", "n_overlap") == [(0, "a b c d ", 0), (1, "d e f g", 1)]
    assert rows(pieces.where("block_id in (3, 4)"), "block_id", "piece", "n_tokens") == sorted([(3, None, 0), (4, "", 0)], key=repr)
    assert pieces.where("block_id in (5, 6)").count() == 2
    assert S.split_oversized(blocks.limit(0), limits).count() == 0 and S.oversized_items(blocks, limits.limit(0)).count() == 0


def test_counts_agree_in_both_engines(spark):
    texts = ["a_b c", "é", "日本 語", " x y", "1²½", "\U00010348a", "\x1cx", "a\x85b", "​", "😀😀"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["n"] for r in frame.select("t", S.word_punct_count(frame.t).alias("n")).collect()}
    assert got == {t: len(TOKEN.findall(t)) for t in texts}
