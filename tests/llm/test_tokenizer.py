import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import tokenizer as T
from tests.conftest import rows

JSON = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(T.DEFAULT_VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ALPHABET = st.sampled_from(["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'t", "é", "é", "日本", "😀", "1", "٣", " ", "　", "\x1c", "\x85", "​", "<|endoftext|>", "!?", "\r\n", "²", "zzz", "Ω", "--", "x" * 9])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join))
def test_same_ids(reference, text):
    assert T.load().encode(text) == reference(text)


def test_long_and_repetitive(reference):
    for text in ("a" * 3000, "ab" * 2000, " " * 2000 + "x", "\n" * 500, "=" * 999, "日" * 700, "abcde" * 900, "　" * 40 + "a", "é" * 300):
        assert T.load().encode(text) == reference(text)


def test_backtracking_needs_compatibility():
    """The longest match alone is not the merge order; every encoding must be a fixpoint of the merges."""
    bpe = T.load()
    for word in (b"ithout", b"abcabc", b" unhappinesses", b"zzzzzzz", b"0000000"):
        singles = [bpe.ranks[word[i : i + 1]] for i in range(len(word))]
        assert bpe.encode_pretoken(word) == bpe._replay(singles)


def test_table(spark):
    frame = spark.createDataFrame([(1, "the cat", "x"), (2, None, "y"), (3, "", "z"), (1, "the cat", "x"), (None, "a <|endoftext|>", "w")], "doc_id long, text string, ids string")
    got = T.encode_corpus(frame)
    assert got.columns == ["doc_id", "ids"]
    values = sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=repr)
    assert (2, []) in values and (3, []) in values and sum(v[0] == 1 for v in values) == 2
    assert 50256 not in [i for _, ids in values for i in ids]
    assert rows(T.count_tokens(frame).where("doc_id = 1").distinct(), "n_tokens") == [(2,)]
    assert T.encode_corpus(frame.limit(0)).count() == 0


def test_missing_vocabulary():
    with pytest.raises(FileNotFoundError):
        T.load("/nowhere/x.tiktoken")
