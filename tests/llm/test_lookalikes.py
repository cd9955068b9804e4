import random
import unicodedata

from docweave.llm import lookalikes as L
from tests.conftest import rows

NORMAL = L.Normalizer(L._bigrams({"сорока": 5, "копа": 2, "нос": 5, "рот": 3, "cope": 5, "caper": 4, "case": 9}))


def same(*texts):
    forms = {NORMAL(t) for t in texts}
    assert len(forms) == 1, forms
    return forms.pop()


def test_classes():
    assert same("The reading list", "Тhе rеаdіng lіѕt", "Ｔｈｅ　ｒｅａｄｉｎｇ list", "The rea­ding​ list﻿", "Τhe readіng list") == "The reading list"
    assert same("file", "ﬁle", "fi⁠le") == "file"
    assert same("café", "café", "саfе́", "caf‍é") == "café"
    assert same("K1_2", "K１＿２") == "K1_2"
    assert same("сафари", "cафари", "сaфapи") == "сафари"  # anchored Cyrillic stays Cyrillic
    assert same("о нос", "o нос") in ("о нос", "o нос")


def test_differences_stay():
    for a, b in (("a b", "a  b"), ("a b", "a\nb"), ("A", "a"), ("é", "e"), ("l", "1"), ("O", "0"), ("x²", "x2"), ("и", "n"), ("з", "3"), ("ab", "a b"), ("①", "1")):
        assert NORMAL(a) != NORMAL(b)
    assert NORMAL(None) is None and NORMAL("") == "" and NORMAL("plain") == "plain"
    assert NORMAL("x" * 100000 + "­") == "x" * 100000


def test_form_is_stable_and_a_class_function():
    """Random disguises of one text come out equal; the form of the form is the form."""
    rnd = random.Random(7)
    back = {}
    for table in (L.CYRILLIC, L.GREEK):
        for other, latin in table.items():
            back.setdefault(latin, []).append(other)
    for text in ("Chopin coaxes seas", "Кот и рот, сорока ABC", "Αθήνα Taxi", "naïve café, x² = 4"):
        forms = set()
        for _ in range(40):
            out = []
            for c in text:
                out.append(rnd.choice([c, c, *back.get(c, [])]) if c != " " else rnd.choice("   "))
                if rnd.random() < 0.2:
                    out.append(rnd.choice("​‍­"))
            made = "".join(out)
            forms.add(NORMAL(rnd.choice((made, unicodedata.normalize("NFD", made)))))
        forms |= {NORMAL(f) for f in forms}
        assert len(forms) == 1, forms


def brute(data):
    pairs = set()
    for field in (1, 2):
        for i, a in enumerate(data):
            for b in data[i + 1 :]:
                if a[0] != b[0] and a[field] is not None and b[field] is not None and a[field] != b[field] and NORMAL(a[field]) == NORMAL(b[field]):
                    pairs.add((min(a[0], b[0]), max(a[0], b[0]), "text" if field == 1 else "markdown"))
    return pairs


def test_pairs(spark):
    data = [
        (1, "The map", "The map"), (2, "Тhe map", "The map"), (3, "The map", "x"), (3, "The map", "x"), (4, None, "Тhe map"), (5, "", ""), (6, "​", "​"), (7, "a  b", "q"), (8, "a b", "q"), (9, "The map", "The map"),
    ] + [(100 + i, "boilerplate", "boilerplate") for i in range(50)] + [(200, "bоilerplate", "boilerplate")]
    frame = spark.createDataFrame([(*d, "c") for d in data], "block_id long, text string, markdown string, look string")
    got = L.lookalike_pairs(frame)
    assert set(rows(got)) == brute(data) and got.count() == len(brute(data))
    assert L.lookalike_pairs(frame.limit(0)).count() == 0
    classes = L.lookalike_classes(frame)
    assert L.lookalike_classes(frame.limit(0)).count() == 0
    # As many links as pairs, seen from both sides; the large class of copies takes one row a member.
    assert sum(r["links"] for r in classes.collect()) == 2 * len(brute(data))
    assert classes.where("field = 'text' and block_id between 100 and 200").count() == 51 and rows(classes.where("block_id = 200"), "links") == [(50,)]
    clean = L.normalize_columns(frame, ["markdown", "text"])
    assert clean.columns == frame.columns and clean.count() == frame.count()
    assert rows(clean.where("block_id in (2, 4)"), "text") == sorted([("The map",), (None,)], key=repr)


def test_look_decides_as_the_form():
    texts = ["Тhe map", "The map", "сафари", "cафари", "ｆｕｌｌ", "full", "ﬁle", "file", "a b", "a b", "é", "é", "x²", "x2", "Ж", "", "plain", "Αθήνα", "Aθήνα"]
    for a in texts:
        for b in texts:
            assert (L.look(a) == L.look(b)) == (NORMAL(a) == NORMAL(b)), (a, b)
            assert NORMAL(L.look(a)) == NORMAL(a)
