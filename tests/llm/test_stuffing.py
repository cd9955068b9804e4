import random

import numpy as np

from docweave.llm import stuffing as S
from tests.conftest import rows

SUBJECTS = "the kiln|a leaf note|the choir score|the mind map|a subtitle file|the orchard ledger".split("|")
VERBS = "drains limits keeps measures records compares".split()
OBJECTS = "the average flow|a list of terms|the missing pages|its own children|the first draft".split("|")
WORDS = "study planner|index cards|mind map app|quiz generator|flashcard maker".split("|")
OFFERS = "cheap|free|best|buy|online|near me|2024|review|for students".split("|")
rnd = random.Random(4)


def prose(n):
    return " ".join(f"{rnd.choice(SUBJECTS).capitalize()} {rnd.choice(VERBS)} {rnd.choice(OBJECTS)} in small steps, and {rnd.choice(SUBJECTS)} {rnd.choice(VERBS)} {rnd.choice(OBJECTS)}." for _ in range(n))


def phrase():
    w = rnd.choice(WORDS)
    return rnd.choice((w, f"{w} {rnd.choice(OFFERS)}", f"{rnd.choice(OFFERS)} {w}", w.upper()))


STUFFED = [
    ", ".join(phrase() for _ in range(60)), " ".join(phrase() for _ in range(60)), "\n".join("- " + phrase() for _ in range(40)), ". ".join(phrase().capitalize() for _ in range(60)) + ".",
    "\n".join(f"- [{phrase()}](https://shop.x{i}.example/a?ref={i})" for i in range(20)), " ".join(f"https://www.site{i}.test/page.html" for i in range(20)),
    " ".join("#" + phrase().replace(" ", "_") for _ in range(40)), "\n".join(f"{phrase()} SKU A{i} ${i}.99 in stock" for i in range(20)),
    "\n\n".join(f"{i}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},500\n{phrase()} {phrase()}" for i in range(30)), prose(3) + "\n\n" + " / ".join(phrase() for _ in range(90)),
    "<ul>" + "".join(f'<li><a href="https://m.shop{i}.example/x">{phrase()}</a></li>' for i in range(30)) + "</ul>",
    " ".join(f"{rnd.choice(('無料', '通販', '安い'))} {rnd.choice(('学習計画', '単語カード', '問題集'))}" for _ in range(60)),
]
HONEST = [
    prose(8), "# Notes\n\n" + prose(5) + "\n\n" + ", ".join(phrase() for _ in range(6)), "# Map\n" + "\n".join(f"- [Node {i} of the kiln](Atlas/Node{i}.md)" for i in range(40)), "# Map\n" + "\n".join(f"{'  ' * (i % 3)}- The average flow {i}" for i in range(40)),
    "## Reading\n" + "\n".join(f"- [Source {i}](https://x{i}.example/a): {prose(2)}" for i in range(6)), "# Code\n\n```python\n" + "\n".join(f"print(level, {i})" for i in range(60)) + "\n```\n\n" + prose(1),
    "| a | b |\n| --- | --- |\n" + "\n".join(f"| the average flow | {i} |" for i in range(40)), '<ul><li><a href="/a.html">A</a></li><li><a href="/b.html">B</a></li></ul><p>' + prose(6) + "</p>",
    "\n".join(f"**The kiln**: {prose(1)}" for _ in range(12)), "The best flashcard maker is free for students, but the kiln drains the average flow in small steps.\n" + prose(3), "The kiln drains it.", "A",
]


def trained(texts):
    reader = S.Reader()
    counts = np.zeros((len(S.LANGUAGES), S.N**3))
    for text in texts:
        stretches, language = reader.stretches(text)
        codes = [s.code for s in stretches if s.kind == "text" and S._is_sentence(s)]
        if codes and language < len(S.LANGUAGES):
            np.add.at(counts[language], S._trigrams(codes), 1)
    return S.Model(counts)


def model():
    return trained(HONEST + [prose(200)])


def test_verdicts():
    cost, reader = model(), S.Reader()
    for text in STUFFED:
        assert S.is_stuffed(S.judge(text, cost, reader)), (S.judge(text, cost, reader), text[:80])
    for text in HONEST + ["", " \n", "```\n"]:
        assert not S.is_stuffed(S.judge(text, cost, reader)), (S.judge(text, cost, reader), text[:80])


def test_the_model_decides():
    reader = S.Reader()
    flat, none = model(), trained([])
    flat.cost[:], flat.mean[:], flat.deviation[:] = 5.0, 5.0, 0.0
    for text in STUFFED:  # a model that finds nothing surprising finds no stuffing
        assert not S.is_stuffed(S.judge(text, flat, reader)) and not S.is_stuffed(S.judge(text, none, reader))


def test_bits_by_stretch():
    m = model()
    codes = [b"\x01\x02", b"\x03", b"\x04\x05\x06"]
    one = [m.cost[0][S._trigrams([c])].sum() for c in codes]
    assert np.allclose(m.bits(codes, 0), one, rtol=1e-5) and len(m.bits([], 0)) == 0


def test_places_of_content_words():
    reader = S.Reader()
    (s,), language = reader.stretches("the old kiln near the bridge deck keeps small steps along it")
    places = [int(c) - S.C["low"] + 1 for c in S._placed([s.code]) if S.C["low"] <= c < S.C["low"] + S.PLACES]
    assert S.LANGUAGES[language] == "en" and places == [1, 2, 1, 2, 3, 4, 5]


def test_links_by_form():
    reader = S.Reader()
    for text, mark in (("see a.example/x now", "url"), ("see www.x.y", "url"), ("[a](//x.y/z)", "url"), ("[a](Atlas/A.md)", "node"), ('<a class="b" href="/x.html">t</a>', "node"), ("<a href=https://x.y>t</a>", "url"), ("version 1.2.x", None)):
        codes = b"".join(s.code for s in reader.stretches(text)[0])
        assert [k for k in ("url", "node") if S.C[k] in codes] == ([mark] if mark else []), text


def test_hostile_pages_take_linear_time():
    import time

    reader, cost = S.Reader(), model()
    for part in ("<a href=x>", "a.a.a.", "a.", "<a <a ", "[a](", "!", "a!", "<" * 7, "'", "https://", "#", "$1", "- ", "語", "a.com/", "..", "|"):
        began = time.time()
        S.judge(part * (1_000_000 // len(part)), cost, reader)
        assert time.time() - began < 4, part


def test_table(spark):
    data = [(i, t) for i, t in enumerate(STUFFED + HONEST)] + [(900, None), (901, ""), (902, " "), (0, STUFFED[0])]
    frame = spark.createDataFrame([(i, t, "c") for i, t in data + [(1000 + i, prose(20)) for i in range(20)]], "doc_id long, text string, stuffed string")
    assert {r[0] for r in rows(S.stuffed_ids(frame))} == set(range(len(STUFFED)))
    verdicts = S.stuffed_documents(frame)
    assert verdicts.count() == frame.count() and rows(verdicts.where("doc_id = 900"), "chars", "stuffed") == [(0, False)]
    assert S.stuffed_ids(frame.limit(0)).count() == 0


def test_prices_in_sentences():
    cost, reader = model(), S.Reader()
    page = "\n".join((
        "The course costs $20 and starts in May.", "A ticket for the museum is 15€, and the guide shows the old kiln.", "We paid $30 for a lamp because it is in the choir for years.",
        "The school asks £12 for each lesson, but the first draft is read without a fee.", "They have a room for $90 in the old town, and the tea is in the price.",
    ))
    found = S.judge(page, cost, reader)
    assert found["goods"] == 0 and not S.is_stuffed(found)
    goods = "\n".join(f"{phrase()} SKU A{i} ${i}.99 in stock" for i in range(20))
    assert S.judge(goods, cost, reader)["goods"] > 0.8 * len(goods.replace("\n", ""))


TOPICS = "lesson garden kitchen travel camera window mountain winter bicycle coffee laptop leather wooden silver running hiking fishing wedding office school music guitar piano drawing painting puppy kitten horse tractor engine battery solar panel floor carpet sofa chair table lamp mirror shelf ring watch phone charger cable".split()


def test_keywords_without_offers():
    cost, reader, r = model(), S.Reader(), random.Random(7)
    for words, topics in ((50, 10), (100, 20), (200, 50), (400, 50)):
        phrases = [" ".join(r.sample(TOPICS, 2)) for _ in range(topics)]
        said = [r.choice(phrases) for _ in range(words // 2)]
        for page in (", ".join(said), " ".join(said), "\n".join("- " + p for p in said)):
            assert S.is_stuffed(S.judge(page, cost, reader)), (words, topics, page[:80])
    # An outline says each of its titles once, linked or not.
    titles = ["- " + " ".join(r.sample(TOPICS, 3)) for _ in range(15)]
    for page in ("\n".join(titles), "\n".join(f"- [The slow passages](Atlas/Slow{i}.md)" for i in range(15)), "\n".join(f"- The slow lesson {i}" for i in range(60))):
        assert not S.is_stuffed(S.judge(page, cost, reader)), page[:80]
