import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import packing as P
from tests.conftest import rows


def exact(plan, histogram, capacity):
    got = Counter()
    for p in plan.patterns:
        assert p.count > 0 and sum(p.sizes) <= capacity
        for s in p.sizes:
            got[s] += p.count
    assert got == Counter({s: n for s, n in histogram.items() if n})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 40), max_size=20))
def test_plan_places_every_item(histogram):
    exact(P.plan(histogram, 50), histogram, 50)


def test_plan_is_tight():
    rnd = random.Random(1)
    histogram = Counter(min(2048, max(1, int(rnd.lognormvariate(5.5, 1)))) for _ in range(20000))
    plan = P.plan(dict(histogram), 2048)
    exact(plan, histogram, 2048)
    assert sum(s * n for s, n in histogram.items()) / plan.containers / 2048 > 0.98


def test_nnls_against_a_known_solution():
    x = P.nnls([(0, 1), (0, 0), (1,)], np.array([5.0, 3.0]), np.ones(2))
    a = np.array([[1, 2, 0], [1, 0, 1]])
    assert (x >= 0).all() and np.allclose(a @ x, [5, 3], atol=1e-6)
    assert P.nnls([], np.zeros(0), np.zeros(0)).size == 0


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "NUMBERED_AT_ONCE", 40)  # several salts
    rnd = random.Random(2)
    sizes = [rnd.choice((0, None, -3, 7, 7, 7, 31, 64, 99, 100, 101, 250, 999)) for _ in range(400)]
    frame = spark.createDataFrame([(i // 2, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, size string")  # ids repeat
    packed = P.pack(frame, "doc_id", "n_tokens", 100).collect()
    load, whole = Counter(), Counter()
    for r in packed:
        load[r["container_id"]] += r["size"]
        whole[r["doc_id"]] += r["size"]
        assert r["size"] <= 100 and (r["n_pieces"] == 1 or r["piece_no"] == r["n_pieces"] - 1 or r["size"] == 100)
    want = Counter()
    for i, s in enumerate(sizes):
        want[i // 2] += max(s or 0, 0)
    assert whole == want and max(load.values()) <= 100
    total = sum(want.values())
    assert len([c for c, v in load.items() if v]) <= total / 100 * 1.1 + 2
    report = P.container_report(P.pack(frame, "doc_id", "n_tokens", 100), 100).first()
    assert report["tokens"] == total and report["fullest"] <= 100
    empty = P.pack(frame.limit(0), "doc_id", "n_tokens", 100)
    assert empty.count() == 0 and P.container_report(empty).first()["containers"] == 0
    assert rows(P.pack(frame.where("n_tokens = 0").limit(1), "doc_id", "n_tokens", 100), "size", "container_id") == [(0, 0)]


def test_documents(spark):
    frame = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (4, "word " * 50)], "doc_id long, text string")
    got = P.pack_documents(frame, 16)
    assert {r[0] for r in rows(got, "doc_id")} == {1, 2, 3, 4} and got.where("doc_id = 4").count() == 4


def test_least_squares_beats_the_greedy_packer():
    histogram = {51: 600, 27: 600, 26: 600, 23: 1200}  # 51 + 26 + 23 and 27 + 27 + 23 + 23 fill 100
    greedy = P.Plan(100)
    P._fill(greedy, dict(histogram))
    made = P.plan(histogram, 100)
    exact(made, histogram, 100)
    assert made.containers < 0.9 * greedy.containers and made.planned_items >= 1800


def test_many_slots_are_not_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame([(i, 1 + i % 37) for i in range(300)], "doc_id long, n_tokens long")
    hinted = rows(P.pack(frame, "doc_id", "n_tokens", 40), "doc_id", "container_id")
    monkeypatch.setattr(P, "BROADCAST_SLOTS", 0)
    plain = P.pack(frame, "doc_id", "n_tokens", 40)
    assert rows(plain, "doc_id", "container_id") == hinted and "hint" not in plain._jdf.queryExecution().analyzed().toString().lower()


def test_plan_report(spark):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate([51, 26, 23] * 20 + [0, None])], "doc_id long, n_tokens long")
    ways = {w[0]: w[1:] for w in P.plan_report(frame, "n_tokens", 100)}
    assert all(n >= least == 20 for n, least, _, _ in ways.values()) and ways["greedy"][2] == 0 and max(share for _, _, _, share in ways.values()) == 1.0
    assert {type(v) for w in ways.values() for v in w} == {int, float}
    assert {w[1] for w in P.plan_report(frame.limit(0), "n_tokens", 100)} == {0}
