from datetime import datetime as D

import pytest

from docweave.operators.orphans import Reference, orphan_graph, orphan_references, orphan_report
from docweave.plans.integrity import ANSWER_TO_BLOCK, NODE_TO_NODE, REF_TO_BLOCK, REF_TO_NODE
from tests.conftest import rows

REFS = "ref_id long, map_id long, element_id string, target_node_id string, created_at timestamp, field string, reason string, _scope int"
BLOCKS = "block_id long, map_id long, element_id string, ingested_at timestamp, deleted_at timestamp, made_at int"
NODES = "map_id long, node_id string, parent_id string, created_at timestamp, deleted_at timestamp, title string"
T1, T2, T3 = D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)


def tables(spark):
    refs = spark.createDataFrame([
        (1, 1, "b", "n", T2, "x", "y", 1),  # fine
        (2, 1, "gone", "", T2, None, None, None),  # missing block; empty string is no reference
        (2, 1, "gone", "", T2, None, None, None),  # delivered twice
        (3, 1, "dead", None, T2, None, None, None),  # all rows deleted
        (4, 1, "late", "n", T2, None, None, None),  # first live row is younger
        (5, 2, "b", "n", T2, None, None, None),  # the key exists in another map only
        (6, 1, "again", "child", T2, None, None, None),  # deleted, then there again in time
        (7, None, "b", "n", T2, None, None, None),  # no map
    ], REFS)
    blocks = spark.createDataFrame([
        (1, 1, "b", T1, None, 0), (1, 1, "b", T3, None, 0), (2, 1, "dead", T1, T1, 0), (3, 1, "late", T1, T2, 0), (4, 1, "late", T3, None, 0),
        (5, 1, "again", T1, T1, 0), (6, 1, "again", T2, None, 0), (7, None, "b", T1, None, 0), (8, 1, None, T1, None, 0),
    ], BLOCKS)
    nodes = spark.createDataFrame([
        (1, "n", None, T1, None, None), (1, "child", "lost", T1, None, None), (1, "grand", "child", T1, None, None), (1, "leaf", "grand", T1, None, None), (1, "leaf", "grand", T1, None, None),
    ], NODES)
    return refs, blocks, nodes


TWO = [REF_TO_BLOCK, REF_TO_NODE]


def named(refs, blocks, nodes):
    return {"content_refs": refs, "blocks": blocks, "nodes": nodes}


def test_direct(spark):
    refs, blocks, nodes = tables(spark)
    found = orphan_references(named(refs, blocks, nodes), TWO)
    assert rows(found) == sorted([(2, "element_id", "missing"), (3, "element_id", "deleted"), (4, "element_id", "late"), (5, "element_id", "missing"), (5, "target_node_id", "missing")], key=repr)


def test_cascade_and_report(spark):
    refs, blocks, nodes = tables(spark)
    out = orphan_graph(named(refs, blocks, nodes), [NODE_TO_NODE, *TWO])
    got = {(r["table"], r["id"], r["kind"], r["level"]) for r in out.where("table = 'nodes'").collect()}
    assert got == {("nodes", "child", "direct", 0), ("nodes", "grand", "inherited", 1), ("nodes", "leaf", "inherited", 2)}
    inherited = out.where("table = 'content_refs' and kind = 'inherited'")
    assert rows(inherited, "id", "field", "level") == [("6", "target_node_id", 1)]
    assert sum(r["n"] for r in orphan_report(out).collect()) == out.count()


def test_further_children(spark):
    refs, blocks, nodes = tables(spark)
    answers = spark.createDataFrame([(1, 1, "dead", T2), (2, 1, "b", T2), (3, 1, None, T2)], "answer_id long, map_id long, element_id string, created_at timestamp")
    out = orphan_graph(named(refs, blocks, nodes) | {"answers": answers}, [NODE_TO_NODE, *TWO, ANSWER_TO_BLOCK])
    assert rows(out.where("table = 'answers'"), "id", "field", "kind", "reason") == [("1", "element_id", "direct", "deleted")]


def test_cycle_ends(spark):
    refs, blocks, _ = tables(spark)
    nodes = spark.createDataFrame([(1, "a", "b", T1, None, None), (1, "b", "a", T1, None, None), (1, "c", "nowhere", T1, None, None), (1, "d", "c", T1, None, None)], NODES)
    out = orphan_graph(named(refs, blocks, nodes), [NODE_TO_NODE, *TWO])
    assert rows(out.where("table = 'nodes'"), "id", "kind") == [("c", "direct"), ("d", "inherited")]


def test_empty(spark):
    refs, blocks, nodes = (f.limit(0) for f in tables(spark))
    assert rows(orphan_references(named(refs, blocks, nodes), TWO)) == []
    assert rows(orphan_graph(named(refs, blocks, nodes), [NODE_TO_NODE, *TWO])) == []
    some = tables(spark)[0]
    assert {r[2] for r in rows(orphan_references(named(some, blocks, nodes), TWO))} == {"missing"}


def test_cascade_has_no_last_round(spark):
    refs, blocks, _ = tables(spark)
    n = 24
    nodes = spark.createDataFrame([(1, f"n{i}", f"n{i - 1}" if i else "lost", T1, None, None) for i in range(n)], NODES)
    out = orphan_graph(named(refs, blocks, nodes), [NODE_TO_NODE, *TWO])
    assert rows(out.where("table = 'nodes'"), "id", "level") == sorted([(f"n{i}", i) for i in range(n)], key=repr)


def chain(spark):
    """Shop -> region, order -> shop and order -> clerk, line -> order: four levels, two ways into the orders."""
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "regions": one([("north",)], "region string"),
        "shops": one([("s1", "north"), ("s2", "lost"), ("s3", None)], "shop string, region string"),
        "clerks": one([("k1", "s2"), ("k2", "s1"), ("k3", "s1")], "clerk string, shop string"),
        "orders": one([(1, "s1", "k2"), (2, "s2", "k2"), (3, "s1", "k1"), (4, "gone", "k3"), (5, "s1", "nobody")], "order_id int, shop string, clerk string"),
        "lines": one([(10, 1), (11, 2), (12, 3), (13, 4), (14, 9), (15, None), (14, 9)], "line int, order_id int"),
    }


CHAIN = [
    Reference("lines", "order_id", "orders", "order_id", None, ("line",), None, None, None), Reference("orders", "shop", "shops", "shop", None, ("order_id",), None, None, None),
    Reference("orders", "clerk", "clerks", "clerk", None, ("order_id",), None, None, None), Reference("clerks", "shop", "shops", "shop", None, ("clerk",), None, None, None),
    Reference("shops", "region", "regions", "region", None, ("shop",), None, None, None),
]


def test_graph_of_several_tables(spark):
    out = orphan_graph(chain(spark), CHAIN)
    got = {(r["table"], r["id"], r["field"], r["reason"], r["level"]) for r in out.collect()}
    assert got == {
        ("shops", "s2", "region", "missing", 0), ("clerks", "k1", "shop", "parent", 1), ("orders", "2", "shop", "parent", 1), ("orders", "3", "clerk", "parent", 2),
        ("orders", "4", "shop", "missing", 0), ("orders", "5", "clerk", "missing", 0), ("lines", "11", "order_id", "parent", 2), ("lines", "12", "order_id", "parent", 3), ("lines", "13", "order_id", "parent", 1), ("lines", "14", "order_id", "missing", 0),
    }
    assert out.count() == len(got)
    assert orphan_graph({k: f.limit(0) for k, f in chain(spark).items()}, CHAIN).count() == 0


def test_two_keys_of_one_table(spark):
    with pytest.raises(ValueError, match="two different keys"):
        orphan_graph(chain(spark), [*CHAIN, Reference("lines", "line", "orders", "clerk", None, ("line",), None, None, None)])
    with pytest.raises(ValueError, match="one table"):
        orphan_references(chain(spark), CHAIN)
