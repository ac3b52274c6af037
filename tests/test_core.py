"""Core operators against brute force on small made-up tables, with the dirt they must bear."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import columns as C
from lodegraph.operators import graph, hierarchy, orphans, retrieval, skew
from lodegraph.plans import api

ENT = "id string, entity_type string, parent_entity_id string, created_at timestamp, updated_at timestamp, src string"
REL = "id string, source_entity_id string, target_entity_id string, relationship_type string, created_at timestamp, ingested_at timestamp, ref string"
DEL = "entity_id string, deleted_at timestamp"


def t(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_orphans_direct_and_inherited(spark):
    ents = spark.createDataFrame([("a", "FILE", None, t(1), t(1), "x"), ("A ", "FILE", None, t(1), t(2), "x"), ("b", "CLASS", "gone", t(2), t(2), "x"), ("c", "METHOD", "b", t(3), t(3), None), ("d", "METHOD", "c", t(4), t(4), None), (None, None, None, None, None, None), ("e", "FILE", " ", None, None, None)], ENT)
    rels = spark.createDataFrame([("r1", "a", "zz", "CALLS", t(5), t(5), None), ("r2", " A\t", "d", "CALLS", t(5), t(5), None), ("r2", " A\t", "d", "CALLS", t(5), t(9), None), ("r3", "a", "b", "CALLS", t(1), t(1), None), ("r4", None, "  ", "CALLS", t(5), t(5), None), ("r5", "a", "a", None, None, None, None), ("r6", "e", "c", "CALLS", t(5), t(5), None)], REL)
    dels = spark.createDataFrame([("C ", t(5)), ("c", t(8)), (None, None)], DEL)
    rows = {(r.table, r.record_id, r.endpoint): (r.kind, r.reason, r.depth) for r in orphans.find_orphans(ents, rels, dels).collect()}
    assert rows == {
        ("code_entities", "b", "parent"): ("direct", "unknown", 0),
        ("code_entities", "c", "parent"): ("inherited", None, 1),
        ("code_entities", "d", "parent"): ("inherited", None, 2),
        ("relationships", "r1", "target"): ("direct", "unknown", 0),
        ("relationships", "r2", "target"): ("inherited", None, 3),
        ("relationships", "r3", "target"): ("direct", "not yet created", 0),
        ("relationships", "r5", "source"): ("direct", "not yet created", 0),
        ("relationships", "r5", "target"): ("direct", "not yet created", 0),
        ("relationships", "r6", "source"): ("direct", "not yet created", 0),
        ("relationships", "r6", "target"): ("direct", "deleted", 0),
    }


def test_orphans_of_empty_tables(spark):
    empty = orphans.find_orphans(spark.createDataFrame([], ENT), spark.createDataFrame([], REL), spark.createDataFrame([], DEL))
    assert empty.count() == 0 and orphans.orphan_report(empty).count() == 0


def brute_cycles(edges):
    nxt = {}
    for s, d in edges:
        nxt.setdefault(s, set()).add(d)
    out = set()
    for s in nxt:
        seen, todo = set(), list(nxt[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += nxt.get(x, ())
        if s in seen:
            out.add(s)
    return out


def reached(edges, start):
    seen, todo = set(), [start]
    while todo:
        at = todo.pop()
        new = {d for s, d in edges if s == at} - seen
        seen |= new
        todo += new
    return seen


@pytest.mark.parametrize("bound", [10_000, 0])
def test_cycles_like_brute_force(spark, bound):
    """bound 0 sends every component through the joins that serve components too large for one task."""
    rnd = random.Random(5)
    edges = {(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(30)} | {("x", "x"), ("p", "q"), ("q", "r"), ("r", "p"), ("r", "s")}
    edges |= {(f"b{i}", f"b{i + 1}") for i in range(4)} | {(f"b{i + 1}", f"b{i}") for i in range(4)} | {(f"o{i}", f"o{(i + 1) % 20}") for i in range(20)} | {("b3", "o1"), ("n1", "b2")}
    df = spark.createDataFrame([(s, d, "Contains ") for s, d in edges] + [(None, "x", "CONTAINS"), ("y", " ", "CONTAINS"), ("k", "l", "CALLS")], "source_entity_id string, target_entity_id string, relationship_type string")
    rows = hierarchy.find_cycles(hierarchy.contains_edges(df), max_colocated_edges=bound).collect()
    assert {r.node for r in rows} == brute_cycles(edges) and len(rows) == len({r.node for r in rows})
    ends = {}
    for r in rows:
        ends.setdefault(r.cycle, set()).add(r.node)
    assert all(c == min(nodes) for c, nodes in ends.items())
    for c, nodes in ends.items():  # one cycle's nodes reach each other, those of two cycles do not both ways
        assert all(n in reached(edges, c) and c in reached(edges, n) for n in nodes)
    assert all(d not in reached(edges, c) or c not in reached(edges, d) for c in ends for d in ends if c != d)
    assert not brute_cycles(edges - {(r.node, b) for r in rows for b in r.back_to})


def test_hierarchy_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("p", "q"), ("q", "p"), ("q", "t"), ("z", "z")] + [(f"l{i}", f"l{i + 1}") for i in range(40)], "src string, dst string")
    cycles = hierarchy.find_cycles(edges)
    paths = hierarchy.hierarchy_paths(edges, cycles)
    rows = {(r.node, tuple(r.path)): (r.root, r.depth) for r in paths.collect()}
    assert rows[("d", ("a", "b", "c", "d"))] == ("a", 3) and rows[("d", ("x", "c", "d"))] == ("x", 2)
    assert rows[("t", ("q", "t"))] == ("q", 1) and rows[("p", ("p",))] == ("p", 0) and rows[("z", ("z",))] == ("z", 0)
    assert rows[("l40", tuple(f"l{i}" for i in range(41)))] == ("l0", 40)
    down = {(r.ancestor, r.descendant): r.distance for r in hierarchy.descendants(paths).collect()}
    assert down[("a", "d")] == 3 and down[("x", "d")] == 2 and ("d", "a") not in down


def test_components(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(80)}") for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, d in edges:
        a, b = sorted((find(s), find(d)))
        parent[b] = a
    got = {r.node: r.component for r in hierarchy.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_hot_keys_take_the_broadcast_way(spark):
    big = spark.createDataFrame([("h" if i % 2 else f"k{i}", i) for i in range(4000)] + [(None, -1)], "k string, v int")
    small = spark.createDataFrame([("h", "hot"), ("k2", "two")], "k string, w string")
    old, skew.hot_keys.__defaults__ = skew.hot_keys.__defaults__, (100, 4)
    try:
        assert [r.k for r in skew.hot_keys(big, "k").collect()] == ["h"]
        out = skew.lookup_join(big, small, "k")
        assert out.count() == 4001 and out.where("w = 'hot'").count() == 2000
        assert skew.lookup_join(big, small, "k", "left_anti").count() == 4001 - 2001
    finally:
        skew.hot_keys.__defaults__ = old


def test_diversify_is_the_greedy_choice(spark):
    rnd = random.Random(1)
    rows = [(f"e{i}", f"f{rnd.randrange(4)}", round(rnd.random(), 2)) for i in range(60)]
    for k in (1, 3, 10, 20):
        taken, per = [], {}
        for i, f, s in sorted(rows, key=lambda r: (-r[2], r[0])):
            if len(taken) < k and (per.get(f, 0) < max(1, k // 5) or len(taken) < k // 2):
                taken.append(i)
                per[f] = per.get(f, 0) + 1
        # the closed form counts all rows of a group before it, as the ranks do
        order = sorted(rows, key=lambda r: (-r[2], r[0]))
        seen, closed = {}, []
        for n, (i, f, s) in enumerate(order):
            seen[f] = seen.get(f, 0) + 1
            if n < k // 2 or seen[f] <= max(1, k // 5):
                closed.append(i)
        got = [r.id for r in retrieval.diversify(spark.createDataFrame(rows, "id string, file_path string, score double"), k).orderBy("rank").collect()]
        assert got == closed[:k] == taken[:k]


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0), ([], [], 0.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all(r.got == r.want for r in df.withColumn("got", C.cosine("a", "b")).collect())


def test_shortest_path_and_distances(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("lone", "lone")], "src string, dst string")
    assert graph.shortest_path(e, "a", "d") == ["a", "x", "d"]
    assert graph.shortest_path(e, "d", "a", directed=True) is None
    assert graph.shortest_path(e, "a", "a") == ["a"]


def test_snippet_and_text(spark):
    texts = ["", None, "x" * 200, "x" * 201, "a\nb\nc\nd", "y" * 150 + "\n" + "z" * 60]
    got = [r.s for r in spark.createDataFrame([(x,) for x in texts], "t string").select(C.snippet("t").alias("s")).collect()]
    assert got == ["", "", "x" * 200, "...", "a\nb\nc\nd", "y" * 150 + "..."]
    task = [r.s for r in spark.createDataFrame([("fix the debug output",), ("hello",), (None,)], "t string").select(C.task_type("t").alias("s")).collect()]
    assert task == [api.task_of("fix the debug output"), "implement_feature", None]


def test_request_checks():
    for bad in ({"text": " "}, {"text": "x", "threshold": 2}, {"text": "x", "types": ["NOPE"]}, {"text": "x", "most": 0}, {"text": "x" * 10_001}):
        with pytest.raises(api.RequestError) as e:
            api.check_request(**bad)
        assert e.value.status == 400


def test_entities_take_the_latest_delivery(spark):
    df = spark.createDataFrame([("X ", "File", t(1), "old"), ("x", "FILE", t(2), "new"), (None, "FILE", t(3), "no id")], "id string, entity_type string, updated_at timestamp, name string").withColumn("language", F.lit("Py "))
    rows = graph.entities(df, ["entity_type", "name", "language"]).collect()
    assert [(r.id, r.entity_type, r.name, r.language) for r in rows] == [("x", "FILE", "new", "python")]
