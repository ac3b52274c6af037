"""Operators on the call graph do the whole graph: any depth, any length of chain, all kinds of relationships."""

import random

import pyarrow as pa

from lodegraph.operators import graph
from lodegraph.plans import contract_queries, graph_queries


def functions_and_calls(spark, names, calls):
    ents = spark.createDataFrame([(n, "FUNCTION", n) for n in names], "id string, entity_type string, name string")
    rels = spark.createDataFrame([(str(i), a, b, "CALLS") for i, (a, b) in enumerate(calls)], "id string, src string, dst string, type string")
    return ents, rels


def test_call_depths_reach_every_level(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(9)]
    ents, rels = functions_and_calls(spark, [*(f"n{i}" for i in range(10)), "x", "y", "lone"], [*chain, ("n0", "n2"), ("n9", "n4"), ("x", "y"), ("y", "x"), ("n3", "gone")])
    got = {r.node: (r.depth, r.reached) for r in graph.call_depths(ents, rels).collect()}
    want = {"n0": (0, True), "n1": (1, True)} | {f"n{i}": (i - 1, True) for i in range(2, 10)} | {n: (0, False) for n in ("x", "y", "lone")}
    assert got == want


def test_call_depth_full_is_registered():
    assert "call_depth_full" in graph_queries.queries() and "call_depth_full" in graph_queries.oracle_sql()


def brute_impact(edges):
    edges = {(a, b) for a, b in edges if a != b}
    up = {}
    for a, b in edges:
        up.setdefault(b, set()).add(a)
    out = {}
    for node, callers in up.items():
        seen, todo = set(), list(callers)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        out[node] = (len(callers), len(seen) - 1, len(callers) + 0.5 * (len(seen) - 1))
    return out


def impact_of(spark, edges):
    return {r.id: (r.direct, r.transitive, r.score) for r in graph.impact(spark.createDataFrame(edges, "src string, dst string")).collect()}


def test_impact_follows_chains_of_any_length(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    assert impact_of(spark, chain)["n060"] == brute_impact(chain)["n060"] == (1, 59, 30.5)


def test_impact_with_cycles_equals_brute_force(spark):
    rnd = random.Random(5)
    for n, m in ((12, 14), (40, 60), (60, 75)):
        edges = [(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)]
        edges += [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("x", "e"), ("a", "y"), ("self", "self")]
        assert impact_of(spark, edges) == brute_impact(edges)


def test_call_impact_is_over_calls(spark, monkeypatch):
    ents, rels = functions_and_calls(spark, "abc", [("a", "b"), ("b", "c")])
    monkeypatch.setattr(graph_queries, "ents", lambda s, d: ents)
    monkeypatch.setattr(graph_queries, "rels", lambda s, d: rels)
    assert {(r.id, r.direct, r.transitive) for r in contract_queries.call_impact(spark, "").collect()} == {("b", 1, 0), ("c", 1, 1)}


def test_graph_components_are_over_all_relationships(spark, monkeypatch):
    kinds = [("a", "b", "CALLS"), ("c", "b", "CONTAINS"), ("d", "c", "IMPORTS"), ("e", "f", "INHERITS"), ("g", "g", "CALLS")]
    rels = spark.createDataFrame(kinds, "src string, dst string, type string")
    monkeypatch.setattr(graph_queries, "rels", lambda s, d: rels)
    got = {r.node: r.component for r in graph_queries.graph_components(spark, "").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g"}


def hubs(copies, wide=40):
    """Graphs apart from each other, each of callers above a ring and functions below it."""
    out = []
    for k in range(copies):
        ring = [f"{k}r{i}" for i in range(3)]
        out += [(f"{k}a{i:02}", ring[i % 3]) for i in range(wide)] + [(ring[i % 3], f"{k}z{i:02}") for i in range(wide)] + list(zip(ring, ring[1:] + ring[:1]))
    return out


def written(monkeypatch):
    """The rows of every level that operators write."""
    rows, cut = [], graph.cut

    def counted(df):
        df = cut(df)
        rows.append(df.count())
        return df

    monkeypatch.setattr(graph, "cut", counted)
    return rows


def over_calls(spark, monkeypatch, edges):
    ents, rels = functions_and_calls(spark, sorted({x for e in edges for x in e}), edges)
    monkeypatch.setattr(graph_queries, "ents", lambda s, d: ents)
    monkeypatch.setattr(graph_queries, "rels", lambda s, d: rels)


def test_call_impact_writes_no_pairs(spark, monkeypatch):
    edges = hubs(3)
    over_calls(spark, monkeypatch, edges)
    rows = written(monkeypatch)
    assert {r.id: (r.direct, r.transitive, r.score) for r in contract_queries.call_impact(spark, "").collect()} == brute_impact(edges)
    assert max(rows) <= len(edges)


def test_critical_functions_write_no_pairs(spark, monkeypatch):
    edges = hubs(3)
    over_calls(spark, monkeypatch, edges)
    rows = written(monkeypatch)
    assert {r.id for r in contract_queries.critical_functions(spark, "").collect()} == {x for x, (direct, more, _) in brute_impact(edges).items() if direct > 3 or more > 10}
    assert max(rows) <= len(edges)


def test_impact_top_writes_no_pairs(spark, monkeypatch):
    edges = hubs(3)
    over_calls(spark, monkeypatch, edges)
    rows = written(monkeypatch)
    best = sorted((-score, x) for x, (_, _, score) in brute_impact(edges).items())[:20]
    assert [(r.id, r.score, r["rank"]) for r in contract_queries.impact_top(spark, "").orderBy("rank").collect()] == [(x, -s, k) for k, (s, x) in enumerate(best, 1)]
    assert max(rows) <= len(edges)


def test_impact_is_the_same_by_task_component_and_joins(spark):
    rnd = random.Random(7)
    edges = [(f"n{rnd.randrange(60):02}", f"n{rnd.randrange(60):02}") for _ in range(70)] + hubs(1, 5) + [("x", "y"), ("y", "x"), ("self", "self")]
    want, df = brute_impact(edges), spark.createDataFrame(edges, "src string, dst string")
    for limit in (100, 20, 4):
        assert {r.id: (r.direct, r.transitive, r.score) for r in graph.impact(df, max_colocated_edges=limit).collect()} == want


def test_impact_of_a_large_ring_with_few_calls_out_of_it(spark):
    ring = [f"r{i}" for i in range(5)]
    edges = [*zip(ring, ring[1:] + ring[:1]), ("a", "r3"), ("r2", "z"), ("z", "y"), ("x", "y")]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.id: (r.direct, r.transitive, r.score) for r in graph.impact(df, max_colocated_edges=4).collect()} == brute_impact(edges)


def test_callers_counted_in_blocks(monkeypatch):
    rnd = random.Random(3)
    edges = sorted({(rnd.randrange(300), rnd.randrange(300)) for _ in range(420)} - {(i, i) for i in range(300)})
    table = pa.table({"src": [a for a, _ in edges], "dst": [b for _, b in edges], "size": [1] * len(edges)})
    want = {x: t + 1 for x, (_, t, _) in brute_impact(edges).items()}
    for bits in (1, graph.BITS_AT_ONCE):
        monkeypatch.setattr(graph, "BITS_AT_ONCE", bits)
        got = graph._count_callers(table).to_pydict()
        assert {x: n for x, n in zip(got["node"], got["callers"]) if n} == want
