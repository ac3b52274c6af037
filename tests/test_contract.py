"""Tables are replaced at once or not at all; requests that cannot be served say why; what is said of a function's flow."""

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import flow, graph
from lodegraph.plans.api import CodeGraph, RequestError
from lodegraph.sources import files


def tables(spark, n, edges):
    rows = lambda k: spark.createDataFrame([("r 1", i) for i in range(k)], "repository_id string, x int")
    return {"entities": rows(n), "relationships": rows(edges)}


def test_install_replaces_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "graph")
    count = lambda name: spark.read.schema("repository_id string, x int").parquet(f"{root}/{name}").count()
    assert files.install_repository(tables(spark, 3, 2), root, "r 1") == {"entities": 3, "relationships": 2}
    other = spark.createDataFrame([("r2", 1)], "repository_id string, x int")
    files.install_repository({"entities": other}, root, "r2")
    assert count("entities") == 4 and count("relationships") == 2

    @F.udf("int")
    def fails(x):
        raise ValueError("no")

    broken = tables(spark, 9, 9)
    broken["relationships"] = broken["relationships"].withColumn("x", fails("x"))
    with pytest.raises(Exception):
        files.install_repository(broken, root, "r 1")
    assert count("entities") == 4 and count("relationships") == 2
    # a repository that lost all its relationships keeps none
    files.install_repository(tables(spark, 1, 0), root, "r 1")
    assert count("entities") == 2 and not list((tmp_path / "graph" / "relationships").glob("repository_id=*"))
    assert not list((tmp_path / "graph").glob("_aside*"))
    assert files.delete_repository(spark, f"{root}/entities", "r 1") and not files.delete_repository(spark, f"{root}/entities", "r 1")


def test_paths_that_cannot_be_indexed(spark, tmp_path):
    g = CodeGraph(spark, str(tmp_path / "graph"))
    (tmp_path / "file.py").write_text("x = 1\n")
    for path, status in (("", 400), (" ", 400), (str(tmp_path / "none"), 404), (str(tmp_path / "file.py"), 400)):
        with pytest.raises(RequestError) as e:
            g.parse_repo(path)
        assert e.value.status == status
    assert g.processing_status() == []


def test_phases_ignore_file_and_cache(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def load(key):\n    return store(key)\n\n\ndef store(key):\n    return key\n")
    (src / "notes.txt").write_text("x\n")
    (src / ".gitignore").write_text("*.txt\n")
    g, told = CodeGraph(spark, str(tmp_path / "graph")), []
    g.parse_repo(str(src), "r", progress=lambda name, share: told.append((name, share, len(g.processing_status("r")))))
    assert [t[0] for t in told] == ["scan", "extract", "embed", "store", "completed"] and told[-1][1] == 100.0 and all(t[2] == 1 for t in told)
    assert files.ignore_rules(spark, str(src)) == ["*.txt"] and g.processing_status() == []
    first = g.query("load the key", threshold=0.0)
    assert g.query_statistics()["cache_size"] == 1 and g.query("load the key", threshold=0.0).collect() == first.collect()
    assert g.counts()["nodes"] > 0 and g.clear_cache() == 1 and g.query_statistics()["cache_size"] == 0


def test_flow_of_a_function():
    source = "def f(a, b):\n    try:\n        for x in a:\n            if x:\n                y = g(x)\n                return y\n    except (KeyError, ValueError):\n        self.log(a)\n    finally:\n        close()\n    return f(b)\n"
    a = flow.analysis(source, "f")
    assert a["basic"]["branches"] == 1 and a["basic"]["loops"] == 1 and a["basic"]["returns"] == 2 and a["basic"]["parameters"] == ["a", "b"] and a["basic"]["variables_assigned"] == ["y"] and a["basic"]["return_values"] == ["f(b)", "y"]
    assert a["control_text"] == "1 conditional branches; 1 loops; multiple return paths; contains loop, conditional_branch"
    assert a["error_text"] == "1 try-except blocks; handles (KeyError, ValueError); includes finally block"
    assert a["call_patterns"]["recursive_calls"] == 1 and a["call_patterns"]["method_calls"] == 1 and a["called_names"].count("log") == 1
    assert flow.analysis("def (", "x") is None and flow.analysis(None) is None


def test_strength_updates_keep_what_was(spark):
    rels = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "id string, strength double")
    changes = spark.createDataFrame([("a", 0.9, "seen"), ("b", 1.5, "wrong")], "id string, new_strength double, reason string")
    got = {r.id: (r.strength, r.audit and (r.audit.old_strength, r.audit.reason)) for r in graph.update_strengths(rels, changes).collect()}
    assert got == {"a": (0.9, (0.5, "seen")), "b": (0.5, None), "c": (0.5, None)}


def test_edges_beyond_a_large_frontier(spark, monkeypatch):
    """A frontier too large to broadcast gives the same context."""
    rels = spark.createDataFrame([(f"n{i}", f"n{(i * 7 + 1) % 40}", "CALLS") for i in range(40)] + [("n1", "n1", "CALLS"), (None, "n2", "CALLS")], "src string, dst string, type string")
    nodes = spark.createDataFrame([(f"n{i}", 0.9) for i in range(40)], "id string, relevance double")
    seeds = spark.createDataFrame([("n0", 1.0), ("n5", 1.0)], "id string, score double")
    one = {tuple(r) for r in graph.hop_expansion(rels, nodes, seeds).collect()}
    monkeypatch.setattr(graph, "few", lambda df, rows=0: False)
    assert {tuple(r) for r in graph.hop_expansion(rels, nodes, seeds).collect()} == one and len(one) > 5
