"""From source files to the graph and to answers."""

import textwrap

import pytest

from lodegraph.operators import extract, flow
from lodegraph.plans.api import CodeGraph, RequestError
from lodegraph.sources.files import scan
from lodegraph.sources.filters import SourceFilter, glob_regex

CODE = textwrap.dedent('''
    import os
    from pathlib import Path, PurePath

    LIMIT = 3

    class Store:
        """Keeps records."""

        def __init__(self, root):
            self.root = root
            self._cache = {}

        async def load(self, key):
            path, name = self.root, key
            return check(path)

        class Inner:
            def deep(self):
                x: int = 1
                return deep2()

    def check(value):
        def helper(v):
            return v
        return helper(value)

    def again(n):
        return again(n - 1) or check(n)
''')


def test_entities_and_edges():
    out = extract.extract_file("r", "pkg/store.py", "python", CODE)
    kinds = [(e["entity_type"], e["name"]) for e in out["entities"]]
    assert kinds[0] == ("FILE", "store.py") and ("MODULE", "import os") in kinds
    assert [n for k, n in kinds if k == "FUNCTION"] == ["__init__", "load", "deep", "check", "helper", "again"]
    assert [n for k, n in kinds if k == "CLASS"] == ["Store", "Inner"]
    assert [n for k, n in kinds if k == "VARIABLE"] == ["self.root", "self._cache", "path, name", "x"]
    ids = {e["id"]: e["name"] for e in out["entities"]}
    calls = {(ids[r["source_entity_id"]], ids[r["target_entity_id"]]) for r in out["relationships"] if r["relationship_type"] == "CALLS"}
    assert calls == {("check", "helper"), ("again", "check")}  # not itself, not what comes later
    contains = {(ids[r["source_entity_id"]], ids[r["target_entity_id"]]) for r in out["relationships"] if r["relationship_type"] == "CONTAINS"}
    assert ("Store", "load") in contains and ("check", "helper") in contains and ("Store", "Inner") not in contains
    assert extract.extract_file("r", "pkg/store.py", "python", CODE) == out


def test_files_that_do_not_parse():
    bad = extract.extract_file("r", "a.py", "python", "def f(:\n")
    assert not bad["success"] and [e["entity_type"] for e in bad["entities"]] == ["FILE"]
    assert extract.extract_file("r", "a.py", "python", "")["success"]
    assert not extract.extract_file("r", "a.zz", None, "x")["success"]


def test_flow_measures():
    tree = flow.tree_of("def f(a):\n    for x in a:\n        if x:\n            try:\n                print(x)\n            except ValueError:\n                return 1\n            finally:\n                pass\n    b = a\n    c = b\n    c = c\n    return c\n")
    c = flow.control_flow(tree)
    assert (c["total_loops"], c["total_branches"], c["exception_handlers"], c["estimated_paths"]) == (1, 1, 2, 6)
    assert c["patterns"] == ["multiple_exit_points", "exception_handling"] and c["nesting_depth"] == 4
    assert flow.side_effects(flow.tree_of("openfile(); x.read()")) == ["file_io: openfile"]
    assert flow.longest_chain({"a": ["b"], "b": ["c"], "c": ["a"]}) == 3
    assert flow.error_handling(tree) == {"try_blocks": 1, "exception_types": ["ValueError"], "has_finally": True}
    assert flow.metrics("return a + b") is not None and flow.metrics("def (") is None


def test_globs():
    import re

    assert re.match(glob_regex("*.py"), "a/b.py") and not re.match(glob_regex("?.py"), "ab.py") and re.match(glob_regex("[!a]x"), "bx")
    assert "node_modules/" in SourceFilter().patterns() and "*.md" not in SourceFilter(include_docs=True).patterns()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for path, text in {"src/store.py": CODE, "src/util.js": "export function f() { return 1; }\n", "src/bad.py": "def (", "tests/test_x.py": "x = 1\n", "node_modules/a/b.js": "1", "src/latin.py": None, "README.md": "hi", "src/empty.py": ""}.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes("s = 'é'\n".encode("latin-1") if text is None else text.encode())
    return root


def test_scan_filters_and_decodes(spark, tree):
    rows = {r.file_path: r for r in scan(spark, str(tree), "r").collect()}
    assert sorted(rows) == ["src/bad.py", "src/latin.py", "src/store.py", "src/util.js"]
    assert rows["src/latin.py"].content == "s = 'é'\n" and rows["src/util.js"].language == "javascript"


def test_index_and_query(spark, tree, tmp_path):
    g = CodeGraph(spark, str(tmp_path / "graph"))
    assert g.health()["status"] == "unhealthy"
    done = g.parse_repo(str(tree), "r1")
    assert done["files"] == 4 and done["parsed"] == 3
    rows = g.query("function load: path name self root key, return check path", "r1", threshold=0.0, types=["CLASS", "FUNCTION"]).collect()
    assert rows and all(r.entity_type in ("CLASS", "FUNCTION") for r in rows) and [r.rank for r in rows] == sorted(r.rank for r in rows)
    assert g.query("function load: path name self root key, return check path", "r1", threshold=0.0, types=["CLASS", "FUNCTION"]) is not None and g.query_statistics()["total_queries"] == 1
    assert {r.name for r in g.search_names("LOAD", exact=True).collect()} == {"load"}
    with pytest.raises(RequestError) as e:
        g.query("x", "nope")
    assert e.value.status == 404
    (tree / "src/util.js").write_text("export function g() { return 2; }\n// more\n")
    (tree / "src/bad.py").unlink()
    again = g.parse_repo(str(tree), "r1", incremental=True)
    assert again["files"] == 1 and again["entities"] == done["entities"] - 1
    status = g.status("r1")
    assert status["files"] == 3 and status["coverage"] == 100.0
    some = g.search_names("check", exact=True).first().id
    assert {r.name for r in g.entity_context(some, 1).collect()} >= {"check", "helper", "again"}
    assert g.delete("r1") and g.repositories().count() == 0
