"""Contextual chunks, settings and the command line."""

import pytest

from lodegraph.config import load_config, merged
from lodegraph.operators import chunking
from lodegraph.plans import api


def test_character_splits_cover_and_end():
    for text in ("", "x", "x" * 5000, "line of text\n" * 400, "\n" * 3000, "a" * 2048, "a" * 2049):
        spans = chunking.character_splits(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(b - a <= 2048 for a, b in spans) and all(c == b - 256 for (_, b), (c, _) in zip(spans, spans[1:]))


def test_chunks_of_a_class():
    body = "class A:\n    x = 1\n" + "".join(f"    def m{i}(self):\n        return [{', '.join(map(str, range(60)))}]\n\n" for i in range(12))
    context = chunking.file_context("a.py", '"""Doc."""\nimport os\n' + body)
    out = chunking.chunk(body, context, "CLASS", "A", 3, 40, "p")
    assert len(out) > 12 and all(len(c[5]) <= 2048 and c[1] == "entity_fragment" for c in out) and "method: m0" in "".join(c[4] for c in out)
    assert {i for c in out for i in range(c[2], c[3])} == set(range(len(body)))
    assert out[0][4].startswith("File: a.py\nModule: Doc....\nImports:\n  import os\nEntity: CLASS 'A' (lines 3-40)\nParent: p\nChunk 1 of")
    assert chunking.chunk("x = 1", context, "CLASS", "A", 1, 1, None)[0][1] == "complete_entity"
    assert chunking.logical_splits("def (") == []


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"retrieval": {"max_results": 5}}')
    c = load_config(str(path), {"LODEGRAPH_RETRIEVAL_THRESHOLD": "0.5", "LODEGRAPH_PARSING_INCLUDE_TESTS": "yes", "LODEGRAPH_ROOT": "/x"})
    assert (c.root, c.retrieval.max_results, c.retrieval.threshold, c.parsing.include_tests) == ("/x", 5, 0.5, True)
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    for bad in ({"LODEGRAPH_RETRIEVAL_THRESHOLD": "2"}, {"LODEGRAPH_EMBEDDING_PROVIDER": "none"}):
        with pytest.raises(ValueError):
            load_config(None, bad)


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "m.py").write_text("def load(x):\n    return x\n")
    root = ["--root", str(tmp_path / "g")]
    assert api.main([*root, "parse-repo", str(src), "--repository-id", "r"]) == 0 and '"files": 1' in capsys.readouterr().out
    assert api.main([*root, "query", "def load(x) return x", "--repository-id", "r", "--confidence", "0", "--entity-type", "FUNCTION", "--output-format", "json"]) == 0
    assert api.main([*root, "status", "r"]) == 0 and api.main([*root, "status", "none"]) == 1 and api.main([*root, "query", " "]) == 1
    assert api.main([*root, "list"]) == 0 and api.main([*root, "delete", "r"]) == 0
