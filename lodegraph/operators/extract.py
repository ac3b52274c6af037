"""Extraction: source files to entities and relationships, one pass, on the executors.

Python files are walked by the standard syntax tree; other languages yield their FILE entity. Ids are digests of repository, path,
type, name and place, so a repeated run gives the same ids. A file that does not parse yields its FILE entity and the error."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import flow

_ENTITY = pa.struct([("id", pa.string()), ("entity_type", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("start_column", pa.int32()), ("end_column", pa.int32()), ("signature", pa.string()), ("docstring", pa.string()), ("content", pa.string()), ("parent_entity_id", pa.string()), ("dependencies", pa.list_(pa.string())), ("side_effects", pa.list_(pa.string())), ("cyclomatic_complexity", pa.int32()), ("nesting_depth", pa.int32())])
_EDGE = pa.struct([("source_entity_id", pa.string()), ("target_entity_id", pa.string()), ("relationship_type", pa.string()), ("line_number", pa.int32())])
_OUT = pa.schema([("repository_id", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("success", pa.bool_()), ("error_message", pa.string()), ("entities", pa.list_(_ENTITY)), ("relationships", pa.list_(_EDGE))])
_DDL = "repository_id string, file_path string, language string, success boolean, error_message string, entities array<struct<id:string,entity_type:string,name:string,qualified_name:string,start_line:int,end_line:int,start_column:int,end_column:int,signature:string,docstring:string,content:string,parent_entity_id:string,dependencies:array<string>,side_effects:array<string>,cyclomatic_complexity:int,nesting_depth:int>>, relationships array<struct<source_entity_id:string,target_entity_id:string,relationship_type:string,line_number:int>>"


#: Lines with their ends, as the parser counts them.
_ROWS = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+$")


def _id(*parts: object) -> str:
    h = hashlib.sha256("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


class _Walker:
    def __init__(self, repo: str, path: str, text: str, methods: bool) -> None:
        self.repo, self.path, self.text, self.methods = repo, path, text, methods
        self.lines = text.splitlines()
        self.stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        self.entities: list[dict] = []
        self.edges: list[dict] = []
        #: Functions in order by each name they can be called by: their own, and the ends of the qualified one.
        self.functions: dict[str, list[dict]] = {}
        self.rows = _ROWS.findall(text)

    def source(self, node: ast.AST) -> str:
        """The text of a node; columns count bytes."""
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.rows[a].encode()[node.col_offset : node.end_col_offset].decode()
        return self.rows[a].encode()[node.col_offset :].decode() + "".join(self.rows[a + 1 : b]) + self.rows[b].encode()[: node.end_col_offset].decode()

    def callable(self, e: dict) -> None:
        parts = e["qualified_name"].split(".")
        for name in {".".join(parts[i:]) for i in range(1, len(parts))} | {e["name"]}:
            self.functions.setdefault(name, []).append(e)

    def add(self, kind: str, name: str, qualified: str, node: ast.AST | None, parent: str | None, **more: object) -> dict:
        place = (1, len(self.text.split("\n")), 0, 0) if node is None else (node.lineno, node.end_lineno, node.col_offset, node.end_col_offset)
        e = {"id": _id(self.repo, self.path, kind, name, *place), "entity_type": kind, "name": name, "qualified_name": qualified, "start_line": place[0], "end_line": place[1], "start_column": place[2], "end_column": place[3], "parent_entity_id": parent} | more
        self.entities.append(e)
        return e

    def edge(self, source: str, target: str, kind: str, line: int | None = None) -> None:
        self.edges.append({"source_entity_id": source, "target_entity_id": target, "relationship_type": kind, "line_number": line})

    def walk(self, node: ast.AST, parent: dict | None, in_class: bool) -> None:
        """Depth first, in source order."""
        up = parent["id"] if parent else None
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            source = self.source(node)
            tree = flow.tree_of(source)
            c = flow.control_flow(tree) if tree is not None else None
            signature = self.lines[node.lineno - 1].strip() if node.lineno <= len(self.lines) else ""
            e = self.add("METHOD" if in_class and self.methods else "FUNCTION", node.name, f"{self.stem}.{node.name}", node, up, signature=signature, docstring=ast.get_docstring(node), content=source, dependencies=flow.dependencies(tree) if tree is not None else [], side_effects=flow.side_effects(tree) if tree is not None else [], cyclomatic_complexity=c and c["cyclomatic_complexity"], nesting_depth=c and c["nesting_depth"])
            self.callable(e)
            if parent:
                self.edge(up, e["id"], "CONTAINS", node.lineno)
            for child in node.body:
                self.walk(child, e, False)
            return
        if isinstance(node, ast.ClassDef):
            e = self.add("CLASS", node.name, f"{self.stem}.{node.name}", node, up, docstring=ast.get_docstring(node), content=self.source(node))
            for child in ast.iter_child_nodes(node):
                self.walk(child, e, True)
            return
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            text = self.source(node)
            e = self.add("MODULE", text, f"{self.path}::{text}", node, up, content=text)
            self.edge(self.entities[0]["id"], e["id"], "IMPORTS", node.lineno)
        elif isinstance(node, ast.Call) and parent:
            called = self.source(node.func)
            hit = next((f for f in self.functions.get(called, ()) if f["id"] != up), None)
            if called and hit:
                self.edge(up, hit["id"], "CALLS", node.lineno)
        elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and parent and not isinstance(node, ast.AugAssign):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for t in targets:
                name = self.source(t)
                if name and not name.startswith("_"):
                    e = self.add("VARIABLE", name, f"{self.path}::{name}", node, up)
                    self.edge(up, e["id"], "CONTAINS")
        for child in ast.iter_child_nodes(node):
            self.walk(child, parent, in_class)


def extract_file(repo: str, path: str, language: str | None, text: str | None, methods: bool = False) -> dict:
    """One file's row: entities, relationships, and whether it parsed."""
    out = {"repository_id": repo, "file_path": path, "language": language, "success": True, "error_message": None, "entities": [], "relationships": []}
    if text is None:
        return out | {"success": False, "error_message": "no content"}
    if language is None:
        return out | {"success": False, "error_message": "language not supported"}
    w = _Walker(repo, path, text, methods)
    w.add("FILE", path.rsplit("/", 1)[-1], path, None, None)
    if language == "python":
        try:
            tree = ast.parse(text.removeprefix("﻿"))
            for node in tree.body:
                w.walk(node, None, False)
        except (SyntaxError, ValueError, RecursionError) as e:
            out |= {"success": False, "error_message": f"{type(e).__name__}: {e}"[:500]}
    return out | {"entities": w.entities, "relationships": w.edges}


def extract_files(files: DataFrame, methods_as_method: bool = False) -> DataFrame:
    """(repository_id, file_path, language, success, error_message, entities, relationships) of files (repository_id,
    file_path, language, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                rows = [extract_file(r["repository_id"] or "", r["file_path"] or "", r["language"], r["content"], methods_as_method) for r in batch.slice(at, 50).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    return spread(files.select("repository_id", "file_path", "language", "content")).mapInArrow(run, _DDL)


def entity_rows(extracted: DataFrame) -> DataFrame:
    return extracted.select("repository_id", "file_path", "language", F.explode("entities").alias("e")).select("repository_id", "file_path", "language", "e.*")


def relationship_rows(extracted: DataFrame) -> DataFrame:
    rows = extracted.select("repository_id", F.posexplode("relationships").alias("n", "r"), "file_path").select("repository_id", "file_path", "n", "r.*")
    return rows.select(F.sha2(F.concat_ws("\x1f", "repository_id", "file_path", "n", "source_entity_id", "target_entity_id"), 256).alias("id"), "repository_id", "file_path", "source_entity_id", "target_entity_id", "relationship_type", F.lit(1.0).alias("strength"), "line_number")


def parse_stats(extracted: DataFrame) -> DataFrame:
    """One row per repository: files, those that parsed, entities and relationships."""
    return extracted.groupBy("repository_id").agg(F.count(F.lit(1)).alias("files"), F.count_if("success").alias("parsed"), F.sum(F.size("entities")).alias("entities"), F.sum(F.size("relationships")).alias("relationships"))


_FLOW = ["control_flow", "data_flow", "call_patterns", "error_handling", "basic"]
_FLOW_TEXT = ["control_text", "error_text"]


def flow_rows(units: DataFrame) -> DataFrame:
    """(id, control_flow, data_flow, call_patterns, error_handling, basic, control_text, error_text) of (id, name, content): the
    first five as JSON. Contents that are null or do not parse have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, flow.analysis(text, name or "")) for i, name, text in zip(*(batch.column(c).to_pylist() for c in range(3)))]
            found = [(i, a) for i, a in found if a]
            columns = [[i for i, _ in found], *[[json.dumps(a[c], ensure_ascii=False) for _, a in found] for c in _FLOW], *[[a[c] for _, a in found] for c in _FLOW_TEXT]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["id", *_FLOW, *_FLOW_TEXT])

    return spread(units.select("id", "name", "content")).mapInArrow(run, ", ".join(f"{c} string" for c in ["id", *_FLOW, *_FLOW_TEXT]))
