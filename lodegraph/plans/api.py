"""The service functions: index a source tree, ask for context, look at an entity, list and state of repositories."""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import embed, extract, graph, retrieval, stats
from ..session import cut, ship
from ..sources import files as source_files
from ..sources.filters import SourceFilter


class RequestError(ValueError):
    """A request that cannot be served; status is what an HTTP front would answer."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def check_request(text: str | None, most: int | None = None, threshold: float | None = None, types: list[str] | None = None) -> None:
    if not text or not text.strip():
        raise RequestError(400, "the text is missing or blank")
    if len(text) > 10_000:
        raise RequestError(400, "the text has more than 10000 characters")
    if most is not None and not 1 <= most <= 1000:
        raise RequestError(400, "between 1 and 1000 results can be asked for")
    if threshold is not None and not 0 <= threshold <= 1:
        raise RequestError(400, "the threshold must be between 0 and 1")
    if unknown := set(types or []) - set(K.ENTITY_TYPES):
        raise RequestError(400, f"unknown entity types: {sorted(unknown)}")


def intent(text: str) -> tuple[str, list[str], list[str]]:
    """Category, suggested entity types and keywords of a request's text."""
    low, category, types = text.lower(), "general", []
    for name, words, kinds in K.INTENT_RULES:
        if any(w in low for w in words):
            category = name
            types += kinds
    return category, types, [w.lower() for w in text.split() if len(w) > 3 and w.isalnum()][:10]


def task_of(text: str) -> str:
    low = text.lower()
    padded = f" {low} "
    scores = {t: sum((p in low) + (f" {p} " in padded) for p in patterns) for t, patterns in K.TASK_PATTERNS.items()}
    best = max(scores, key=lambda t: scores[t])
    return best if scores[best] else K.DEFAULT_TASK


@dataclass
class Cache:
    """Answers by request, each for an hour; beyond ``most`` the oldest are dropped."""

    seconds: float = 3600
    most: int = 1000
    drop: int = 100
    kept: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key: str) -> object | None:
        hit = self.kept.get(key)
        return hit[1] if hit and time.time() - hit[0] < self.seconds else None

    def put(self, key: str, value: object) -> None:
        self.kept[key] = (time.time(), value)
        if len(self.kept) > self.most:
            for _ in range(self.drop):
                self.kept.popitem(last=False)


class CodeGraph:
    """The graph's tables under one folder, and what can be asked of them."""

    def __init__(self, spark: SparkSession, root: str, provider: embed.Provider | None = None) -> None:
        self.spark, self.root, self.provider, self.cache = spark, root.rstrip("/"), provider or embed.hashing_provider(), Cache()
        self.log: list[tuple[float, bool]] = []
        self.active: dict[str, dict] = {}
        ship(spark)

    def _table(self, name: str) -> DataFrame:
        """A table; one that holds nothing yet is an empty one."""
        if self._exists(f"{name}/repository_id=*"):
            return self.spark.read.parquet(f"{self.root}/{name}")
        none = self.spark.createDataFrame([], "repository_id string, file_path string, language string, content string")
        if name == "entities":
            return embed.embed_column(extract.entity_rows(extract.extract_files(none)), "content", provider=self.provider).where("false")
        if name == "relationships":
            rows = extract.relationship_rows(extract.extract_files(none))
            return rows.withColumnRenamed("source_entity_id", "src").withColumnRenamed("target_entity_id", "dst").withColumnRenamed("relationship_type", "type")
        return self.spark.createDataFrame([], {"files": "repository_id string, file_path string, size long, modified timestamp, language string, hash string", "repositories": "repository_id string, path string, name string, file_count long, size_bytes long, last_indexed timestamp"}[name])

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path))

    def parse_repo(self, path: str, repository_id: str | None = None, incremental: bool = False, languages: list[str] | None = None, exclude: list[str] | None = None, drop_dangling: bool = True, progress: Callable[[str, float], None] | None = None) -> dict:
        """Indexes a source tree: scan, extraction and embedding in one pass, then all tables of the repository are replaced at
        once: written aside, counted, and put in place, or left as they were. incremental: only files whose hash changed are
        read anew; the rest is kept. progress is told each phase by name and share, as processing_status() is."""
        if not path or not path.strip():
            raise RequestError(400, "the path is missing or blank")
        state = source_files.folder_state(self.spark, path)
        if state != "folder":
            raise RequestError(404 if state == "missing" else 400, f"{path} is {'missing' if state == 'missing' else 'no folder'}")
        repository_id = repository_id or str(uuid.uuid5(uuid.NAMESPACE_URL, path))

        def phase(name: str, share: float) -> None:
            self.active[repository_id] = {"repository_id": repository_id, "phase": name, "progress": share}
            if progress:
                progress(name, share)

        try:
            return self._parse(path, repository_id, incremental, languages, exclude, drop_dangling, phase)
        finally:
            self.active.pop(repository_id, None)

    def _parse(self, path: str, repository_id: str, incremental: bool, languages: list[str] | None, exclude: list[str] | None, drop_dangling: bool, phase: Callable[[str, float], None]) -> dict:
        phase("scan", 5.0)
        rules = SourceFilter(custom=exclude or [], include_docs=False, gitignore=source_files.ignore_rules(self.spark, path))
        found = source_files.scan(self.spark, path, repository_id, rules=rules, languages=languages).cache()
        try:
            if incremental and self._exists("files"):
                old = self._table("files").where(F.col("repository_id") == repository_id)
                changed = cut(source_files.changed_files(old, found, ["repository_id", "file_path"]))
                fresh = found.join(changed.where("change <> 'removed'"), ["repository_id", "file_path"], "left_semi")
            else:
                incremental, fresh = False, found
            phase("extract", 25.0)
            extracted = cut(extract.extract_files(fresh))
            phase("embed", 60.0)
            ents = extract.entity_rows(extracted)
            ents = embed.embed_column(ents.withColumn("_text", C.recipe_full("entity_type", "name", "signature", "docstring", "content")), "_text", provider=self.provider).drop("_text")
            rels = extract.relationship_rows(extracted).withColumnRenamed("source_entity_id", "src").withColumnRenamed("target_entity_id", "dst").withColumnRenamed("relationship_type", "type")
            if incremental:
                keep = lambda name: self._table(name).where(F.col("repository_id") == repository_id).join(changed, ["repository_id", "file_path"], "left_anti")
                ents = keep("entities").unionByName(ents, allowMissingColumns=True)
                rels = keep("relationships").unionByName(rels, allowMissingColumns=True)
            if drop_dangling:
                rels = graph.resolvable(rels, ents)
            ents, rels = cut(ents), cut(rels.dropDuplicates(["id"]))
            phase("store", 85.0)
            s = extract.parse_stats(extracted).first()
            totals = source_files.repository_stats(found).first()
            repo = self.spark.createDataFrame([(repository_id, path, path.rstrip("/").rsplit("/", 1)[-1], int(totals.file_count) if totals else 0, int(totals.size_bytes) if totals else 0)], "repository_id string, path string, name string, file_count long, size_bytes long").withColumn("last_indexed", F.current_timestamp())
            stored = source_files.install_repository({"entities": ents, "relationships": rels, "files": found.drop("content"), "repositories": repo}, self.root, repository_id)
            self.clear_cache()
            phase("completed", 100.0)
            return {"repository_id": repository_id, "status": "completed", "progress": 100.0, "files": s.files if s else 0, "parsed": s.parsed if s else 0, "entities": stored["entities"], "relationships": stored["relationships"]}
        finally:
            found.unpersist()

    def query(self, text: str, repository_id: str | None = None, most: int | None = None, threshold: float | None = None, types: list[str] | None = None, languages: list[str] | None = None, path: str | None = None, include_related: bool = True, task: str | None = None, use_cache: bool = True) -> DataFrame:
        """The context for a task: candidates by similarity among the rows allowed, multi-hop context, hybrid re-ranking,
        diversification by file and adaptation to the task. Without a repository all are searched. None means the default."""
        check_request(text, most, threshold, types)
        most, threshold = 20 if most is None else most, 0.3 if threshold is None else threshold
        key = json.dumps([repository_id, text, most, threshold, sorted(types or []), sorted(languages or []), path, include_related, task])
        if use_cache and (hit := self.cache.get(key)) is not None:
            return self.spark.createDataFrame(*hit)
        began = time.time()
        if repository_id is not None and not self.repositories().where(F.col("id") == repository_id).head(1):
            raise RequestError(404, "unknown repository")
        types = types or intent(text)[1] or None
        ents = retrieval.matching(self._table("entities"), repository_id, types, languages, path)
        vector = [float(x) for x in self.provider([text])[0]]
        scored = retrieval.score_against(ents, vector)
        seeds = retrieval.top_k(scored.where(F.col("score") >= threshold), 2 * most)
        best = seeds
        if include_related:
            rels = self._table("relationships")
            rels = rels.where(F.col("repository_id") == repository_id) if repository_id else rels
            relevance = scored.select("id", C.relevance("score").alias("relevance"))
            context = graph.hop_expansion(rels, relevance, seeds.select("id", "score"), max_nodes=20)
            extra = scored.drop("score").join(context.where("hop > 0").select("id", "score"), "id")
            best = seeds.unionByName(extra)
        ranked = retrieval.diversify(retrieval.hybrid(best, text).where(F.col("score") >= threshold), most)
        adapted = retrieval.adapt_to_task(ranked.drop("rank"), task or task_of(text)).where(F.col("task_rank") <= most).withColumnRenamed("task_rank", "rank")
        why = F.when(F.col("tier") == "primary", "semantic_similarity").otherwise("graph_traversal")
        out = retrieval.result_rows(adapted, types or [], languages or [], why)
        rows = out.collect()  # at most ``most`` rows, and so never more than check_request allows
        self.cache.put(key, (rows, out.schema))
        out = self.spark.createDataFrame(rows, out.schema)
        self.log.append((time.time() - began, True))
        return out

    def search_names(self, name: str, repository_id: str | None = None, types: list[str] | None = None, exact: bool = False) -> DataFrame:
        ents = retrieval.matching(self._table("entities"), repository_id, types)
        low = F.lower(F.col("name"))
        return ents.where(low == name.lower() if exact else low.contains(name.lower()))

    def entity_context(self, entity_id: str, depth: int = 3, types: list[str] | None = None) -> DataFrame:
        """(entity_id, depth, name, entity_type, file_path): what lies within depth relationships of an entity."""
        try:
            uuid.UUID(entity_id)
        except ValueError:
            raise RequestError(400, "no entity id") from None
        rels = self._table("relationships")
        edges = rels.where(F.col("type").isin(types)) if types else rels
        near = graph.distances(edges, self.spark.createDataFrame([(entity_id,)], "id string"), depth, directed=False)
        return near.select(F.col("node").alias("id"), "depth", "via").join(self._table("entities").select("id", "name", "entity_type", "file_path"), "id")

    def repositories(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        repos = self._table("repositories").withColumnRenamed("repository_id", "id")
        out = stats.repository_listing(repos, self._table("entities"), self._table("relationships"))
        out = out.offset(offset) if offset else out
        return out.limit(limit) if limit is not None else out

    def status(self, repository_id: str) -> dict:
        """Counts and health of a repository; coverage is the share of its files that have entities."""
        row = self.repositories().where(F.col("id") == repository_id).first()
        if row is None:
            raise RequestError(404, "unknown repository")
        ents = self._table("entities").where(F.col("repository_id") == repository_id)
        files = self._table("files").where(F.col("repository_id") == repository_id).count()
        covered = ents.select("file_path").distinct().count()
        return {"repository_id": repository_id, "entities": row.entities, "relationships": row.relationships, "files": files, "coverage": min(100.0, covered / files * 100) if files else 0.0, "last_indexed": row.last_indexed, "status": "completed"}

    def clear_cache(self) -> int:
        """Forgets all answers; returns how many there were. Every write does so."""
        n = len(self.cache.kept)
        self.cache.kept.clear()
        return n

    def processing_status(self, repository_id: str | None = None) -> list[dict]:
        """Phase and progress of the repositories that are being indexed by this object, or of one of them."""
        return [x for r, x in list(self.active.items()) if repository_id in (None, r)]

    def counts(self) -> dict:
        """Numbers of nodes and relationships of all repositories."""
        return {"nodes": self._table("entities").count(), "relationships": self._table("relationships").count()}

    def delete(self, repository_id: str) -> bool:
        self.clear_cache()
        return any([source_files.delete_repository(self.spark, f"{self.root}/{t}", repository_id) for t in ("entities", "relationships", "files", "repositories")])

    def clear(self) -> int:
        self.clear_cache()
        return max(source_files.clear(self.spark, f"{self.root}/{t}") for t in ("entities", "relationships", "files", "repositories"))

    def health(self) -> dict:
        """healthy, degraded (one table missing) or unhealthy."""
        missing = [t for t in ("entities", "relationships", "repositories") if not self._exists(t)]
        return {"status": ["healthy", "degraded", "unhealthy"][min(2, len(missing))], "missing": missing}

    def query_statistics(self) -> dict:
        n = len(self.log)
        return {"total_queries": n, "average_time": sum(t for t, _ in self.log) / n if n else 0.0, "success_rate": sum(ok for _, ok in self.log) / n if n else 0.0, "cache_size": len(self.cache.kept)}


def main(argv: list[str] | None = None) -> int:
    """Command line: parse-repo, update, query, status, list, delete, clear. Give --root the folder of the graph's tables."""
    import argparse

    from ..config import load_config

    p = argparse.ArgumentParser(prog="lodegraph")
    p.add_argument("--root")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("parse-repo", "update"):
        a = sub.add_parser(verb)
        a.add_argument("path")
        a.add_argument("--repository-id")
        a.add_argument("--incremental", action="store_true", default=verb == "update")
        a.add_argument("--languages", nargs="*")
        a.add_argument("--exclude", nargs="*")
    a = sub.add_parser("query")
    a.add_argument("text")
    a.add_argument("--repository-id")
    a.add_argument("--max-results", type=int)
    a.add_argument("--confidence", type=float)
    a.add_argument("--language", nargs="*")
    a.add_argument("--entity-type", nargs="*")
    a.add_argument("--file-filter")
    a.add_argument("--no-related", action="store_true")
    a.add_argument("--output-format", choices=["table", "json"], default="table")
    for verb in ("status", "delete"):
        sub.add_parser(verb).add_argument("repository_id")
    sub.add_parser("list")
    sub.add_parser("clear")
    o = p.parse_args(argv)
    config = load_config(o.config)
    g = CodeGraph(SparkSession.builder.getOrCreate(), o.root or config.root, embed.hashing_provider(config.embedding.dimension))
    try:
        if o.verb in ("parse-repo", "update"):
            print(json.dumps(g.parse_repo(o.path, o.repository_id, o.incremental, o.languages, o.exclude), default=str))
        elif o.verb == "query":
            most = config.retrieval.max_results if o.max_results is None else o.max_results
            least = config.retrieval.threshold if o.confidence is None else o.confidence
            out = g.query(o.text, o.repository_id, most, least, o.entity_type, o.language, o.file_filter, not o.no_related)
            if o.output_format == "json":
                print("\n".join(r.json for r in source_files.as_json(out.orderBy("rank")).collect()))
            else:
                out.orderBy("rank").show(most, truncate=80)
        elif o.verb == "list":
            g.repositories().show(1000, truncate=False)
        else:
            print(json.dumps(getattr(g, o.verb)(*([o.repository_id] if o.verb != "clear" else [])), default=str))
    except RequestError as e:
        print(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
