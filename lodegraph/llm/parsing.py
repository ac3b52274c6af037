"""Source files that are not valid in the language of their extension, and their rates.

Files of languages whose lexer allows it (Java, Go) are cut into chunks; each is turned into a map of lexer states and a bracket
summary wherever it lies, and the maps are composed in runs of FAN, then runs of runs, by file and range (see lexstates.py). A
file that this shows to be unbalanced is decided: it is not parsed. Of the others the top-level statements, whose ends the
states and brackets tell, are parsed one by one by the language's local grammar (see grammar/). What a slash means in a script
and a quote in an f-string depends on the tokens before, so scripts and Python are parsed whole, by a grammar written here and by
Python's own parser. What parse_results says plays no part.

Null contents and files of other extensions are no case; empty Python, script and Java files are valid, an empty Go file is not.
A byte order mark at the start does no harm. Of repeated deliveries the latest counts. Null repositories or paths are values
like others (a null path has no extension). Empty tables give empty results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import norm_enum, norm_id
from .common import extension, latest, small_batches
from .grammar import LANGUAGES, problem
from .lexstates import LANGUAGES as CHUNKED
from .lexstates import chunk_map, chunks, compose, statements, verdict

#: Characters of a chunk, and how many maps are composed at once.
CHUNK, FAN = 16 << 10, 64
#: Characters that a text can have.
LONGEST = 1 << 31

_MAPS = pa.schema([("entity_id", pa.string()), ("part", pa.int32()), ("map", pa.string())])
_VERDICTS = pa.schema([("entity_id", pa.string()), ("problem", pa.string()), ("stage", pa.string())])


def _packed(maps: list[dict]) -> str:
    return json.dumps(reduce(compose, maps))


def _unpacked(text: str) -> dict:
    return {k: v if isinstance(v, str) else tuple(v) for k, v in json.loads(text).items()}


def _to_maps(size: int):
    """The map of each run of FAN chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for entity, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts = chunks(text.removeprefix("\ufeff"), size)
                rows += [(entity, n // FAN, _packed([chunk_map(c, language) for c in parts[n : n + FAN]])) for n in range(0, len(parts), FAN)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _MAPS)], schema=_MAPS)

    return run


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [_packed([_unpacked(m["map"]) for m in sorted(maps, key=lambda m: m["part"])]) for maps in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], schema=_MAPS)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [verdict(_unpacked(m)) for m in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["entity_id", "unbalanced"])


def reduced_maps(maps: DataFrame, size: int = CHUNK) -> DataFrame:
    """(entity_id, part, map) with one map for each file: runs of FAN maps are composed by (file, range) until the longest text
    there can be has one. A group holds FAN maps at most, and nothing depends on how the maps were spread."""
    runs = -(-LONGEST // (size * FAN))
    while runs > 1:
        runs = -(-runs // FAN)
        maps = maps.groupBy("entity_id", F.expr(f"int(part div {FAN})").alias("part")).agg(F.collect_list(F.struct(maps["part"].alias("part"), "map")).alias("maps")).mapInArrow(_compose, "entity_id string, part int, map string")
    return maps


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for language, text, unbalanced in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            if unbalanced is not None:
                out.append((unbalanced, "maps"))
            elif language in CHUNKED:
                out.append((by_statements(text, language), "statements"))
            else:
                out.append((problem(text, language), "whole"))
        said, stages = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(stages, pa.string())], schema=_VERDICTS)


def by_statements(text: str, language: str) -> str | None:
    """What is wrong with a balanced text, statement by statement. Where one does not stand alone, or an import comes late, the
    whole text decides (a line may begin like a statement and go on with the one before)."""
    parts = statements(text.removeprefix("\ufeff"), language)
    if len(parts) > 1 and not any(problem(p, language) for p in parts):
        return None
    return problem(text, language)


def source_files(entities: DataFrame) -> DataFrame:
    """(entity_id, at, repository_id, file_path, content, language) of FILE rows in a language that is known."""
    ext = extension("file_path")
    language = F.coalesce(*[F.when(ext == e, v) for e, v in LANGUAGES.items()])
    rows = entities.where(norm_enum("entity_type") == "FILE").where("content is not null")
    return rows.select(norm_id("id").alias("entity_id"), F.col("updated_at").alias("at"), "repository_id", "file_path", "content", language.alias("language")).where("entity_id is not null and language is not null")


def check_files(entities: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(entity_id, repository_id, file_path, language, problem, stage): every source file with what is wrong with it, or null,
    and what decided: maps, statements or whole."""
    small_batches(entities.sparkSession, 200)
    rows = latest(source_files(entities), ["entity_id"], ["at"], ["repository_id", "file_path", "language", "content"])
    maps = rows.where(F.col("language").isin(*CHUNKED)).select("entity_id", "language", "content").mapInArrow(_to_maps(chunk), "entity_id string, part int, map string")
    unbalanced = reduced_maps(maps, chunk).mapInArrow(_judge, "entity_id string, unbalanced string").where("unbalanced is not null")
    known = rows.join(unbalanced, "entity_id", "left").select("entity_id", "language", F.when(F.col("unbalanced").isNull(), F.col("content")).alias("content"), "unbalanced", "repository_id", "file_path")
    said = known.select("entity_id", "language", "content", "unbalanced").mapInArrow(_parse, "entity_id string, problem string, stage string")
    return rows.select("entity_id", "repository_id", "file_path", "language").join(said, "entity_id")


def unparsable(entities: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(repository_id, file_path, language, problem) of the files that are not valid."""
    return check_files(entities, chunk).where("problem is not null").select("repository_id", "file_path", "language", "problem").distinct()


def parse_rates(checked: DataFrame) -> DataFrame:
    """(repository_id, language, files, invalid, rate)."""
    return checked.groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("files"), F.count("problem").alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


def parse_stages(checked: DataFrame) -> DataFrame:
    """(language, stage, files, invalid): how many files, and how many of them invalid, each stage decided."""
    return checked.groupBy("language", "stage").agg(F.count(F.lit(1)).alias("files"), F.count("problem").alias("invalid"))
