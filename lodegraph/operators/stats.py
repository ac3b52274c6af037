"""Aggregates over the graph, repositories, query logs and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def type_counts(ents: DataFrame) -> DataFrame:
    return ents.groupBy("repository_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def relationship_counts(rels: DataFrame, undirected: bool = False) -> DataFrame:
    """Numbers by type; with undirected each relationship counts from both of its ends."""
    return rels.groupBy("repository_id", "type").agg((F.count(F.lit(1)) * (2 if undirected else 1)).alias("n"))


def graph_metrics(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """One row per repository: entities, relationships, files, average degree, density, dominant type and language."""
    kinds = ents.groupBy("repository_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    langs = ents.where("language is not null").groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("n"))
    top = lambda df, c, name: df.groupBy("repository_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(c).alias("v"))).alias("x")).select("repository_id", F.col("x.v").alias(name))
    e = kinds.groupBy("repository_id").agg(F.sum("n").alias("entities"), F.sum(F.when(F.col("entity_type") == "FILE", F.col("n")).otherwise(0)).alias("files"))
    r = rels.groupBy("repository_id").agg(F.count(F.lit(1)).alias("relationships"))
    out = e.join(r, "repository_id", "left").withColumn("relationships", F.coalesce("relationships", F.lit(0)))
    out = out.join(top(kinds, "entity_type", "dominant_type"), "repository_id", "left").join(top(langs, "language", "dominant_language"), "repository_id", "left")
    return out.withColumn("average_degree", F.round(C.average_degree("entities", "relationships"), 6)).withColumn("density", F.round(C.density("entities", "relationships"), 9))


def repository_listing(repos: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """Repositories with their numbers of entities and relationships, the newest first; both are aggregated before the joins."""
    e = ents.groupBy(F.col("repository_id").alias("id")).agg(F.count(F.lit(1)).alias("entities"))
    r = rels.groupBy(F.col("repository_id").alias("id")).agg(F.count(F.lit(1)).alias("relationships"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return repos.join(e, "id", "left").join(r, "id", "left").select("id", "name", "last_indexed", zero("entities"), zero("relationships")).orderBy(F.desc_nulls_last("last_indexed"), "id")


def query_statistics(log: DataFrame, group: str, took: str, ok: str) -> DataFrame:
    """Mean time and share of successes of a query log."""
    return log.groupBy(group).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(took), 6).alias("mean_time"), F.round(F.count_if(F.col(ok)) / F.count(F.lit(1)), 6).alias("success_rate"))


def build_metrics(indexes: DataFrame) -> DataFrame:
    """Of index builds (build_ms, bytes, entries): entries a second, bytes an entry, seconds for a thousand entries."""
    ms, n = F.greatest(F.col("build_ms"), F.lit(1)), F.greatest(F.col("entries"), F.lit(1))
    return indexes.withColumn("entries_per_second", F.col("entries") * 1000.0 / ms).withColumn("bytes_per_entry", F.col("bytes") / n).withColumn("seconds_per_thousand", F.col("build_ms") / n)


def merged_counts(a: str, b: str):
    """Two maps of counters as one."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that should be unique and are not."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def consistency(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, expected, stored, consistent): numbers that were made against numbers that are there; none is 0."""
    both = expected.join(stored, "id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return both.select("id", "expected", "stored", F.col("expected").eqNullSafe(F.col("stored")).alias("consistent"))
