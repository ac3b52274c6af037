"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import norm_enum, norm_id


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most so many rows at once: whole texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def latest(df: DataFrame, keys: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the delivery that is last by the columns ``by``, nulls first, ties broken by all columns.
    Aggregated before the shuffle; no window, so a key with many deliveries is no hot group."""
    best = F.max(F.struct(*[F.col(c) for c in by], *[F.col(c) for c in columns if c not in by])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in columns])


def file_rows(entities: DataFrame) -> DataFrame:
    """The FILE rows as (entity_id, repository_id, file_path, content); repeated deliveries are not yet merged."""
    return entities.where(norm_enum("entity_type") == "FILE").select(norm_id("id").alias("entity_id"), "repository_id", "file_path", "content")


def extension(path: Column | str) -> Column:
    """The extension of a path in lower case, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
