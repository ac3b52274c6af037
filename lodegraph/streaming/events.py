"""Streams: windowed counts of events with late rows, repeated deliveries, and continuous indexing of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.extract import entity_rows, extract_files, relationship_rows


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark; times without zone are taken in the session's, which is to be UTC."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, kind, n, total): tumbling windows; on a stream rows later than ``late`` are left out. The same plan serves
    a table and a stream."""
    rows = _marked(events, time, late)
    return rows.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), kind, "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", user: str = "user_id") -> DataFrame:
    rows = _marked(events, time, late)
    return rows.groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Each event once, repeated deliveries within ``late`` dropped."""
    return _marked(events, time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def latest_per_key(table: str):
    """A foreachBatch sink that keeps, for each key, the newest row of a parquet table in two alternating folders."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old, new = f"{table}/v{epoch % 2}", f"{table}/v{(epoch + 1) % 2}"
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(old)
        have = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
        every = batch.unionByName(spark.read.parquet(old)) if have else batch
        columns = [c for c in batch.columns if c not in ("event_type", "ts", "event_id")]
        best = every.groupBy("event_type").agg(F.max(F.struct("ts", "event_id", *columns)).alias("x")).select("event_type", "x.*")
        best.write.mode("overwrite").parquet(new)

    return sink


def table_stream(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_a_batch)).parquet(path)


def index_stream(files: DataFrame, entities_path: str, relationships_path: str, checkpoint: str) -> StreamingQuery:
    """Indexes files (repository_id, file_path, language, content) as they come: each batch is parsed once and appended to the
    entity and relationship tables under its own batch number, so a repeated batch replaces what it had written."""

    def sink(batch: DataFrame, epoch: int) -> None:
        extracted = extract_files(batch).persist()
        try:
            for rows, path in ((entity_rows(extracted), entities_path), (relationship_rows(extracted), relationships_path)):
                rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        finally:
            extracted.unpersist()

    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
