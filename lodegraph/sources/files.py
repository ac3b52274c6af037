"""Scanning source trees and keeping the graph's tables."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from .filters import SourceFilter, glob_regex, source_only

#: File name patterns by language name.
LANGUAGE_GLOBS: dict[str, list[str]] = {}
for _ext, _lang in K.LANGUAGE_BY_EXTENSION.items():
    LANGUAGE_GLOBS.setdefault(_lang, []).append(f"*{_ext}")


def scan(spark: SparkSession, root: str, repository_id: str, max_bytes: int = 10 << 20, rules: SourceFilter | None = None, include: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """(repository_id, file_path, size, modified, language, hash, content): the source files under a folder, read as bytes.

    Paths are relative to the folder. Empty files are not listed. Files over max_bytes come with a null content. Texts are decoded as UTF-8, else as
    Latin-1. include: globs on the relative path; languages: only these (unknown names contribute nothing)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = urlparse(root).path if "://" in root else os.path.abspath(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/"), "^" + "".join(c if c.isalnum() or c == "/" else "\\" + c for c in base.rstrip("/")) + "/", "")
    rules = rules or source_only()
    globs = [g for x in languages or [] for g in LANGUAGE_GLOBS.get(x.lower(), [])] + (include or [])
    df = raw.select(relative.alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    df = df.where(rules.kept("file_path")).withColumn("language", C.detect_language("file_path")).where("language is not null")
    if globs:
        df = df.where(F.col("file_path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)))
    text = F.coalesce(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return df.select(F.lit(repository_id).alias("repository_id"), "file_path", "size", "modified", "language", F.md5("content").alias("hash"), F.when(F.col("size") <= max_bytes, text).alias("content"))


def repository_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("size_bytes"))


def changed_files(old: DataFrame, new: DataFrame, keys: list[str], digest: str = "hash") -> DataFrame:
    """(keys..., change): added, removed or modified files between two scans; unchanged ones do not come out."""
    a, b = old.select(*keys, F.col(digest).alias("_old")), new.select(*keys, F.col(digest).alias("_new"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "modified")
    return both.select(*keys, change.alias("change")).where("change is not null")


def folder_state(spark: SparkSession, root: str) -> str:
    """missing, file or folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return "missing" if not fs.exists(place) else "folder" if fs.getFileStatus(place).isDirectory() else "file"


def ignore_rules(spark: SparkSession, root: str) -> list[str]:
    """The lines of the ignore file at the root of a tree; none if there is none. It is one small file by its nature."""
    if folder_state(spark, f"{root}/.gitignore") != "file":
        return []
    # Spark's readers pass over hidden files
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.gitignore")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


# tables of the graph, by repository


def _partition(spark: SparkSession, path: str, repository_id: str):
    """(path, file system) of a repository's partition."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repository_id)
    place = spark._jvm.org.apache.hadoop.fs.Path(path, f"repository_id={name}")
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_repository(spark: SparkSession, path: str, repository_id: str) -> bool:
    """Drops a repository's partition; whether there was one."""
    place, fs = _partition(spark, path, repository_id)
    return fs.delete(place, True)


class InconsistentWrite(RuntimeError):
    """Fewer or more rows were stored than were made."""


def install_repository(tables: dict[str, DataFrame], root: str, repository_id: str) -> dict[str, int]:
    """Replaces a repository in several tables under ``root`` at once: all rows are written aside and counted against what was
    made, then the partitions change places by renaming. If anything fails the tables are as before. Returns the counts."""
    spark = next(iter(tables.values())).sparkSession
    aside, counts, moved = f"{root}/_aside_{uuid.uuid4().hex}", {}, []
    try:
        for name, df in tables.items():
            counts[name] = df.count()
            df.write.partitionBy("repository_id").parquet(f"{aside}/new/{name}")
            stored = spark.read.schema(df.schema).parquet(f"{aside}/new/{name}").count()
            if stored != counts[name]:
                raise InconsistentWrite(f"{name}: {stored} rows stored of {counts[name]}")
        for name in tables:
            live, fs = _partition(spark, f"{root}/{name}", repository_id)
            new, old = (_partition(spark, f"{aside}/{part}/{name}", repository_id)[0] for part in ("new", "old"))
            fs.mkdirs(live.getParent())
            fs.mkdirs(old.getParent())
            if fs.exists(live):
                fs.rename(live, old)
            moved.append((fs, live, old))
            if fs.exists(new) and not fs.rename(new, live):
                raise InconsistentWrite(f"{name} could not be put in place")
        return counts
    except BaseException:
        for fs, live, old in reversed(moved):
            fs.delete(live, True)
            if fs.exists(old):
                fs.rename(old, live)
        raise
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(aside)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession, path: str) -> int:
    """Deletes all repositories of a table; returns how many there were."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()] if fs.exists(root) else []
    return sum(fs.delete(p, True) for p in parts)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
