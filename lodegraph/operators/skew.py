"""Joins whose large side may have a few very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def hot_keys(df: DataFrame, key: str, floor: int = 20_000, per_partition: int = 4) -> DataFrame:
    """Keys so frequent that hashing them would overload a task: more than 1/(per_partition * shuffle partitions) of
    all rows and more than ``floor`` rows. By that definition there are at most per_partition * shuffle partitions of
    them, whatever the data, so the result may be broadcast. Null keys are never hot."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).where((F.col("n") > floor) & (F.col("n") * (per_partition * parts) > F.col("total"))).select(key)


def hot_list(big: DataFrame, key: str) -> list:
    """The hot keys as a list, to be found once for several joins of the same rows."""
    return [r[0] for r in hot_keys(big, key).collect()]


#: Rows up to which a side is counted before it is broadcast (ids and a few numbers: about 10 MB).
FEW = 100_000


def few(df: DataFrame, rows: int = FEW) -> bool:
    """Whether df has so few rows that it may be broadcast; counts no further. df should be materialised."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has at most one row per key.

    The rows of hot keys (see hot_keys; a bounded list) meet a broadcast of the hot rows of ``small``, so no task gets all
    rows of a frequent key; all other rows meet by an ordinary shuffle join. ``how``: left, inner, left_semi or left_anti.
    hot: the hot keys where they are known. Null keys match nothing. Columns of both sides must differ but for the key."""
    hot = hot_list(big, key) if hot is None else hot
    if not hot:
        return big.join(small, key, how)
    keys = big.sparkSession.createDataFrame([(k,) for k in hot], StructType([big.schema[key]]))
    both = big.join(F.broadcast(keys.withColumn("_hot", F.lit(True))), key, "left")
    rest, met = both.where("_hot is null").drop("_hot"), both.where("_hot").drop("_hot")
    return rest.join(small, key, how).unionByName(met.join(F.broadcast(small.join(F.broadcast(keys), key, "left_semi")), key, how))
