"""Reading the graph's tables in normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that is trimmed from ids and enum texts.
BLANKS = " \t\n\r\f\v 　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_id(col: Column | str) -> Column:
    """An id in normal form: trimmed, lower case; blank becomes null."""
    c = F.lower(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))
    return F.when(c != "", c)


def norm_enum(col: Column | str) -> Column:
    """An enum text in normal form: trimmed, upper case; blank becomes null."""
    c = F.upper(F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS)))
    return F.when(c != "", c)
