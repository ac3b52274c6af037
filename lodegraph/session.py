"""Session helpers: building a session and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodegraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in spark.checkpoint.dir; only where that is unset
    (tests, one machine) a temporary folder stands in; a cluster without the setting is refused."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"lodegraph-{os.getpid()}"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder and drops its lineage; survives the loss of executors. With
    spark.cleaner.referenceTracking.cleanCheckpoints the files of levels that nothing refers to any more are removed."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy for each row: rows that come in fewer parts than there are cores, as a single small file does,
    are dealt out to all cores. Input of a size that matters has more parts than cores and is left as it is, without a shuffle."""
    parts, cores = df._jdf.queryExecution().toRdd().getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if parts < cores else df


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the Python workers, wherever they run; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodegraph_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp())
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    place = folder / "lodegraph.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(place))
    sc._lodegraph_shipped = True
