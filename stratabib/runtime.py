"""Reading tables and cutting lineage through tables written to the shared folder.

A staged table survives the loss of any executor: it lies in the folder that
``spark.checkpoint.dir`` names, which all executors share, and later reads start from its
files instead of recomputing the plan before it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Data frames whose estimated size is under this many bytes may be broadcast or collected.
BROADCAST_BOUND = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='stratabib-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Staged:
    """A table written to the shared folder, to be read any number of times."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(df: DataFrame, name: str) -> Staged:
    """Write ``df`` to the shared folder and return the handle of the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return Staged(spark, path)


#: A table of up to this many short rows may be broadcast.
SMALL = 200_000


def small(df: DataFrame, bound: int = SMALL) -> DataFrame:
    """``df`` (short rows, read from a staged table) marked for broadcast if it is counted to have at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def spread(df: DataFrame) -> DataFrame:
    """A scan that reads far fewer partitions than there are cores, spread over them before heavy work on its rows.

    Tables of one small file would keep one core busy; a large table has partitions enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, which may not have it on their path; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    shared = shared_dir(spark)
    folder = Path(shared.removeprefix("file://").removeprefix("file:")) if shared.startswith(("file:", "/")) else Path(tempfile.mkdtemp(prefix="stratabib-"))
    os.makedirs(folder, exist_ok=True)
    archive = folder / f"stratabib-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def rows_within(df: DataFrame, bound: int) -> list | None:
    """The rows of ``df`` if there are at most ``bound``, else None; never gathers more than bound + 1."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None
