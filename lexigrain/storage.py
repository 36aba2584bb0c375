"""Shared scratch tables: how every multi-pass operator cuts its lineage.

A table written here lies in the folder that ``spark.checkpoint.dir`` names, so
it outlives any executor. Only a local master without that setting (tests, the
benchmark) gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as a URI or path."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        path = tempfile.mkdtemp(prefix="lexigrain-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL[sc.applicationId] = path
        sc.setCheckpointDir(f"file://{path}/checkpoints")
    return f"file://{_LOCAL[sc.applicationId]}"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it comes from fewer splits than there are cores.

    A small file of one row group is one task otherwise, however many cores wait.
    Input of more splits than cores is left as it is, without an exchange.
    """
    if df.isStreaming or "Repartition" in (plan := df._jdf.queryExecution().optimizedPlan()).toString():
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(plan.stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return df.repartition(cores) if size < cores * split else df


class Scratch:
    """Tables of one operator run, below one folder of the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/lexigrain/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: later plans start from these files."""
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Delete tables (all of them without names) once nothing reads them."""
        jvm = self.spark.sparkContext._jvm
        for path in [self.at(n) for n in names] or [self.path]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
