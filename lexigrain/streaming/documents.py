"""Measures over a stream of documents (an extension of this library).

Each measure is row-local, so the batch plan runs unchanged in append mode and
keeps no state; only the running profile keeps one row for each property.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.operators import profiles


def read(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def measure(stream: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append-mode stream of ``of``, one of ``operators.measures``."""
    return of(stream.select("doc_id", "text"))


def running_range(stream: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(property, samples, lo, hi) so far, in complete mode; an exact median is not incremental."""
    values = profiles.long(measure(stream, of), ["doc_id"])
    return values.groupBy("property").agg(F.count("value").alias("samples"), F.min("value").alias("lo"), F.max("value").alias("hi"))
