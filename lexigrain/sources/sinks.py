"""Sinks: reports, profiles, lookup tables, and a cache of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_json(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def report_text(df: DataFrame, key: str) -> DataFrame:
    """(key, line): ``name: value`` lines, floats at four decimals."""
    parts = [F.concat(F.lit(f"{c}: "), F.format_string("%.4f", F.col(c)) if t == "double" else F.col(c).cast("string")) for c, t in df.dtypes if c != key]
    return df.select(key, F.concat_ws("\n", *parts).alias("line"))


def profile_document(ranges: DataFrame) -> DataFrame:
    """One row: the profile as JSON, {"samples", "range": {property: [lo, med, hi]}}. Properties are some hundred."""
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", F.array("lo", "med", "hi")))))
    return ranges.agg(F.to_json(F.struct(F.max("samples").alias("samples"), entry.alias("range"))).alias("profile"))


def lookup_table(df: DataFrame, key: str, path: str) -> None:
    """A table sorted by key; a key that occurs twice is an error, found before anything is written."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"keys that occur twice: {[r[0] for r in twice]}")
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def request_key(*columns: str):
    """The identity of a request: SHA-256 of its canonical JSON, names in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def unanswered(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions (with ``request``) that the cache has no answer for, each once."""
    return questions.dropDuplicates(["request"]).join(cache.select("request"), "request", "left_anti")
