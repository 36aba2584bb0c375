"""Sequence operators over (group, position, value): rolling statistics, runs, rhythm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling(df: DataFrame, group: str, order: list[str], value: str, width: int = 5) -> DataFrame:
    """Centred mean and coefficient of variation; at the edges the window moves inward instead of shrinking.

    The frame reaches ``width`` - 1 rows to both sides and a slice picks the
    shifted window from it, so state is a few rows however long the group is.
    """
    w = Window.partitionBy(group).orderBy(*order)
    near = w.rowsBetween(-(width - 1), width - 1)
    i, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(group))
    a = df.withColumn("_i", i).withColumn("_n", n).withColumn("_near", F.collect_list(value).over(near))
    half = width // 2
    a = a.withColumn("_start", F.greatest(F.lit(1), F.least(F.col("_i") - half, F.col("_n") - width + 1)))
    a = a.withColumn("_from", F.col("_start") - F.greatest(F.lit(1), F.col("_i") - (width - 1)) + 1)
    a = a.withColumn("_win", F.slice("_near", F.col("_from").cast("int"), F.lit(width)))
    total = F.aggregate("_win", F.lit(0.0), lambda x, y: x + y)
    a = a.withColumn("rolling_mean", total / F.size("_win"))
    spread = F.sqrt(F.aggregate("_win", F.lit(0.0), lambda x, y: x + (y - F.col("rolling_mean")) * (y - F.col("rolling_mean"))) / F.size("_win"))
    return a.withColumn("rolling_cv", F.when(F.col("rolling_mean") == 0, F.lit(0.0)).otherwise(spread / F.col("rolling_mean"))).drop("_i", "_n", "_near", "_start", "_from", "_win")


def neighbour_median(df: DataFrame, group: str, order: list[str], value: str, reach: int = 3) -> DataFrame:
    """Median of up to ``reach`` values on both sides without the row's own; null with fewer than two."""
    w = Window.partitionBy(group).orderBy(*order)
    a = df.withColumn("_x", F.array_sort(F.concat(F.collect_list(value).over(w.rowsBetween(-reach, -1)), F.collect_list(value).over(w.rowsBetween(1, reach)))))
    n = F.size("_x")
    mid = (F.get("_x", F.floor((n - 1) / 2).cast("int")) + F.get("_x", F.floor(n / 2).cast("int"))) / 2
    return a.withColumn("neighbour_median", F.when(n >= 2, mid)).drop("_x")


def autocorrelation(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, n, lag1): population autocorrelation at lag one; 0 below three values or without spread."""
    w = Window.partitionBy(group).orderBy(*order)
    a = df.withColumn("_m", F.avg(value).over(Window.partitionBy(group))).withColumn("_next", F.lead(value).over(w))
    cross, square = F.sum((F.col(value) - F.col("_m")) * (F.col("_next") - F.col("_m"))), F.sum((F.col(value) - F.col("_m")) ** 2)
    out = a.groupBy(group).agg(F.count(value).alias("n"), cross.alias("_c"), square.alias("_s"))
    return out.select(group, "n", F.when((F.col("n") < 3) | (F.col("_s") == 0), F.lit(0.0)).otherwise(F.col("_c") / F.col("_s")).alias("lag1"))


def npvi(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, npvi): mean normalised difference of neighbours in percent, pairs of zeros left out."""
    w = Window.partitionBy(group).orderBy(*order)
    a = df.withColumn("_next", F.lead(value).over(w)).filter(F.col("_next").isNotNull() & (F.col(value) + F.col("_next") != 0))
    return a.groupBy(group).agg((F.avg(F.abs(F.col(value) - F.col("_next")) / ((F.col(value) + F.col("_next")) / 2)) * 100).alias("npvi"))


def runs(df: DataFrame, group: list[str], order: list[str], flag, least: int = 3) -> DataFrame:
    """(group, first, last, length): maximal runs of rows where ``flag`` holds, positions from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    a = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_f", F.coalesce(flag, F.lit(False)))
    a = a.withColumn("_island", F.col("_i") - F.row_number().over(Window.partitionBy(*group, "_f").orderBy("_i"))).filter("_f")
    out = a.groupBy(*group, "_island").agg(F.min("_i").cast("long").alias("first"), F.max("_i").cast("long").alias("last"), F.count(F.lit(1)).alias("length"))
    return out.filter(F.col("length") >= least).drop("_island")


def thresholds(df: DataFrame, group: str, value: str, points=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact percentiles of each group with linear interpolation: p10, p25, ..."""
    return df.groupBy(group).agg(*[F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in points])


def shuffled_null(df: DataFrame, group: str, order: list[str], value: str, replicates: int = 20, seed: int = 1729) -> DataFrame:
    """(group, observed, null_mean, null_sd, z): mean step between neighbours against shuffles of each group.

    Orders come from md5 of (seed, replicate, group, position), so every engine
    and every run shuffles alike.
    """
    w = Window.partitionBy(group).orderBy(*order)
    a = df.select(group, F.row_number().over(w).alias("_i"), F.col(value).alias("_v"))
    copies = a.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    key = F.when(F.col("_rep") == 0, F.lpad(F.col("_i").cast("string"), 12, "0")).otherwise(F.md5(F.concat_ws(":", F.lit(seed), "_rep", F.col(group).cast("string"), "_i")))
    step = F.abs(F.col("_v") - F.lead("_v").over(Window.partitionBy(group, "_rep").orderBy("_key", "_i")))
    means = copies.withColumn("_key", key).withColumn("_step", step).groupBy(group, "_rep").agg(F.coalesce(F.avg("_step"), F.lit(0.0)).alias("_m"))
    null = F.when(F.col("_rep") > 0, F.col("_m"))
    out = means.groupBy(group).agg(F.max(F.when(F.col("_rep") == 0, F.col("_m"))).alias("observed"), F.avg(null).alias("null_mean"), F.stddev_pop(null).alias("null_sd"))
    return out.withColumn("z", F.when(F.col("null_sd") < 1e-9, F.lit(0.0)).otherwise((F.col("observed") - F.col("null_mean")) / F.col("null_sd")))
