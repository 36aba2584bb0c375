"""Vector spaces: cosine, divergence, centring, adjacent segments. Vectors are arrays of numbers in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is missing or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def js_similarity(a: Column, b: Column) -> Column:
    """1 - Jensen-Shannon divergence (base 2) of two vectors of non-negative weights; null for zero or negative ones."""
    sa, sb = (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) for v in (a, b))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(a, b, lambda x, y: part(x / sa, (x / sa + y / sb) / 2) + part(y / sb, (x / sa + y / sb) / 2))
    bad = F.exists(a, lambda x: x < 0) | F.exists(b, lambda x: x < 0) | (sa <= 0) | (sb <= 0)
    return F.when(~bad, 1 - F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2)


def centred(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centred): vectors minus the mean vector of all. The mean is one row, combined map-side."""
    at = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = at.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms")).select(F.transform("ms", lambda s: s["m"]).alias("mean"))
    return df.crossJoin(F.broadcast(mean)).select(key, F.zip_with(vector, "mean", lambda x, m: x.cast("double") - m).alias("centred"))


def adjacent(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """(group, n, next_mean, next_std, next_min, next_max, next_two): similarity of each segment to the next, and to the sum of the next two."""
    w = Window.partitionBy(group).orderBy(order)
    a = df.select(group, F.col(vector).alias("v"), F.lead(vector, 1).over(w).alias("n1"), F.lead(vector, 2).over(w).alias("n2"))
    both = F.when(F.col("n2").isNotNull(), F.zip_with("n1", "n2", lambda x, y: x.cast("double") + y.cast("double")))
    one = F.when(F.col("n1").isNotNull(), cosine(F.col("v"), F.col("n1")))
    two = F.when(F.col("n2").isNotNull(), cosine(F.col("v"), both))
    a = a.select(group, one.alias("one"), two.alias("two"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.groupBy(group).agg(F.count(F.lit(1)).alias("n"), zero(F.avg("one")).alias("next_mean"), zero(F.stddev_pop("one")).alias("next_std"), zero(F.min("one")).alias("next_min"), zero(F.max("one")).alias("next_max"), zero(F.avg("two")).alias("next_two"))


def pooled(df: DataFrame, keys: list[str], vector: str, weight: Column) -> DataFrame:
    """(keys, pooled): weighted sums of vectors, added up dimension by dimension and combined map-side."""
    at = df.select(*keys, weight.alias("w"), F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("s"))
    return at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p")).select(*keys, F.transform("p", lambda x: x["s"]).alias("pooled"))


def sif_weight(p: Column, a: float = 1e-3) -> Column:
    """Smooth inverse frequency."""
    return F.lit(a) / (F.lit(a) + p)
