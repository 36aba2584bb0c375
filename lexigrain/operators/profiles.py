"""Profiles of measured properties, values outside of them, and agreement between two sets of values."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.storage import Scratch

#: Rows of a group that one task holds, as two numbers each; replicates that it draws from them.
GROUP, BLOCK = 1_000_000, 10


def long(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, property, value): one row for each numeric property."""
    values = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(keys, values, "property", "value")


def profile(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, property, samples, lo, med, hi): exact range and median at four decimals."""
    own = values.filter("value is not null").groupBy(*by, "property")
    return own.agg(F.count("value").alias("samples"), *[F.round(F.round(f("value"), 8), 4).alias(n) for f, n in ((F.min, "lo"), (F.median, "med"), (F.max, "hi"))])


def compare(values: DataFrame, ranges: DataFrame, on: list[str], slack: float = 0.15) -> DataFrame:
    """Values outside their range widened by ``slack`` of its span, with side and distance in spans."""
    span = F.greatest(F.col("hi") - F.col("lo"), 0.25 * F.abs("med"), F.lit(1e-9))
    a = values.join(ranges, [*on, "property"]).withColumn("span", span)
    out = a.filter((F.col("value") < F.col("lo") - slack * F.col("span")) | (F.col("value") > F.col("hi") + slack * F.col("span")))
    below = F.col("value") < F.col("lo")
    gap = F.when(below, F.col("lo") - F.col("value")).otherwise(F.col("value") - F.col("hi")) / F.col("span")
    return out.withColumn("side", F.when(below, "below").otherwise("above")).withColumn("spans", gap).drop("span", "samples")


def strongest(flags: DataFrame, key: list[str], family: Column, most: int = 2) -> DataFrame:
    """The ``most`` farthest flags of each family of properties."""
    w = Window.partitionBy(*key, "family").orderBy(F.desc("spans"), "property")
    return flags.withColumn("family", family).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def _average_rank(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho, status): rank correlation with average ranks for ties."""
    ranked = pairs.filter(f"{x} is not null and {y} is not null").withColumn("_x", _average_rank(x, by)).withColumn("_y", _average_rank(y, by))
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.round(x, 9)).alias("kinds"), F.covar_pop("_x", "_y").alias("c"), F.stddev_pop("_x").alias("sx"), F.stddev_pop("_y").alias("sy"))
    rho = F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).otherwise(0.0)
    status = F.when(F.col("n") < 10, "too few").when(F.col("kinds") < 8, "flat").when(rho >= 0.8, "pass").otherwise("fail")
    return out.select(*by, "n", rho.alias("rho"), status.alias("status"))


def bootstrap(pairs: DataFrame, by: list[str], key: str, x: str, y: str, replicates: int = 400, seed: int = 11, quantile: float = 0.05) -> DataFrame:
    """(by, lower): a low quantile of the correlation over resamples with replacement.

    Draw k of a replicate picks the row whose place an md5 names; the same on
    every engine. Rows of one key are in the order of x and y. A replicate is how
    often each row is drawn, so a group's rows move once for ``BLOCK`` replicates,
    as the places of their x and y among its values. Groups of more than ``GROUP``
    rows are drawn by joins.
    """
    spark, kept = pairs.sparkSession, pairs.select(*by, key, x, y).filter(" and ".join(f"`{c}` is not null" for c in (x, y, *by)))
    kept = Scratch(spark, "bootstrap").table(kept, "pairs")
    sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) > GROUP:
        rho = _drawn_joined(kept, by, key, x, y, replicates, seed)
    else:
        rho = _drawn(kept, by, key, x, y, replicates, seed)
    return rho.groupBy(*by).agg(F.percentile("rho", F.lit(quantile)).alias("lower"))


def _places(values: pa.ChunkedArray) -> np.ndarray:
    """The place of each value among the different ones, in order."""
    return pc.rank(values, tiebreaker="dense").to_numpy().astype(np.int32) - 1


def resampled(a: np.ndarray, b: np.ndarray, times: np.ndarray) -> float:
    """Rank correlation of places ``a`` and ``b``, each row taken ``times`` over."""
    n = times.sum()
    ranks = []
    for places in (a, b):
        own = np.bincount(places, times)
        ranks.append((np.cumsum(own) - own + (own + 1) / 2 - (n + 1) / 2)[places])
    sx, sy = (np.sqrt((times * r * r).sum() / n) for r in ranks)
    return float((times * ranks[0] * ranks[1]).sum() / n / (sx * sy)) if sx > 0 and sy > 0 else 0.0


def _drawn(pairs: DataFrame, by: list[str], key: str, x: str, y: str, replicates: int, seed: int) -> DataFrame:
    """(by, rho): the correlation of each replicate."""
    spark, own = pairs.sparkSession, [pairs.schema[c] for c in by]

    def pack(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [(key, "ascending"), (x, "ascending"), (y, "ascending")], null_placement="at_start"))
        places = [pa.array([_places(group[c]).tobytes()], pa.binary()) for c in (x, y)]
        return pa.Table.from_arrays([*(group[c].slice(0, 1) for c in by), *places], [*by, "_a", "_b"])

    packed = pairs.groupBy(*by).applyInArrow(pack, T.StructType([*own, T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())]))
    dealt = packed.withColumn("_first", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(BLOCK))))
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a, b = (np.frombuffer(batch.column(name)[i].as_py(), np.int32) for name in ("_a", "_b"))
                first, names, rho = batch.column("_first")[i].as_py(), [b"%d" % k for k in range(len(a))], []
                for rep in range(first, min(first + BLOCK, replicates + 1)):
                    begin = b"%d:%d:" % (seed, rep)
                    digests = b"".join([md5(begin + k, usedforsecurity=False).digest() for k in names])
                    places = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(16)).astype(np.int64) % len(a)
                    rho.append(resampled(a, b, np.bincount(places, minlength=len(a))))
                pick = pa.array([i] * len(rho))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pick) for c in by), pa.array(rho, pa.float64())], [*by, "rho"])

    return dealt.mapInArrow(run, T.StructType([*own, T.StructField("rho", T.DoubleType())]))


def _drawn_joined(pairs: DataFrame, by: list[str], key: str, x: str, y: str, replicates: int, seed: int) -> DataFrame:
    """The same for groups of any size: every draw is a row that is joined to the one it names."""
    w = Window.partitionBy(*by)
    a = pairs.withColumn("_i", F.row_number().over(w.orderBy(key, x, y)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    dealt = a.select(*by, F.col("_i").alias("_k"), "_n").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    draws = dealt.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_rep", "_k")), 1, 12), 16, 10).cast("long") % F.col("_n")
    drawn = draws.withColumn("_i", place).join(a.select(*by, "_i", x, y), [*by, "_i"])
    return spearman(drawn.select(*by, "_rep", x, y), [*by, "_rep"], x, y)
