"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / w, where u comes from a hash of
the document and w is its quality weight; ordered by that key, each prefix of a
source is a weighted sample without replacement. A source's target is met by
complete epochs first, then by the prefix whose sizes sum to the rest; the
document at the edge gives only as many words as are still missing.

The prefix sums are distributed: keys fall into buckets of about
``bucket_rows`` rows of a source, sums of buckets are accumulated first, and a
window then runs inside each bucket, so no source has to fit one task.

Cases: a null text has size 0 and takes 0; a null source is a source of its
own, last in order; a source of empty texts has target 0; repeated rows count
each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.names import spare
from lexigrain.storage import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts; the same on every engine and run."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def letter_weight(text: Column) -> Column:
    """The default quality weight: 1 for plain prose, down to 0.25 as marks and symbols take over."""
    chars = F.greatest(F.length(text), F.lit(1))
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>!]", ""))
    return F.coalesce(F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(4.0) * marks / chars), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int) -> DataFrame:
    """One row a source: source_size and target.

    ``sizes`` has a row for each source. Targets follow ``weights`` (repeating,
    in code point order, null last) of share[0]/share[1] of all words, but none
    exceeds ``most`` times its source. Resharing the excess until none is above
    has a closed form: by rising cap/weight, a source is capped as long as its
    cap is within its share of what the sources before it left.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    wide = "decimal(38,0)"
    ranked = (
        sizes.withColumn("i", (F.row_number().over(order) - 1) % len(weights))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("i").cast("int") + 1).cast(wide))
        .withColumn("cap", (F.col("source_size") * most).cast(wide))
        .withColumn("budget", (F.sum("source_size").over(whole) * share[0]).cast(wide))  # in share[1]ths
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)) * share[1])
        .withColumn("weights_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * share[1] * F.col("weights_left") <= F.col("left") * F.col("weight"))
    )
    free = F.when(~F.col("capped"), F.struct("left", "weights_left"))
    rate = F.max_by(free, F.when(~F.col("capped"), F.col("left") / F.col("weights_left"))).over(whole)
    return ranked.withColumn("rate", rate).select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight").cast("double") * F.col("rate.left").cast("double") / (F.col("rate.weights_left") * share[1]).cast("double"))
        .alias("target"),
    )


def plan(
    docs: DataFrame,
    scratch: Scratch,
    size: Column,
    weight: Column,
    key: Sequence[str] = ("doc_id",),
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: int = 0,
    bucket_rows: int = 4_000,
) -> DataFrame:
    """What the mix takes of each row: key columns, source, size, source_size, target, epochs, taken.

    ``size`` and ``weight`` are evaluated once, while the only pass over the
    texts writes a narrow table.
    """
    own = [F.col(k) for k in key]
    narrow = docs.select(*own, F.col(source).alias("source"), size.alias("size"), weight.cast("double").alias("w"))
    narrow = scratch.table(narrow.withColumn("v", F.pow(unit(F.lit(seed), *own), F.lit(1.0) / F.col("w"))), "sizes")
    stats = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = targets(stats, weights, share, most).withColumn("n_buckets", F.ceil(F.col("n_docs") / bucket_rows))
    goals = scratch.table(goals, "targets")
    if goals.count() <= 100_000:  # a source is a row of five numbers: at most some MB
        goals = F.broadcast(goals)
    # v = exp(-key) falls as the key -ln(u)/w grows, and lies in (0, 1)
    rows = narrow.withColumn("null_source", F.col("source").isNull()).withColumn("source_", F.coalesce("source", F.lit("")))
    goals = goals.withColumn("null_source", F.col("source").isNull()).withColumn("source_", F.coalesce("source", F.lit("")))
    rows = rows.join(goals.drop("source"), ["null_source", "source_"]).withColumn("bucket", F.floor((1 - F.col("v")) * F.col("n_buckets")))
    group = ["null_source", "source_", "bucket"]
    before = Window.partitionBy("null_source", "source_").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*group).agg(F.sum("size").alias("bucket_size")).select(*group, F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*group).orderBy(F.desc("v"), *own, "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum("size").over(inside)).join(starts, group)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    first = F.col("start") + F.col("end") - F.col("size")
    return ends.withColumn("epochs", epochs).select(
        *own,
        "source",
        "size",
        "source_size",
        "target",
        "epochs",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - first))).alias("taken"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    gap = r"[\x20\x09-\x0D]+"
    leading = F.when(F.regexp_like(text, F.lit(r"\A[\x20\x09-\x0D]")), 1).otherwise(0)
    parts = F.split(text, gap, (n + 1 + leading).cast("int"))
    cut = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(F.element_at(parts, -1))), r"[\x20\x09-\x0D]+\z", "")
    return F.when(F.size(parts) > n + leading, cut).otherwise(text)


def apply(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mixed corpus: each document once for every complete epoch, then the fractional part.

    Rows are told apart by (doc_id, a hash of the text); columns are those of
    ``docs``. The one document at a source's edge is cut after the words taken.
    """
    name, copy, part, take = (spare(docs.columns, k) for k in ("text_hash", "copy", "part", "take"))
    hashed = docs.withColumn(name, F.xxhash64("text"))
    taken = plan(hashed, scratch, n_words(F.col("text")), letter_weight(F.col("text")), key=("doc_id", name), **options)
    # repeated rows are interchangeable: the k-th copy of a row takes the k-th of its plan rows
    names = ("doc_id", name, "source")
    copies = taken.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("taken", "size"))).alias("parts"))
    same = Window.partitionBy(*names).orderBy("doc_id")
    rows = hashed.withColumn(copy, F.row_number().over(same)).alias("r")
    joined = rows.join(copies.alias("c"), [F.col(f"r.`{n}`").eqNullSafe(F.col(f"c.`{n}`")) for n in names])
    parts = joined.select(*[F.col(f"r.`{c}`") for c in docs.columns], F.element_at("c.parts", F.col(f"r.`{copy}`")).alias(part))
    size, words = F.col(f"{part}.size"), F.col(f"{part}.taken")
    full = F.when(size > 0, F.floor(words / size)).otherwise(0).cast("int")
    runs = F.concat(F.array_repeat(size, full), F.when(words - full * size > 0, F.array(words - full * size)).otherwise(F.array().cast("array<long>")))
    cut = parts.withColumn(take, F.explode(runs)).withColumn("text", F.when(F.col(take) < size, first_words(F.col("text"), F.col(take))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(take) < size, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])
