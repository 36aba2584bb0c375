"""Scoring with models that are tables: sparse linear classes, ensembles of standardised sums, kernels of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(features: DataFrame, weights: DataFrame, key: str, limit: int = 1_000_000) -> DataFrame:
    """(key, class, score, margin): sums of the weights of a row's features; ties go to the smaller class.

    ``features``: key, feature, n. ``weights``: feature, class, weight.
    """
    table = F.broadcast(weights) if weights.count() <= limit else weights
    scores = features.join(table, "feature").groupBy(key, "class").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", 6)), "class")
    ranked = scores.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.col("score") - F.lead("score").over(order))
    return ranked.filter("rank = 1").drop("rank")


def ensemble(values: DataFrame, models: DataFrame, key: list[str], low: float = 0.0, high: float = 100.0) -> DataFrame:
    """(key, score): mean over models of intercept + sum of weight * (value - mu) / sd, held within bounds.

    ``values``: key, property, value. ``models``: model, property, mu, sd, weight, intercept; a row for each term.
    """
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    terms = values.join(F.broadcast(models) if models.count() <= 100_000 else models, "property")
    members = terms.groupBy(*key, "model").agg((F.max("intercept") + F.sum(F.col("weight") * z)).alias("m"))
    return members.groupBy(*key).agg(F.least(F.lit(high), F.greatest(F.lit(low), F.avg("m"))).alias("score"))


def construct(values: DataFrame, stats: DataFrame, key: list[str]) -> DataFrame:
    """(key, score): 50 plus ten times the mean z of the properties in ``stats`` (property, mu, sd, sign)."""
    z = F.when(F.col("sd") > 0, F.col("sign") * (F.col("value") - F.col("mu")) / F.col("sd")).otherwise(0.0)
    return values.join(F.broadcast(stats) if stats.count() <= 100_000 else stats, "property").groupBy(*key).agg((50 + 10 * F.avg(z)).alias("score"))


def adjacent_groups(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, similarity): each group's members against the next group's, by normalised mean kernel.

    The mean dot product over all pairs of two groups is the dot product of
    their mean unit vectors, so no pair of members is ever formed.
    """
    from lexigrain.operators.vectors import dot

    unit = vectors.select(group, vector, F.sqrt(dot(F.col(vector), F.col(vector))).alias("_n")).filter("_n > 0")
    dims = unit.select(group, "_n", F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double") / F.col("_n")).alias("m"))
    means = dims.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    sizes = unit.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(group)  # a row for each group
    both = means.join(sizes, group).withColumn("next", F.lead("m").over(w))
    own = lambda c: F.greatest(dot(F.col(c), F.col(c)), F.lit(1e-6))
    return both.filter("next is not null").select(group, "n", (dot(F.col("m"), F.col("next")) / F.sqrt(own("m") * own("next"))).alias("similarity"))


def stress_table(pronunciations: DataFrame) -> DataFrame:
    """(word, syllables, mask) from (word, phones): syllables are phones with a stress digit; bit i of the mask is a primary stress (a secondary one only without any primary)."""
    vowels = pronunciations.select("word", F.filter("phones", lambda p: p.rlike("[0-9]$")).alias("v"))
    marked = lambda digit: f"aggregate(transform(v, (p, i) -> if(p rlike '{digit}$', shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)"
    out = vowels.select("word", F.size("v").cast("long").alias("syllables"), F.expr(marked(1)).alias("one"), F.expr(marked(2)).alias("two"))
    return out.select("word", "syllables", F.when(F.col("one") > 0, F.col("one")).otherwise(F.col("two")).alias("mask"))


def hybrid_baseline(table_rate, level, weight: float = 0.7, intercept: float = -3.98, slope: float = 2.57):
    """Column: a table's rate blended in logarithms with a judged level; a rate below the floor stays null."""
    return F.when(level.isNull(), table_rate).otherwise(F.exp(weight * F.ln(table_rate) + (1 - weight) * (intercept + slope * level)))


def agreement(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(class, support, precision, recall, f1, accuracy): how well a prediction meets the gold class, a row a class.

    Rows without a gold class are left out; one without a prediction is a miss.
    A class that is never predicted has precision 0. Only the counts of pairs of
    classes leave the map side.
    """
    cells = rows.filter(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    met = F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(F.explode(F.array(F.struct(F.col("g").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"), met.alias("met")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given"), F.lit(0).cast("long").alias("met")))).alias("x")).select("x.*")
    by_class = sides.filter(F.col("class").isNotNull()).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "given", "met")])
    whole = cells.agg((F.sum(met) / F.sum("n")).alias("accuracy"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    scored = by_class.select("class", "support", "given", "met", part("met", "given").alias("precision"), part("met", "support").alias("recall"))
    f1 = F.when(F.col("support") + F.col("given") > 0, 2 * F.col("met") / (F.col("support") + F.col("given"))).otherwise(0.0)
    # one row joins a row for each class
    return scored.crossJoin(F.broadcast(whole)).select("class", "support", "precision", "recall", f1.alias("f1"), "accuracy")
