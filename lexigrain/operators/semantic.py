"""Similarity of sentences and paragraphs: which pairs are rated, how scores of several spaces become one, and what vectors lose first.

Pairs of a document are found in its own row and stop at its budget, so no
pair beyond it is ever built. Axes come from sums of dim x dim numbers, added
up where the vectors are; only that one matrix reaches the driver.
"""

from __future__ import annotations

from itertools import chain, combinations, islice, pairwise, product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.operators.annotate import _BLANK, sentence_texts
from lexigrain.storage import spread

# Pairs rated of a thousand words, and the least number that any text may have.
PER_THOUSAND, LEAST = 100, 50
_WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
#: The widest vectors whose axes are computed: a matrix of this size squared, 16 MB with its places, reaches the driver.
WIDEST = 1024
#: Rows of a table of routes that is broadcast; a longer one is joined by a shuffle.
ROUTES = 100_000


def pairs_of(text: str, per_thousand: int = PER_THOUSAND, least: int = LEAST) -> list[tuple[str, str]]:
    """Different sentences to compare, each two once: neighbours, then those of neighbouring paragraphs, then those of one.

    Paragraphs are lines with text. The list ends at ``per_thousand`` pairs for
    a thousand words, or ``least`` if that is more.
    """
    paras = [[s.replace("\x02", ".") for s in sentence_texts(line)] for raw in text.split("\n") if (line := raw.strip(_BLANK))]
    distinct = [tuple(dict.fromkeys(p)) for p in paras]
    ordered = chain(
        pairwise(chain.from_iterable(paras)),
        chain.from_iterable(product(a, b) for a, b in dict.fromkeys(pairwise(distinct))),
        chain.from_iterable(combinations(p, 2) for p in dict.fromkeys(distinct)),
    )
    seen: set[frozenset[str]] = set()
    # set.add gives None: a pair passes once
    fresh = (p for p in ordered if p[0] != p[1] and (key := frozenset(p)) not in seen and not seen.add(key))
    return list(islice(fresh, max(least, per_thousand * len(_WORDS.findall(text)) // 1000)))


_PAIR = T.ArrayType(T.StructType([T.StructField("first", T.StringType()), T.StructField("second", T.StringType())]))


@F.arrow_udf(_PAIR)
def _pairs(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("first", pa.string()), ("second", pa.string())]))
    return pa.array([[{"first": a, "second": b} for a, b in pairs_of(t or "")] for t in texts.to_pylist()], kind)


def sentence_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, place, first, second): the pairs to rate of each document, the most important first."""
    return spread(docs).select("doc_id", F.posexplode(_pairs("text")).alias("place", "p")).select("doc_id", F.col("place").cast("long").alias("place"), "p.*")


def blend(values: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, route, value): the mean standardised component of a route, on the scale of its index.

    ``values``: keys, component, value. ``routes``: route, component, mean, sd
    and the route's offset a and factor b. A null value counts as the
    component's mean; a route none of whose components a row has is left out.
    """
    small = routes.limit(ROUTES + 1).count() <= ROUTES
    met = values.join(F.broadcast(routes) if small else routes, "component")
    z = F.coalesce((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(0.0))
    return met.groupBy(*keys, "route").agg((F.first("a") + F.first("b") * F.avg(z)).alias("value"))


def axes(df: DataFrame, vector: str, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and the ``count`` leading principal axes (rows) of a column of equally long vectors.

    Each batch gives one sum and one matrix of products; their entries are
    added up by Spark, so the driver gets dim x (dim + 2) rows at most. Null
    vectors are left out. Signs: the largest entry of an axis is positive.
    """
    first = df.select(vector).filter(F.col(vector).isNotNull()).first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0))
    dim = len(first[0])
    if dim > WIDEST:
        raise ValueError(f"vectors of {dim} numbers: at most {WIDEST}")

    def partial(batches):
        total, n = np.zeros((dim + 1, dim)), 0
        for batch in batches:
            column = batch.column(0).drop_null()
            x = np.asarray(column.flatten(), float).reshape(len(column), dim)
            total[0] += x.sum(axis=0)
            total[1:] += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), n))], ["i", "x"])

    sums = df.select(vector).mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    sums = sums["x"].to_numpy()[np.argsort(sums["i"].to_numpy())]
    n, total = sums[-1], sums[:-1].reshape(dim + 1, dim)
    mean = total[0] / n
    _, found = np.linalg.eigh(total[1:] / n - np.outer(mean, mean))
    rows = found.T[::-1][:count]
    return mean, rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])[:, None]


def without_axes(vector: Column, mean: np.ndarray, leading: np.ndarray) -> Column:
    """The vector minus the mean and minus its parts along the leading axes; null stays null."""
    kept = np.eye(len(mean)) - leading.T @ leading if len(leading) else np.eye(len(mean))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(vectors: pa.Array) -> pa.Array:
        out = [None if v is None else (np.asarray(v, float) - mean) @ kept for v in vectors.to_pylist()]
        return pa.array(out, pa.list_(pa.float64()))

    return run(vector)


def head(vector: Column, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> Column:
    """The vector plus what a small network adds to it: v + W2 relu(W1 v + b1) + b2; null stays null."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors.to_pylist():
            x = None if v is None else np.asarray(v, float)
            out.append(None if x is None else x + w2 @ np.maximum(w1 @ x + b1, 0) + b2)
        return pa.array(out, pa.list_(pa.float64()))

    return run(vector)
