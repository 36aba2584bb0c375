"""Pairs, axes, heads, agreement, numbering and senses on small literal input."""

import numpy as np
import pytest

from lexigrain.operators import corpus, lookup, models, semantic, surface
from lexigrain.storage import Scratch
from pyspark.sql import functions as F


def test_pairs_in_order_and_once():
    text = "One. Two. One.\nThree. Two."
    assert semantic.pairs_of(text) == [("One.", "Two."), ("One.", "Three."), ("Three.", "Two.")]
    # (two, one) is the first pair again, and within the first line nothing is new
    assert semantic.pairs_of("") == [] and semantic.pairs_of("Alone.") == []


def test_pairs_end_at_the_budget():
    text = " ".join(f"Word{k}." for k in range(40))
    assert len(semantic.pairs_of(text)) == 50
    assert len(semantic.pairs_of(text, least=5)) == 5
    assert len(semantic.pairs_of("\n".join(["Again. And again."] * 20_000))) == 1


@pytest.mark.parametrize("count", [0, 1, 3])
def test_axes_against_svd(spark, count):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * [5, 1, 3, 1, 1, 2] + 7
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    mean, leading = semantic.axes(df, "v", count)
    _, _, vt = np.linalg.svd(x - x.mean(axis=0))
    assert mean == pytest.approx(x.mean(axis=0))
    assert np.abs(leading @ vt[:count].T) == pytest.approx(np.eye(count), abs=1e-6) if count else len(leading) == 0
    got = {r.id: r.u for r in df.select("id", semantic.without_axes(F.col("v"), mean, leading).alias("u")).collect()}
    want = (x - x.mean(axis=0)) @ (np.eye(6) - vt[:count].T @ vt[:count])
    assert got.pop(999) is None and np.array([got[k] for k in range(300)]) == pytest.approx(want, abs=1e-6)


def test_axes_of_nothing(spark):
    mean, leading = semantic.axes(spark.createDataFrame([], "v array<double>"), "v", 2)
    assert len(mean) == 0 and len(leading) == 0


def test_head(spark):
    df = spark.createDataFrame([([1.0, -1.0],), (None,)], "v array<double>")
    w1, b1, w2, b2 = np.eye(2), np.array([0.5, 0.5]), np.array([[2.0, 0.0], [0.0, 2.0]]), np.array([0.0, 1.0])
    assert [r[0] for r in df.select(semantic.head(F.col("v"), w1, b1, w2, b2)).collect()] == [[4.0, 0.0], None]


def test_agreement(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", None), (None, "a")]
    got = {r["class"]: r for r in models.agreement(spark.createDataFrame(rows, "g string, p string"), "g", "p").collect()}
    assert set(got) == {"a", "b", "c"} and all(r.accuracy == pytest.approx(0.6) for r in got.values())
    assert (got["a"].precision, got["a"].recall, got["a"].f1) == (1.0, 0.5, pytest.approx(2 / 3))
    assert (got["b"].precision, got["b"].recall, got["c"].precision, got["c"].f1) == (pytest.approx(2 / 3), 1.0, 0.0, 0.0)


def test_numbered(spark):
    rows = [(f"w{k}", 5 if k % 3 else 1) for k in range(500)]
    got = corpus.numbered(spark.createDataFrame(rows, "word string, count long"), Scratch(spark, "t")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(500))
    assert [r.word for r in got] == [w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert corpus.numbered(spark.createDataFrame([], "word string, count long"), Scratch(spark, "t")).count() == 0


def test_sense_falls_back_to_any_class(spark):
    defaults = spark.createDataFrame([("as", "CONJ", "cause"), ("as", None, "reference"), ("so", "ADV", "degree")], "item string, class string, sense string")
    matches = spark.createDataFrame([(1, "as", "CONJ"), (2, "as", "ADP"), (3, "so", "CONJ"), (4, "so", "ADV"), (5, "as", None)], "id int, item string, class string")
    assert {r.id: r.sense for r in lookup.with_sense(matches, defaults).collect()} == {1: "cause", 2: "reference", 3: None, 4: "degree", 5: "reference"}


def test_surface(spark):
    df = spark.createDataFrame([("One two three four five six seven eight.\n  short line.\n\nno end with eight words here at all",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(surface.fragment_share(F.col("t"))).collect()] == [pytest.approx(2 / 3), 0, 0]
    df = spark.createDataFrame([("Don’t stop-it 2nd 'em",), (None,)], "t string")
    assert [r[0] for r in df.select(surface.vector_tokens(F.col("t"))).collect()] == [["don't", "stop", "it", "2nd", "em"], []]
