"""Resampled rank correlation: the packed way against the joined one."""

import random

from lexigrain.operators import profiles as P


def test_bootstrap_of_a_held_group_equals_the_joined_one(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(g, k // 2, rng.choice([None, 1.0, 2.0, 5.5, rng.random()]), float(rng.randint(0, 6))) for g, n in (("a", 90), ("b", 7), (None, 9), ("c", 1)) for k in range(n)]
    pairs = spark.createDataFrame(rows, "g string, k long, x double, y double")
    run = lambda: sorted((r.g, round(r.lower, 9)) for r in P.bootstrap(pairs, ["g"], "k", "x", "y", replicates=25).collect())
    held = run()
    assert [g for g, _ in held][:2] == ["a", "b"]
    monkeypatch.setattr(P, "GROUP", 3)
    assert run() == held


def test_bootstrap_moves_a_row_once_a_block_of_replicates(spark):
    pairs = spark.createDataFrame([("a", k, float(k % 7), float(k % 5)) for k in range(300)], "g string, k long, x double, y double")
    plan = P.bootstrap(pairs, ["g"], "k", "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
