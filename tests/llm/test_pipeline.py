"""The pipeline's stages, one after the other, against brute force, DuckDB and the laws of the last stage."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lexigrain.llm import queries
from lexigrain.storage import Scratch
from pyspark.sql import functions as F
from tests.llm.test_ops import DOCS, ODD, components_by_brute_force, words

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sentence(rng, n):
    return " ".join(words(rng, n, 900)).capitalize() + "."


def rows():
    """Good documents of three sources, some with copies, changed copies and benchmark passages; bad ones; odd rows."""
    rng = random.Random(17)
    item = " ".join(words(rng, 30, 5000))
    good = [" ".join(sentence(rng, 12) for _ in range(8)) for _ in range(120)]
    out = []
    for k, text in enumerate(good):
        w = text.split()
        if k % 10 == 1:  # near copies of the text before: one word of some hundred is another
            w = good[k - 1].split()
            w[rng.randrange(10, 90)] = "other"
        if k % 10 == 2:
            w[40:40] = item.split()[5:20]
        out.append((1000 + k, " ".join(w), "en", "abc"[k * k % 7 % 3], 1))
    out += [(1200 + k, good[7], "en", "a", 1) for k in range(15)]
    out += [(2000 + k, " ".join("$#|*"[rng.randrange(4)] * 3 + "!!" for _ in range(60)), "en", "b", 1) for k in range(60)]
    return [*ODD, *out], item


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input, and what each stage kept of its predecessor's rows."""
    data, item = rows()
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(data, DOCS)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 2000), 0) for r in data if r[0] and r[0] >= 1000], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    scratch, steps = Scratch(spark, "steps"), [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        steps.append(scratch.table(stage(spark, steps[-1], sf), f"s{k}"))
    return sf, steps


def content(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_columns_stay_until_the_last_stage(stages):
    _, steps = stages
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


def test_quality_keeps_good_documents(stages):
    _, steps = stages
    kept, before = set(content(steps[1])), set(content(steps[0]))
    assert kept <= before
    assert not any(r[0] and r[0] >= 2000 for r in kept)
    assert {r[0] for r in before if r[0] and 1000 <= r[0] < 2000} <= {r[0] for r in kept}


def test_near_dedup_against_brute_force(stages):
    _, steps = stages
    before = [tuple(r) for r in steps[1].collect()]
    want = {r[0] for r, found in zip(before, components_by_brute_force(before, 5, 80, 100), strict=True) if found[2] is None or found[2] == r[0]}
    got = ids(steps[2])
    assert set(got) == want and max(got.values()) == 1
    assert len(got) <= len(before) - 15
    assert set(content(steps[2])) <= set(before)


def test_decontamination_against_brute_force(stages):
    _, steps = stages
    _, item = rows()
    w = ITEM.findall(item)
    windows = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    own = {r: ITEM.findall((r[1] or "").translate(LETTERS)) for r in content(steps[2])}
    want = [r for r, t in own.items() if not any(tuple(t[i : i + 10]) in windows for i in range(len(t) - 9))]
    assert content(steps[3]) == sorted(want, key=str) and len(want) < len(own)


def test_mixing_against_duckdb(stages):
    """Each document comes as often, and the last time as long, as op1's SQL over the stage's input says.

    The stage tells rows apart by (doc_id, hash of the text), so that pair is the id which the SQL draws by.
    """
    _, steps = stages
    drawn = steps[3].withColumn("doc_id", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    con = duckdb.connect()
    con.register("documents", drawn.toPandas())
    taken = {r[0].split("|")[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, taken FROM ({queries.ORACLE_SQL['op1_mix']})").fetchall()}
    named = lambda doc_id: "" if doc_id is None else str(doc_id)
    texts = {named(r[0]): r[1] for r in content(steps[3])}
    got: dict = {}
    for doc_id, text, *_ in content(steps[4]):
        got.setdefault(named(doc_id), []).append(text)
    assert set(got) == {d for d, (_, n) in taken.items() if n}
    for doc_id, copies in got.items():
        size, n = taken[doc_id]
        assert len(copies) == math.ceil(n / size)
        assert sum(len(c.split()) for c in copies) == n
        assert all(texts[doc_id].startswith(c) for c in copies)


def test_sharding_keeps_rows_and_balances(stages):
    _, steps = stages
    got = [tuple(r) for r in steps[5].collect()]
    assert sorted((r[:-2] for r in got), key=str) == content(steps[4])
    slots: dict = {}
    for *_, shard, slot in got:
        slots.setdefault(shard, []).append(slot)
    assert set(slots) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1


def test_run_is_the_chain_of_its_stages(spark, stages):
    sf, steps = stages
    assert content(corpus_pipeline.run(spark, sf)) == content(steps[5])
