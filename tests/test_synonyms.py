"""Overlap with synonyms by groups, against the same groups as pairs."""

import random

import pytest

from lexigrain.operators import corpus as C

SENTENCES = ["The station holds a nation.", "A nation and the relation. No.", "Station, station and motion!", "Cats see the station.", "", "Rations"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["\n", " "]).join(rng.choices(SENTENCES, k=rng.randint(0, 9)))) for k in range(60)] + [(60, None), (61, ""), (None, "The station. The nation.")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_grouped_overlap_is_synonym_overlap_without_its_pairs(spark, texts):
    words = ["station", "nation", "relation", "motion", "ration"]
    groups = spark.createDataFrame([(w, "a" if w[-5] == "a" else "b") for w in words], "word string, group string")
    named = groups.collect()
    pairs = spark.createDataFrame([(a.word, b.word, 0.5) for a in named for b in named if a.word != b.word and a.group == b.group], "w string, t string, score double")
    look = lambda df: sorted(((r.doc_id is None, r.doc_id, round(r.syn_overlap, 9)) for r in df.collect()), key=repr)
    wanted = look(C.synonym_overlap(texts, pairs))
    assert any(v for _, _, v in wanted)
    assert look(C.grouped_overlap(texts, groups, 0.5)) == wanted
    assert look(C.grouped_overlap(texts, groups, 0.5, limit=2)) == wanted
