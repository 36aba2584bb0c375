"""Sentences in typed blocks, their columns, and each pattern on a text made to show it."""

import random

import numpy as np
import pytest

from lexigrain.operators import passages as P

FILL = "river stone garden window copper winter market harbor letter basket candle meadow".split()


def said(n, rng, first="Water"):
    """A sentence of n words."""
    return " ".join([first, *(rng.choice(FILL) for _ in range(n - 1))]) + "."


def paragraph(sizes, seed=0):
    """Sentences of these sizes, each with a first word of its own."""
    rng = random.Random(seed)
    return " ".join(said(n, rng, FILL[k % len(FILL)].capitalize()) for k, n in enumerate(sizes))


def kinds(text, *wanted):
    return [f for f in P.find(P.sentences_of(text)) if f[0] in wanted]


def test_sentences_stay_in_their_blocks():
    text = "# A title here\n\nOne two, three. Four five!\n***\n\n- an item\n\n```\ncode a. Code b.\n```"
    got = [(s.type, text[s.start : s.end]) for s in P.sentences_of(text)]
    assert got == [(1, "# A title here"), (0, "One two, three."), (0, "Four five!"), (2, "- an item"), (3, "```\ncode a. Code b.\n```")]


def test_offsets_quote_the_text_and_abbreviations_hold():
    text = "He met Dr. Smith.  They don't agree.\nReally?"
    got = P.sentences_of(text)
    assert [text[s.start : s.end] for s in got] == ["He met Dr. Smith.", "They don't agree.", "Really?"]
    assert got[1].words == ["they", "don", "agree"]
    assert [text[a:b].lower() for s in got for a, b in s.spans] == [w for s in got for w in s.words]


def test_wordless_sentences_join_the_one_before():
    text = "One two. (...) Three."
    assert [text[s.start : s.end] for s in P.sentences_of(text)] == ["One two. (...)", "Three."]


def test_phrases_pauses_and_stress():
    (s,) = P.sentences_of("The cat, a dog - and so on…", {"dog": [1], "and": [0]})
    assert s.phrases == [2, 2, 3] and s.pauses == [0.29, 0.57]
    assert P.beats("banana", "NOUN", {"banana": [0, 1, 0]}) == [0, 1, 0]
    assert P.beats("banana", "NOUN", {}) == [1, 0, 0]
    assert P.beats("the", "DET", {}) == [0] and P.beats("cat", "NOUN", {}) == [1]


def test_distance_against_the_plain_recurrence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(0, 9))] for _ in range(2))
        table = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        assert P.distance(a, b) == pytest.approx(table[len(a), len(b)] / max(len(a), len(b), 1))


def test_runs_stop_at_parts():
    flags, part = np.array([1, 1, 1, 1, 0, 1], bool), np.array([0, 0, 1, 1, 1, 1])
    assert P.runs(flags, part, 1) == [(0, 1), (2, 3), (5, 5)]
    assert P.runs(flags, part, 2) == [(0, 1), (2, 3)]
    assert P.runs(np.empty(0, bool), np.empty(0, int), 1) == []


def test_local_cv_takes_full_windows_of_one_part():
    values, part = np.array([1.0, 1, 1, 3, 5, 5]), np.array([0, 0, 0, 1, 1, 1])
    starts, got = P.local_cv(values, part, 3)
    assert list(starts) == [0, 3] and got[0] == 0 and got[1] == pytest.approx(np.std([3, 5, 5]) / np.mean([3, 5, 5]))


def test_flat_stretch():
    sizes = [3, 14, 5, 2, 30, 9, 9, 9, 9, 9, 9, 2, 18, 6, 25, 3, 16, 4]
    assert [f[1:3] for f in kinds(paragraph(sizes), "flat_stretch")] == [(5, 10)]


def test_long_and_short_runs():
    sizes = [8, 8, 20, 21, 22, 23, 8, 8, 8, 8, 3, 3, 2, 3, 8, 8]
    assert [f[:3] for f in kinds(paragraph(sizes), "long_run", "short_run")] == [("long_run", 2, 5), ("short_run", 10, 13)]


def test_runs_never_cross_a_heading():
    text = paragraph([8, 8, 8, 8, 20, 21]) + "\n\n# Heading\n\n" + paragraph([22, 23, 8, 8, 8, 8])
    assert not kinds(text, "long_run")


def test_nothing_but_emphasis_in_a_short_text():
    assert {f[0] for f in P.find(P.sentences_of(paragraph([9, 9, 9, 2, 9, 9, 9])))} == {"emphasis_point"}


def test_emphasis_is_half_of_its_neighbours():
    (found,) = kinds(paragraph([9, 9, 9, 4, 9, 9, 9]), "emphasis_point")
    assert found == ("emphasis_point", 3, 3, 9.0)


def test_repeated_structure_by_opening():
    rng = random.Random(2)
    text = " ".join([said(9, rng, f"{w} then") for w in ("Never", "Never", "Never", "Here", "There", "Soon", "Always", "Often")])
    assert [f[1:3] for f in kinds(text, "repeated_structure")][0][0] == 0


def test_repeated_terminology():
    tail = " and on the {} he was very {} there, in it."
    text = " ".join(f"{w} copper" + (tail.format(a, b) if k % 2 else f" {a}.") for k, (w, a, b) in enumerate(zip("The A These Not Very Soon Here Now".split(), FILL, FILL[1:])))
    assert [f[:3] for f in kinds(text, "repeated_terminology")] == [("repeated_terminology", 0, 7)]


def test_dense_relations():
    text = paragraph([5] * 8) + " Rivers rise because winters end although markets close while letters wait."
    assert kinds(text, "dense_relations") == [("dense_relations", 8, 8, 3.0)]


def test_disconnected_sentences():
    lone = [f"{a.capitalize()} {b}." for a, b in zip("anchor bridge cellar dagger".split(), "engine fabric goblet hammer".split())]
    text = " ".join([*lone, *["Water finds the river stone garden window copper winter market harbor."] * 9])
    assert kinds(text, "disconnected_run")[0][:3] == ("disconnected_run", 0, 3)


def test_short_and_even_paragraphs():
    blocks = [[10, 10], [3, 2], [11, 9], [10, 10], [9, 11], [10, 10], [30, 30], [2, 40]]
    text = "\n\n".join(paragraph(b, k) for k, b in enumerate(blocks))
    got = kinds(text, "short_paragraph", "even_paragraphs")
    assert [f[:3] for f in got] == [("short_paragraph", 1, 1), ("even_paragraphs", 2, 5)] and got[1][3] == 0


def test_summary_of_a_counted_text(spark):
    text = "The cat sat. Dogs ran. A banana is here.\n\n# Title\n\nEnd."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in P.summary(df).collect()}
    r = got[1]
    assert (r.sentences, r.prose_sentences, r.paragraphs, r.words, r.prose_words) == (5, 4, 3, 11, 10)
    assert list(r.type_counts) == [2, 1, 0, 0, 0, 0] and not r.computed
    # beats: the cat sat | dogs ran | a ba-na-na is here | end
    assert (r.syllables, r.stresses) == (3 + 2 + 7 + 1, 2 + 2 + 2 + 1)
    assert r.landing_paragraphs == 1 and r.final_ratio == pytest.approx(7 / 3) and r.initial_ratio == 1
    for k in (2, 3):
        assert got[k].sentences == 0 and got[k].final_ratio is None and got[k].median is None and got[k].clash == 0


def test_rows_compare_with_the_sentence_before(spark):
    df = spark.createDataFrame([(1, "The cat sat on mats. The cat ate mats. Dogs ran.")], "doc_id long, text string")
    rows = P.block_sentences(df, stop=frozenset(["sat"])).orderBy("sent").collect()
    assert [r.opening_similarity for r in rows] == [None, 1.0, 0.0]
    assert rows[0].overlap is None and rows[1].overlap == pytest.approx(2 / 3) and rows[2].overlap == 0
    assert [r.phrase_start for r in rows] == [0, 1, 2] and [r.is_final for r in rows] == [False, False, True]
    assert rows[0].skeleton_similarity is None and not any(r.is_standalone for r in rows)
