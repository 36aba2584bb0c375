"""Hand-computed values on literal texts."""

import pytest

from lexigrain.operators import cadence, judge, kernels, lookup, measures, profiles, vectors
from lexigrain.operators.annotate import sentence_texts
from lexigrain.sources.readers import paragraphs_of
from pyspark.sql import functions as F


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(df):
    return df.collect()[0].asDict()


def test_sentences_keep_abbreviations_initials_and_lower_case():
    assert sentence_texts("He met Dr. Smith. They left.") == ["He met Dr\x02 Smith.", "They left."]
    assert len(sentence_texts("J. Smith said so! and left. Really?")) == 2


def test_overlap_of_three_sentences(spark):
    r = one(measures.overlap(docs(spark, "Cats sleep. Cats eat. Dogs eat."), ("all",), ("sent",)))
    assert r["overlap"] == 0.5 and r["binary"] == 1.0
    assert r["overlap_2"] == 0.5 and r["binary_2"] == 1.0


def test_overlap_of_single_sentence_is_zero(spark):
    r = one(measures.overlap(docs(spark, "Only one."), ("all",), ("sent",)))
    assert {r[k] for k in ("overlap", "overlap_2", "binary", "binary_2")} == {0.0}


def test_mtld_of_one_word(spark):
    assert one(measures.mtld(docs(spark, " ".join(["tree"] * 50)), []))["mtld_score"] == 2.0
    assert one(measures.mtld(docs(spark, "too short"), []))["mtld_score"] == 0.0


def test_empty_and_null_texts(spark):
    d = docs(spark, "", None)
    for measure in (lambda x: measures.basic(x, []), measures.readability, measures.diversity, measures.givenness, measures.closed_connectives):
        for r in measure(d).collect():
            assert not any(v for k, v in r.asDict().items() if k != "doc_id"), r


def test_connectives_take_the_longest_and_do_not_overlap(spark):
    items = lookup.inventory(spark, {"cause": ["as", "as long as"], "other": ["long"]})
    found = {r.relation: r.matches for r in lookup.connectives(docs(spark, "As long as it is as it was."), items).collect()}
    assert found == {"cause": 2, "other": 1}


def test_profile_and_compare(spark):
    values = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0)], "doc_id long, property string, value double")
    ranges = profiles.profile(values, [])
    assert one(ranges)["med"] == 2.0
    draft = spark.createDataFrame([(9, "a", 3.2), (8, "a", 5.0)], "doc_id long, property string, value double")
    flags = profiles.compare(draft, ranges, []).collect()
    assert [(r.doc_id, r.side, r.spans) for r in flags] == [(8, "above", 1.0)]


def test_spearman_with_ties(spark):
    rows = [("g", float(k), float(k // 2)) for k in range(12)]
    r = one(profiles.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y"))
    assert r["rho"] == pytest.approx((140 / 143) ** 0.5) and r["status"] == "pass"


def test_js_of_equal_and_disjoint(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>, c array<double>")
    assert tuple(df.select(vectors.js_similarity(F.col("a"), F.col("b")), vectors.js_similarity(F.col("a"), F.col("c"))).first()) == (1.0, 0.0)


def test_tokenizer():
    assert kernels.tokenize("I can't go (yet), Mr. Smith.") == ["I", "ca", "n't", "go", "(", "yet", ")", ",", "Mr.", "Smith", "."]
    assert kernels.tokenize("cannot stop—now...") == ["can", "not", "stop", "—", "now", "..."]


def test_wordpieces():
    known = frozenset(["un", "##able", "##ab", "a"])
    assert kernels.wordpieces("Unable a zzz", known) == ["un", "##able", "a", "[UNK]"]


def test_hyphenation():
    patterns = kernels.parse_patterns(["% comment", "a1b", "1ca"])
    assert kernels.hyphen_points("tabcat", patterns) == [2, 3]


def test_tagger_learns_a_toy_language(spark):
    data = [[("the", "DET"), ("cat", "N"), ("runs", "V")], [("a", "DET"), ("dog", "N"), ("sleeps", "V")]] * 3
    tagger = kernels.Tagger().train(data)
    assert [t for t, _ in tagger.tag(["the", "dog", "runs"])] == ["DET", "N", "V"]
    df = spark.createDataFrame([(["a", "cat", "sleeps"],)], "tokens array<string>")
    assert kernels.tagged(df, tagger).first().tags == ["DET", "N", "V"]


def test_blocks():
    text = "# Title\n\nSome prose that goes on.\nAnd on.\n\n- item one\n- item two\n\n```\ncode\n```\n\n> said"
    assert [b[0] for b in cadence.blocks_of(text)] == [1, 0, 2, 2, 3, 4]


def test_alignment_finds_insertions_and_changes():
    before = "First paragraph about trees and rivers.\n\nSecond one about stones."
    after = "First paragraph about trees and rivers.\n\nSomething wholly new here indeed.\n\nSecond one about large stones."
    assert [p[0] for p in cadence.align_texts(before, after)] == ["equal", "inserted", "changed"]


def test_patterns_find_a_short_run(spark):
    text = " ".join(["This sentence is a good deal longer than all of the others here."] * 8 + ["Short one."] * 3)
    kinds = {r.kind for r in cadence.patterns(docs(spark, text)).collect()}
    assert "opening" in kinds


def test_paragraphs_of_html():
    page = "<nav><p>one two three four five six seven eight</p></nav><p>a b c d e f g h i</p><script>var x='<p>'</script><p>short</p>"
    assert paragraphs_of(page) == ["a b c d e f g h i"]


def test_judge_packs_and_halves(spark):
    rows = [(1, k, "x" * 29) for k in range(5)]
    out = judge.batches(spark.createDataFrame(rows, "g long, k long, t string"), "g", "k", "t", budget=20).orderBy("k").collect()
    assert [r.batch for r in out] == [0, 0, 1, 1, 2]

    def picky(items):
        if len(items) > 2:
            raise judge.TooLarge
        return judge.stub(items)

    questions = spark.createDataFrame([(str(k), f"q{k}", ["0", "1"]) for k in range(7)], "id string, text string, criteria array<string>").coalesce(1)
    assert sorted(r.id for r in judge.ask(questions, picky).collect()) == [str(k) for k in range(7)]


def test_stream_measures_append(spark, tmp_path):
    from lexigrain.streaming import documents as stream

    docs(spark, "One two. Three two.", "Four.").write.parquet(str(tmp_path / "in"))
    q = stream.measure(stream.read(spark, str(tmp_path / "in")), measures.readability).writeStream.format("memory").queryName("measured").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("measured").count() == 2


def test_command_line(spark, tmp_path, capsys):
    from lexigrain.__main__ import main

    (tmp_path / "a.txt").write_text("The cat sat on the mat. The cat ran.")
    (tmp_path / "b.txt").write_text("A dog ran off. It was gone.")
    assert main(["profile", str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], spark) == 0
    profile = capsys.readouterr().out.strip().splitlines()[-1]
    (tmp_path / "p.json").write_text(profile)
    assert main(["compare", str(tmp_path / "a.txt"), str(tmp_path / "p.json")], spark) == 0
    assert main(["source", str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], spark) == 0


def test_short_and_long_tables_give_the_same(spark):
    from lexigrain.operators import lookup
    from lexigrain.plans.registry import STOP

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    items = lookup.inventory(spark)
    assert rows(lookup.connectives(docs, items)) == rows(lookup._joined(docs, items))
    table = lookup.zipf_table(docs)
    one, two = (rows(f(docs, table, STOP, 500).select("doc_id", "zipf_mean", "zipf_std")) for f in (lookup.zipf, lookup._zipf_joined))
    assert [r[0] for r in one] == [r[0] for r in two]
    assert all(abs(a - b) < 1e-6 for x, y in zip(one, two, strict=True) for a, b in zip(x, y, strict=True))


def test_the_kernel_of_nothing(spark):
    from lexigrain.operators import measures

    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n . "), (4, "Words Ⅷ x² here.")], "doc_id long, text string")
    out = {r.doc_id: r for r in measures.properties(docs, []).collect()}
    assert out[1].n_tokens == out[2].n_tokens == out[3].n_tokens == 0 and out[1].mtld_score == 0 and out[3].n_sentences >= 1
    assert out[4].n_tokens == 3
    assert measures.overlap(docs).filter("overlap > 0").count() == 0
    assert measures.properties(docs.limit(0), []).count() == 0


def test_tokens_with_marks_and_abbreviations():
    assert kernels.tokenize("“*Well*,” Mr. Smith won't say (cannot!)...") == ["“", "*", "Well", "*", ",", "”", "Mr.", "Smith", "wo", "n't", "say", "(", "can", "not", "!", ")", "..."]
    assert kernels.tokenize("_so_ shan't e.g. J. U.S. end.") == ["_", "so", "_", "sha", "n't", "e.g.", "J.", "U.S.", "end", "."]
    assert kernels.tokenize("well-known and/or mother-in-law's wait--what") == ["well", "-", "known", "and", "/", "or", "mother-in-law", "'s", "wait", "--", "what"]


def test_alignment_of_split_and_joined_blocks():
    words = lambda a, b: " ".join(f"w{k}" for k in range(a, b)) + "."
    one = "\n\n".join([words(0, 20), words(100, 110), words(110, 120), words(300, 320)])
    two = "\n\n".join([words(0, 10), words(10, 20), words(100, 120), words(500, 520)])
    found = cadence.align_texts(one, two)
    assert [(p[0], p[1]) for p in found[:2]] == [("split", 1.0), ("merged", 1.0)]
    assert sorted(p[0] for p in found[2:]) == ["deleted", "inserted"]
