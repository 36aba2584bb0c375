"""The corpus operators on small fixtures: brute force, exact round trips, and the cases that must not break them."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest

from lexigrain.llm import chunks, classifier, decontaminate, induced, mixing, minhash, pii, rules, sharding, substrings, warc
from lexigrain.storage import Scratch
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "some words here", None, "b", None), (4, "twice the same", "en", "a", 14), (4, "twice the same", "en", "a", 14), (5, "x" * 3000, "de", "b", 3000), (6, " \n\t ", "en", "a", 4)]


def words(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, and the odd rows."""
    rng = random.Random(3)
    out, passage = list(ODD), " ".join(words(rng, 120))
    for k in range(10, 60):
        text = " ".join(words(rng, rng.randrange(1, 300)))
        if k % 7 == 0:
            text += "\n" + passage + "\n" + " ".join(words(rng, 20))
        out.append((k, text, "en", f"s{k % 5}", len(text)))
    base = words(rng, 150)
    for k in range(100, 180):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(500)}"
        if k % 11 == 0:
            w += words(random.Random(k % 3), 40)
        out.append((k, " ".join(w), "en", "s1", 0))
    return out


#: Names that operators use inside, or return.
CLASHES = "node bucket row_hash text_hash _text_hash copy part take _copy _p score predicted _score spans size n_words component_id u v".split()


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)]) if extra else df


def rows_of(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_filters_keep_clashing_columns_and_empty_tables(spark, corpus, tmp_path):
    docs, plain, labels = frame(spark, corpus, True), frame(spark, corpus), spark.createDataFrame([(k, k % 2, 0) for k in range(10, 180)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, corpus[-1][1])], "item_id long, text string")
    stages = {
        "near": lambda d: minhash.drop_copies(d, Scratch(spark, "t"), 5, 80, 100),
        "clean": lambda d: decontaminate.drop_contaminated(d, items, Scratch(spark, "t")),
        "good": lambda d: classifier.good(d, labels, Scratch(spark, "t")),
        "mix": lambda d: mixing.apply(d, Scratch(spark, "t")),
        "mask": lambda d: pii.sanitise(d, Scratch(spark, "t")),
        "shard": lambda d: sharding.assign(d, Scratch(spark, "t")),
    }
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        got = rows_of(out, ["doc_id", "text", "source"])
        assert got == rows_of(stage(plain), ["doc_id", "text", "source"]), name
        assert all(r[c] == k for r in out.collect() for k, c in enumerate(CLASHES)), name
        assert stage(plain.limit(0)).count() == 0, name
    assert classifier.score(docs, labels, Scratch(spark, "t")).columns[-2:] == ["__score", "_predicted"]


def test_reports_of_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert substrings.dedup(none, Scratch(spark, "t")).count() == 0
    assert chunks.dedup(none, Scratch(spark, "t")).count() == 0
    assert sharding.shard(none, Scratch(spark, "t")).count() == 0
    assert decontaminate.flag(none.select("doc_id", "text"), items, Scratch(spark, "t")).count() == 0
    assert mixing.plan(none, Scratch(spark, "t"), mixing.n_words(F.col("text")), mixing.letter_weight(F.col("text"))).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert decontaminate.flag(one, items, Scratch(spark, "t")).first().contaminated is False


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(words(rng, 60_000))
    rows = [(1, long, "en", "a", 0), (2, long[:-50], "en", "a", 0), (3, "y" * 300_000, "en", "b", 0), (4, "a short one of a few words", "en", "b", 0)]
    docs = frame(spark, rows)
    near = {r.doc_id: r.component_id for r in minhash.components(docs.select("doc_id", "text"), Scratch(spark, "t"), 3, 85, 100).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4}
    gone = {r.doc_id: r.n_removed for r in substrings.dedup(docs, Scratch(spark, "t")).collect()}
    assert gone == {1: len(long) - 50, 2: len(long) - 50, 3: 300_000, 4: 0}
    assert {r.doc_id: r.n_words for r in rules.judge(docs).collect()} == {1: 60_000, 2: len(long[:-50].split()), 3: 1, 4: 7}
    later = {r.doc_id: r.n_removed for r in chunks.dedup(docs, Scratch(spark, "t")).collect()}
    assert later[1] == 0 and later[2] > 0.99 * len(long) and later[4] == 0
    assert pii.report(docs.select("doc_id", "text"), Scratch(spark, "t")).filter("spans != ''").count() == 0
    item = spark.createDataFrame([(9, " ".join(long.split()[30_000:30_010]))], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.flag(docs.select("doc_id", "text"), item, Scratch(spark, "t")).collect()}
    assert hits == {1: 10, 2: 10, 3: 0, 4: 0}
    assert {r.doc_id: r.size for r in sharding.shard(docs, Scratch(spark, "t")).collect()}[3] == 300_008
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert classifier.score(docs, labels, Scratch(spark, "t")).count() == 4


# -- induced sorting ----------------------------------------------------------


@pytest.mark.parametrize("budget", [8, 64, 100_000])
def test_suffixes_against_brute_force(tmp_path, budget):
    rng = np.random.default_rng(budget)
    for trial in range(60):
        n, k = int(rng.integers(2, 90)), int(rng.integers(1, 5))
        t = rng.integers(1, k + 1, n)
        if trial % 3 == 0:
            t = np.tile(t[: int(rng.integers(1, 7))], 20)[:n]
        t = np.r_[t, 0]
        out = list(induced.suffixes(t, k + 1, 30, str(tmp_path), budget))
        order, lcp = (np.concatenate([o[i] for o in out]).tolist() for i in (0, 1))
        tl = t.tolist()
        assert sorted(order) == list(range(len(t)))
        for i in range(1, len(order)):
            a, b = tl[order[i - 1] :], tl[order[i] :]
            common = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert a[:30] >= b[:30] and lcp[i] == min(30, common)


EXTERNAL = """
import resource, sys
import numpy as np
from lexigrain.llm import induced
resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
budget, n, folder = 16_384, 50 * 16_384, sys.argv[1]
rng = np.random.default_rng(5)
text = rng.integers(2, 258, n + 1).astype("<u2")
text[n // 2 : n // 2 + 5000] = text[1000:6000]
text[100_000:160_000] = 70  # a long run
text[200_000:260_000] = np.tile(text[200_000:200_030], 2000)  # and a period
text[-1] = 0
text.tofile(f"{folder}/t")
text = np.memmap(f"{folder}/t", "<u2", "r")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
flags = induced.repeated(text, 258, 400, budget, folder)
mapped = sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith(("Anonymous:",)))
seen, want = {}, np.zeros(len(text), bool)
raw = text.tobytes()
for i in range(n - 399):
    key = hash(raw[2 * i : 2 * i + 800])
    if key in seen:
        want[i] = want[seen[key]] = True
    seen[key] = i
print((flags != want).sum(), want.sum(), mapped)
"""


def test_external_sort_of_a_text_far_beyond_its_budget(tmp_path):
    env = {**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    out = subprocess.run([sys.executable, "-c", EXTERNAL, str(tmp_path)], env=env, capture_output=True, text=True, timeout=900)
    assert not out.returncode, out.stderr
    wrong, hits, held_kb = map(int, out.stdout.split())
    assert wrong == 0 and hits > 100_000
    assert held_kb < 60_000  # memory of its own after 820,000 symbols, the interpreter and numpy included


def removed_by_brute_force(texts, width):
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for i in range(len(r) - width + 1):
            seen[r[i : i + width]] = seen.get(r[i : i + width], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append((int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


def test_op2_against_brute_force(spark, corpus):
    got = substrings.dedup(frame(spark, corpus, True), Scratch(spark, "t"), shard_bytes=1 << 14, budget=512).collect()
    want = removed_by_brute_force([r[1] for r in corpus], 400)
    assert sorted(((r.doc_id, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(((c[0], *w) for c, w in zip(corpus, want, strict=True)), key=str)
    assert sum(r.n_removed for r in got) > 0


# -- mixing ---------------------------------------------------------------------


def test_op1_meets_targets(spark, corpus):
    text = F.col("text")
    got = mixing.plan(frame(spark, corpus, True), Scratch(spark, "t"), mixing.n_words(text), mixing.letter_weight(text), bucket_rows=5).collect()
    again = mixing.plan(frame(spark, corpus), Scratch(spark, "t"), mixing.n_words(text), mixing.letter_weight(text), bucket_rows=500).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert len(got) == len(corpus) and all(0 <= r.taken <= 2 * r.size for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1
        assert own[0].source_size == sum(r.size for r in own)
    total = sum(r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * total)


def test_op1_rows_follow_the_plan(spark, corpus):
    docs = frame(spark, corpus)
    out = mixing.apply(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    plan = mixing.plan(docs, Scratch(spark, "t"), mixing.n_words(F.col("text")), mixing.letter_weight(F.col("text")), key=("doc_id",))
    want = {r.source: r.n for r in plan.groupBy("source").agg(F.first("target").alias("n")).collect()}
    for source, n in want.items():
        assert abs((got.get(source) or 0) - n) < 1


def test_first_words(spark):
    df = spark.createDataFrame([(" one  two three ", 2), ("one two", 1), ("one", 1)], "t string, n long")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" one  two", "one", "one"]


# -- sharding -------------------------------------------------------------------


@pytest.mark.parametrize("bucket_rows", [10, 100_000])
def test_op3_balance_slots_and_groups(spark, corpus, bucket_rows):
    rows = corpus + [(1000 + k, "the very same", "en", "s1", 0) for k in range(40)] + [(2000 + k, f"pair {k // 2}", "en", "s1", 0) for k in range(40)]
    got = sharding.shard(frame(spark, rows), Scratch(spark, "t"), bucket_rows=bucket_rows).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(r[0]) for r in rows)
    loads = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in loads.values())
    assert max(map(len, loads.values())) - min(map(len, loads.values())) <= 1
    by_id = {r.doc_id: r.shard for r in got}
    together = sum(by_id[2000 + k] == by_id[2001 + k] for k in range(0, 40, 2))
    assert together >= 16
    assert len({by_id[1000 + k] for k in range(40)}) <= 24


@pytest.mark.parametrize("bucket_rows", [100, 100_000])
@pytest.mark.parametrize("large", [0, 800])
def test_op3_when_every_text_has_a_copy(spark, large, bucket_rows):
    rows = [(k, "the very same" if k < large else f"pair {k // 2}", "en", "s1", 0) for k in range(2400)]
    got = {r.doc_id: r.shard for r in sharding.shard(frame(spark, rows), Scratch(spark, "t"), bucket_rows=bucket_rows).collect()}
    assert sorted(got) == list(range(2400)) and {list(got.values()).count(s) for s in range(24)} == {100}
    assert sum(got[k] != got[k + 1] for k in range(large, 2400, 2)) <= 23
    assert len({got[k] for k in range(large)}) == large // 100


def test_op3_assign_keeps_columns(spark, corpus):
    docs = frame(spark, corpus)
    out = sharding.assign(docs, Scratch(spark, "t"))
    assert out.columns == [*docs.columns, "shard", "slot"] and out.count() == len(corpus)


# -- decontamination --------------------------------------------------------------


@pytest.mark.parametrize("limit", [200_000, 0])
def test_op4_against_brute_force(spark, corpus, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", limit)
    texts = [r[1] or "" for r in corpus]
    items = [(1, " ".join(texts[-1].split()[3:30])), (2, "some Words"), (3, None), (4, "absent words of no document at all in this small corpus"), (5, "")]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER)))
    want = []
    for d, text, *_ in corpus:
        w, hit, found = split(text), set(), set()
        for item, item_text in items:
            iw = split(item_text)
            for win in {tuple(iw[i : i + 10]) for i in range(max(1, len(iw) - 9))} if iw else ():
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(str(item))
        want.append((d, len(w), len(hit), sorted(found), bool(hit)))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.flag(frame(spark, corpus).select("doc_id", "text"), df, Scratch(spark, "t")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=str) == sorted(want, key=str)
    kept = decontaminate.drop_contaminated(frame(spark, corpus, True), df, Scratch(spark, "t"))
    assert kept.count() == sum(not w[-1] for w in want)


# -- rules --------------------------------------------------------------------------


def test_op5_counts(spark):
    eight = "a b c d e f g h"
    text = f"{eight}\n{eight}\nA word.\nA word.\n\nmenu | home | about | help\n" + "plain words go on here in this line for a while and end. " * 1
    r = rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_dup_lines, r.n_repeat_words, r.n_symbols) == (2, 16, 3)
    assert r.base_failed and not r.kept and r.n_lines_failed >= 1


def test_op5_failed_lines_are_taken_out(spark):
    good = ["One plain line of words stands here.", "", "Ä second line of words ends well.", "And a third that says a few things more here."]
    text = "\n".join([good[0], "menu | home | about | help", good[1], "click here", good[2], "fragment", good[3]]) + "\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Fine."), (4, "fragment")], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.judge(docs, text=True).collect()}
    assert got[1].failed_lines == [1, 3, 5] and got[1].kept_text == "\n".join(good) + "\n" and got[1].n_lines_failed == 3
    assert [(got[k].failed_lines, got[k].kept_text) for k in (2, 3, 4)] == [([], ""), ([], "Fine."), ([0], "")]
    assert [(r.doc_id, r.text) for r in rules.clean(docs).collect()] == [(1, "\n".join(good) + "\n")]


def test_op5_odd_rows(spark):
    got = {(r.doc_id, r.n_words, r.kept) for r in rules.judge(frame(spark, ODD, True)).collect()}
    assert (1, 0, False) in got and (2, 0, False) in got and (5, 1, False) in got
    assert rules.judge(frame(spark, []).limit(0)).count() == 0


# -- chunks ---------------------------------------------------------------------------


def test_op6_cuts_cover_the_text_and_follow_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    ends = chunks.cut(data, 5, 32, 1024)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= 32 and sizes.max() <= 1024
    moved = chunks.cut(np.r_[np.array([65, 66, 67], np.uint8), data], 5, 32, 1024)
    assert len({e - 3 for e in moved} & set(ends)) > 0.9 * len(ends)


def test_op6_removes_later_copies_only(spark, corpus):
    got = {(r.doc_id, r.n_bytes): r for r in chunks.dedup(frame(spark, corpus, True), Scratch(spark, "t"), text=True).collect()}
    passage = [r for r in corpus if r[0] and 10 <= r[0] < 60 and r[0] % 7 == 0]
    later = [got[r[0], len(r[1].encode())] for r in passage[1:]]
    assert all(r.n_removed > 300 for r in later)
    first = got[passage[0][0], len(passage[0][1].encode())]
    assert first.n_removed == 0 and set(later[0].first_docs) == {passage[0][0]}
    alone = [got[r[0], len(r[1].encode())] for r in corpus if r[0] and 10 <= r[0] < 60 and r[0] % 7]
    assert all(r.n_removed == 0 and r.kept_text for r in alone)


def test_op6_a_short_passage_goes_whole(spark):
    rng = random.Random(11)
    own = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(120))
    rows, passages = [], []
    for k in range(60):
        passages.append(" ".join(own().split()[:51]))
        rows += [(2 * k, f"{own()} ä\n{passages[-1]}\nö {own()}", "en", "a", 0), (2 * k + 1, f"{own()} ü\n{passages[-1]}\nß {own()}", "en", "a", 0)]
    got = {r.doc_id: r for r in chunks.dedup(frame(spark, rows), Scratch(spark, "t"), text=True).collect()}
    whole = 0
    for k in range(60):
        assert got[2 * k].n_removed == 0 and passages[k] in got[2 * k].kept_text
        whole += got[2 * k + 1].n_removed >= len(passages[k])
    assert whole >= 57


def test_op6_a_lone_chunk_is_removed(spark):
    rng = np.random.default_rng(5)
    data = bytes(rng.integers(97, 123, 4000).astype(np.uint8))
    ends = chunks.cut(np.frombuffer(data, np.uint8), 5, 32, 1024)
    small = [(s, e) for s, e in zip(ends, ends[1:], strict=False) if e - s < 96]
    texts = [(s, e, b"Q" * 40 + data[s - 32 : e] + b"Z" * 40) for s, e in small]
    start, end, text = next(x for x in texts if {72, 72 + x[1] - x[0]} <= set(chunks.cut(np.frombuffer(x[2], np.uint8), 5, 32, 1024)))
    rows = [(1, data.decode(), "en", "a", 0), (2, text.decode(), "en", "a", 0)]
    got = {r.doc_id: r.n_removed for r in chunks.dedup(frame(spark, rows), Scratch(spark, "t")).collect()}
    assert got[1] == 0 and got[2] == 32 + end - start


# -- near duplicates ---------------------------------------------------------------------


def components_by_brute_force(rows, width, num, den):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().translate(low).split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    groups: dict[int, list] = {}
    for i, row in enumerate(rows):
        groups.setdefault(top(i), []).append(row[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(r[0], len(sets[i]), least[top(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_op7_against_brute_force(spark, corpus, width, num):
    got = minhash.components(frame(spark, corpus, True).select("doc_id", "text"), Scratch(spark, "t"), width, num, 100).collect()
    want = components_by_brute_force(corpus, width, num, 100)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)


def changed_copies(n, edits, seed, size=150):
    """Copies of one text that nobody has unchanged, each with so many words replaced."""
    rng = random.Random(seed)
    base = words(rng, size, 10**6)
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(1 + rng.randrange(edits)):
            w[rng.randrange(size)] = f"c{rng.randrange(10**6)}"
        out.append((k, " ".join(w), "en", "a", 0))
    return out


@pytest.mark.parametrize(("n", "edits", "width", "num"), [(500, 16, 3, 85), (500, 4, 5, 80), (300, 9, 3, 85)])
def test_op7_many_changed_copies(spark, n, edits, width, num, monkeypatch):
    rows = changed_copies(n, edits, n + edits)
    seen = []
    monkeypatch.setattr(minhash, "MOST_SERVED", 16)
    pairs_of = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *rest: (seen.append(pairs.count()), pairs_of(pairs, *rest))[1])
    got = minhash.components(frame(spark, rows).select("doc_id", "text"), Scratch(spark, "t"), width, num, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(components_by_brute_force(rows, width, num, 100))
    assert sum(seen) <= 4 * n  # of n * (n - 1) / 2 pairs


def test_op7_tells_thue_morse_words_apart(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, a, "en", "a", 0), (2, b, "en", "a", 0), (3, a, "en", "a", 0)]
    got = {r.doc_id: r.component_id for r in minhash.components(frame(spark, rows).select("doc_id", "text"), Scratch(spark, "t"), 3, 85, 100).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    docs = spark.createDataFrame([(1, f"{a}\n{b}\n{a}")], "doc_id long, text string")
    assert rules.judge(docs).first().n_dup_lines == 1
    texts = [f"{a}xx", f"yy{b}", f"zz{a[:700]}"]
    got = substrings.dedup(frame(spark, [(k, t, "en", "a", 0) for k, t in enumerate(texts)]), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == sorted((k, *w) for k, w in enumerate(removed_by_brute_force(texts, 400)))


def test_op7_of_nothing(spark):
    assert minhash.components(frame(spark, []).select("doc_id", "text"), Scratch(spark, "t"), 3, 85, 100).count() == 0


def test_op7_drop_copies_keeps_one(spark, corpus):
    out = minhash.drop_copies(frame(spark, corpus), Scratch(spark, "t"), 5, 80, 100)
    want = {w[2] for w in components_by_brute_force(corpus, 5, 80, 100)}
    assert {r.doc_id for r in out.select("doc_id").collect()} == want


# -- personal data -------------------------------------------------------------------------


def test_op8_spans(spark):
    texts = [
        "mail a.b@c.example or x@y.z.w, not @q",
        "at 10.0.0.1 and 999.1.1.1 and 1.2.3.4.5.6.7.8",
        "card 4111 1111 1111 1111 not 4111 1111 1111 1112",
        "call +49 (30) 1234-5678 or +12",
        "é😀 a@b.c_d@e.f",
        None,
        "1" * 5000 + " " + "a" * 5000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs, Scratch(spark, "t")).collect()}
    assert got[0] == "email:5:18,email:22:29"
    assert got[1] == "ip:3:11,ip:30:37,ip:38:45"
    assert got[2] == "card:5:24" and got[3] == "phone:5:23"
    assert got[4] == "email:3:8,email:8:14" and got[5] == "" and got[6] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, Scratch(spark, "t")).collect()}
    assert clean[0] == "mail [EMAIL] or [EMAIL], not @q" and clean[5] is None


def test_op8_terms_that_give_an_entity_away(spark):
    rows = [(k, f"filler{k} the agent Zorblax writes from zo@host.example today {k}") for k in range(6)]
    rows += [(100 + k, f"the people of town {k} write today as ever") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs, Scratch(spark, "t")).collect()}
    text = rows[0][1]
    at = text.index("Zorblax")
    assert f"term:{at}:{at + 7}" in got[0].split(",")
    assert "term" not in got[100] and f"term:{text.index('the')}" not in got[0]
    extra = docs.withColumn("text_hash", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("_text_hash", F.lit(None).cast("int"))
    cleaned = pii.sanitise(extra, Scratch(spark, "t"))
    assert cleaned.columns == extra.columns
    assert cleaned.filter("doc_id = 0").first().text == "0 the     [EMAIL] today 0"  # filler, agent, Zorblax, writes, from are in no other text
    assert cleaned.filter("doc_id = 100").first().text == rows[6][1]


def test_op8_terms_that_are_generalised(spark):
    rows = [(k, f"filler{k} signed: Zorblax at zo@host.example") for k in range(20)] + [(50, "a Zorblax elsewhere")]
    rows += [(100 + k, f"the people of town {k} signed at today as ever") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.sanitise(docs, Scratch(spark, "t"))
    assert out.filter("doc_id = 3").first().text == "3 signed: [Term] at [EMAIL]"
    assert out.filter("doc_id = 50").first().text == rows[20][1]


def test_op8_many_matches_and_nothing(spark):
    many = " ".join(f"u{k}@host.example" for k in range(3000))
    docs = spark.createDataFrame([(1, many), (2, many), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs, Scratch(spark, "t")).collect()}
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", many))
    assert got[1].spans == got[2].spans == want and got[1].n_email == 3000 and got[None].spans == ""
    assert pii.report(docs.limit(0), Scratch(spark, "t")).count() == 0


BASE_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_brute_force(text):
    """Spans of the contract's patterns, leftmost and non-overlapping for each kind."""
    out = []
    for order, (kind, pattern) in enumerate(BASE_KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def test_op8_base_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["a.b@c.de", "x@y", "@z.q", "+49 30 (12) 345-6789", "4111 1111 1111 1111", "10.2.3.4", "999.1.1.1", "1.2.3.4.5", "é", " ", "-", ".", "7", "\n", "word", "%", "+1", "5500-0000-0000-0004"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs, Scratch(spark, "t")).collect()}
    for k, text in rows:
        want = base_by_brute_force(text)
        assert ",".join(x for x in got[k].spans.split(",") if x and not x.startswith("term")) == want, text
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def terms_by_brute_force(rows, alpha, support):
    """text -> disclosing words, by the formula over distinct texts."""
    texts = {t or "" for _, t in rows}
    entity = {t: {f"{k}:{m.lower()}" if k in ("email", "ip") else f"{k}:{re.sub('[^0-9]', '', m)}" for k, m in ((x.split(":")[0], t[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in base_by_brute_force(t).split(",") if x)} for t in texts}
    term = {t: set(re.findall("[A-Za-z\x80-\U0010FFFF]{3,}", t.lower())) for t in texts}
    out = {t: set() for t in texts}
    for e in set().union(*entity.values()):
        holders = [t for t in texts if e in entity[t]]
        for w in set().union(*(term[t] for t in holders)):
            both, ct = sum(w in term[t] for t in holders), sum(w in term[t] for t in texts)
            ic = np.log2(len(texts) / len(holders))
            if both >= support and len(holders) >= support and ic > 0 and np.log2(both * len(texts) / (len(holders) * ct)) >= alpha * ic:
                for t in holders:
                    out[t] |= {w} & term[t]
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_op8_terms_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(pii, "MOST_BROADCAST", limit)
    rng = random.Random(4)
    rows = []
    for k in range(300):
        text = " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(8))}" for _ in range(rng.randrange(30)))
        if k % 3 == 0:
            e = rng.randrange(12)
            text += f" u{e}@host.example " + (f"Name{chr(97 + e)}" if rng.random() < 0.9 else "")
        rows += [(k, text)] * (1 + (k % 10 == 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs, Scratch(spark, "t")).collect()}
    want = terms_by_brute_force(rows, 0.9, 3)
    some = 0
    for k, text in rows:
        base = [(int(x.split(":")[1]), int(x.split(":")[2])) for x in base_by_brute_force(text).split(",") if x]
        spans = [(m.start(), m.end()) for m in re.finditer("[A-Za-z\x80-\U0010FFFF]{3,}", text) if m[0].lower() in want[text]]
        spans = [s for s in spans if not any(b[0] < s[1] and s[0] < b[1] for b in base)]
        assert [x for x in got[k].split(",") if x.startswith("term")] == [f"term:{s}:{e}" for s, e in spans]
        some += len(spans)
    assert some > 50


@pytest.mark.parametrize("near", [0, 2])
def test_op8_terms_far_from_their_entity(spark, near):
    rows = []
    for k in range(12):
        gap = "" if k < near else " ".join(f"f{k}x{i}" for i in range(60))
        rows.append((k, f"zo@host.example {gap} signed: Zorblax"))
    rows += [(100 + k, f"the people of town {k} signed today as ever") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs, Scratch(spark, "t")).collect()}
    for k, text in rows[:12]:
        at = text.index("Zorblax")
        assert got[k] == f"email:0:15,term:{at}:{at + 7}"
    assert not any(got[100 + k] for k in range(200))


# -- classifier ------------------------------------------------------------------------------


def test_op9_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = classifier.score(docs.select("doc_id", "text"), labels, Scratch(spark, "t"))
    rows = scored.join(labels, "doc_id").filter(classifier.held_out(F.col("doc_id"))).select("quality", "predicted").collect()
    assert len(rows) > 50 and sum(r.quality == r.predicted for r in rows) / len(rows) > 0.95


def test_op9_without_labels_and_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = classifier.score(frame(spark, ODD, True), labels, Scratch(spark, "t")).collect()
    assert {r[-2] for r in got} == {0.5} and len(got) == len(ODD)


# -- archives -----------------------------------------------------------------------------------


def test_op10_round_trip(spark, tmp_path):
    big, small = "é" * 700, "small"
    rows = [(k, f"http://h/{k}", big if k % 3 == 0 else small if k % 3 == 1 else f"<p>{k}</p>" * 400) for k in range(30)] + [(30, None, None), (31, "http://h/a b", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/one"
    manifest = warc.write(pages, path, shard_bytes=4000, roll=1000)
    assert manifest.count() > 3
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        r, raw = got[page_id], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(raw), hashlib.sha1(raw).hexdigest(), url)
        if html == big and page_id != 27:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 27, None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
    other = warc.write(pages.repartition(7), f"file://{tmp_path}/two", shard_bytes=4000, roll=1000)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, other.collect()))


@pytest.mark.parametrize("ids", [[-(2**63), *range(50), 2**63 - 1], [*range(1000), 2**62], [5] * 60, [None, None, -7, 3, 3]])
def test_op10_any_ids(spark, tmp_path, ids):
    rows = [(p, f"http://h/{k}", f"{k} " * 700) for k, p in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("x")).withColumn("size", F.lit(1))
    manifest = warc.write(pages, f"file://{tmp_path}/x", shard_bytes=20_000, roll=5_000).collect()
    got = warc.read(spark, f"file://{tmp_path}/x").collect()
    assert sorted((str(r.page_id), r.url, bytes(r.payload)) for r in got) == sorted((str(p), u, h.encode()) for p, u, h in rows)
    shards = {}
    for r in manifest:
        shards[r.shard] = shards.get(r.shard, 0) + r.records
    if len(set(ids)) > 10:
        assert max(shards.values()) <= 20  # about 2.5 KB a page, also beside an outlier
    raw = b"".join(gzip.open(f"{tmp_path}/x/data/{r.file}").read() for r in manifest)
    names = re.findall(rb"WARC-Record-ID: (<urn:x-page:.*>)", raw)
    assert len(names) == len(set(names)) == len(rows)


def test_op10_a_missing_or_altered_file_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(k, None, f"{k} " * 500) for k in range(60)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/x"
    first = warc.write(pages, path, shard_bytes=10_000, roll=500).orderBy("file").first()
    assert warc.read(spark, path).count() == 60
    file = tmp_path / "x" / "data" / first.file
    raw = file.read_bytes()
    file.write_bytes(raw[:-1] + b"x")
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read(spark, path).count()
    file.unlink()
    with pytest.raises(Exception, match="is missing"):
        warc.read(spark, path).count()
    warc.write(pages, path, shard_bytes=10_000, roll=500)  # a second run puts back what is gone
    assert warc.read(spark, path).count() == 60


def test_op10_rolls_on_plain_size(spark, tmp_path):
    pages = spark.createDataFrame([(k, None, "a" * 100_000) for k in range(20)], "page_id long, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/x", least=10**9, roll=20_000).collect()
    assert len(manifest) > 4 and warc.read(spark, f"file://{tmp_path}/x").count() == 20


def test_op10_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
