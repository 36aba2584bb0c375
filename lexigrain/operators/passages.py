"""Cadence of whole documents: sentences inside typed blocks, their beat and landing, and where the text runs even.

A document is a row, and one Arrow kernel measures it: no exchange. Sentences
become integer arrays, and every pattern is a flag over them whose runs never
leave a stretch of prose that headings, lists, code, quotes or tables do not
interrupt. Thresholds are the document's own percentiles.

Words are runs of letters; the ending of a contraction is no word of its own.
Stress comes from ``stress`` (word: a 0 or 1 for each syllable), else the first
syllable of a longer word has it and a single syllable has it in nouns, verbs,
adjectives, adverbs and numbers. A null or empty text has no sentences and a
summary of zeros; a skeleton is compared whole, however long the sentence.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.functions import lexicon as X
from lexigrain.operators.annotate import _BREAK, _PROTECT, classed
from lexigrain.operators.cadence import BLOCK_TYPES, blocks_of
from lexigrain.operators.rhythm import syllables
from lexigrain.storage import spread

# Sentences of a window and of the shortest runs, limits on likeness, and how many prose sentences
# a document needs before anything but emphasis is located in it.
WINDOW, FLAT, LENGTHS, REPEATS, EVEN = 5, 5, 4, 3, 4
ALIKE, LEAST_SKELETON, DENSE, LEAST_PROSE, LEAST_PARAGRAPHS = 0.2, 6, 3, 8, 6
# Marks of a pause, classes with stress and with content, words that open on something said before.
_PAUSE = regex.compile(r"--|[,;:()—–…]|-(?=\s)")
STRESSED = frozenset("NOUN VERB ADJ ADV NUM".split())
CONTENT = frozenset("NOUN VERB ADJ".split())
REFERRING = frozenset("this that these those such it they he she we its their his her them there".split())
MARKERS = frozenset(X.SUBORDINATORS + X.CONJUNCT_COORDINATORS + ["because", "but", "or", "who", "whom", "whose", "which"])
#: The pattern detectors, in the order in which ``find`` gives them.
PATTERNS = (
    "flat_stretch", "long_run", "short_run", "disconnected_run", "repeated_structure", "repeated_terminology",
    "dense_relations", "emphasis_point", "short_paragraph", "even_paragraphs",
)
PROSE, WHOLE = 0, frozenset((1, 3, 5))
_WORD = regex.compile(r"(?<!\p{L}['’])\p{L}+")
_EPS = 1e-9


class Sentence(NamedTuple):
    """A sentence with at least one word; offsets in characters of the text."""

    block: int
    type: int
    start: int
    end: int
    words: list[str]
    classes: list[str]
    lemmas: list[str]
    spans: list[tuple[int, int]]
    phrases: list[int]
    pauses: list[float]
    stresses: list[int]
    skeleton: list[str]


def sentence_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Where the sentences of a stretch of the text begin and end; the blanks between two belong to neither."""
    stretch = _PROTECT.sub("\\1\\2\x02", text[start:end])
    cuts = [(m.end(1), m.start(2)) for m in _BREAK.finditer(stretch)]
    return [(start + a, start + b) for a, b in zip([0, *(n for _, n in cuts)], [*(e for e, _ in cuts), len(stretch)], strict=True)]


def beats(word: str, c: str, stress: dict[str, list[int]]) -> list[int]:
    """0 or 1 for each syllable of a lower-case word."""
    known = stress.get(word)
    if known and len(known) > 1:
        return known
    n = len(known) if known else syllables(word)
    return [int(c in STRESSED)] if n == 1 else [1] + [0] * (n - 1)


def _sentence(text: str, block: int, kind: int, start: int, end: int, stress: dict[str, list[int]]) -> Sentence:
    body = text[start:end]
    found = [(m[0].lower(), m.span()) for m in _WORD.finditer(body)]
    words = [w for w, _ in found]
    marks = [m for m in _PAUSE.finditer(body) if m[0] != "…" or found[-1][1][1] > m.start()]
    classes, lemmas, beat, phrases, skeleton, pauses = [], [], [], [0], [], []
    at = 0
    for k, (word, (a, _)) in enumerate(found):
        while at < len(marks) and marks[at].start() < a:
            pauses.append(round(k / len(found), 2))
            skeleton.append(marks[at][0])
            if marks[at][0] != "…":
                phrases.append(0)
            at += 1
        c, low = classed(word)
        own = beats(word, c, stress)
        classes.append(c)
        lemmas.append(low)
        beat += own
        phrases[-1] += len(own)
        skeleton.append(word if word in MARKERS or c == "CONJ" else c)
    pauses += [1.0] * (len(marks) - at)
    return Sentence(block, kind, start, end, words, classes, lemmas, [(start + a, start + b) for _, (a, b) in found], [p for p in phrases if p], pauses, beat, skeleton)


def sentences_of(text: str, stress: dict[str, list[int]] | None = None) -> list[Sentence]:
    """The sentences of a text, each in one block; headings, code and tables are one each, and a wordless one joins the one before it."""
    out = []
    for block, (kind, start, end) in enumerate(blocks_of(text)):
        spans: list[list[int]] = []
        for a, b in [(start, end)] if kind in WHOLE else sentence_spans(text, start, end):
            if spans and not _WORD.search(text, a, b):
                spans[-1][1] = b
            else:
                spans.append([a, b])
        out += [_sentence(text, block, kind, a, b, stress or {}) for a, b in spans if _WORD.search(text, a, b)]
    return out


def distance(a: list, b: list) -> float:
    """Edits from a to b as a share of the longer one; a row of the table at once."""
    if a == b:
        return 0.0
    ids = {x: k for k, x in enumerate({*a, *b})}
    x, y, steps = [ids[i] for i in a], np.array([ids[i] for i in b], np.int64), np.arange(len(b) + 1)
    row = steps.copy()
    for i, symbol in enumerate(x, 1):
        best = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (y != symbol))))
        row = np.minimum.accumulate(best - steps) + steps
    return float(row[-1]) / max(len(a), len(b))


def opening_similarity(a: Sentence, b: Sentence) -> float:
    """1 if the first two words agree in lemma and class, one half if only the first does."""
    first, second = (list(zip(s.lemmas[:2], s.classes[:2], strict=True)) for s in (a, b))
    return 0.0 if first[0] != second[0] else 1.0 if len(first) == 2 and first == second else 0.5


def _opens_alike(a: Sentence, b: Sentence) -> tuple[bool, bool]:
    """Do they open alike, and with a noun? A function word takes the next word too."""
    n = 1 if a.classes[0] in CONTENT or a.classes[0] == "ADV" else 2
    first, second = (list(zip(s.lemmas[:n], s.classes[:n], strict=True)) for s in (a, b))
    same = first == second and len(first) == n
    return same, same and first[-1][1] == "NOUN"


def runs(flags: np.ndarray, part: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and last place of the maximal runs of flags inside one part, of ``least`` places or more."""
    if not len(flags):
        return []
    begins = flags & np.concatenate(([True], ~flags[:-1] | (part[1:] != part[:-1])))
    ends = flags & np.concatenate((~flags[1:] | (part[1:] != part[:-1]), [True]))
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(begins), np.flatnonzero(ends), strict=True) if b - a + 1 >= least]


def cv(values: np.ndarray) -> float:
    mean = values.mean() if len(values) > 1 else 0.0
    return float(values.std() / mean) if mean else 0.0


def local_cv(values: np.ndarray, part: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts and coefficients of variation of the full windows that stay in one part."""
    if len(values) < width:
        return np.empty(0, int), np.empty(0)
    windows = np.lib.stride_tricks.sliding_window_view(values, width)
    starts = np.flatnonzero(part[: len(windows)] == part[width - 1 :])
    mean, sd = windows[starts].mean(axis=1), windows[starts].std(axis=1)
    return starts, np.divide(sd, mean, out=np.zeros(len(starts)), where=mean != 0)


def moving_cv(values: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """One coefficient for each value, of the window around it; at the edges the window moves inward."""
    width = min(width, len(values))
    starts = np.clip(np.arange(len(values)) - width // 2, 0, len(values) - width)
    return np.array([cv(values[s : s + width]) for s in starts])


class Prose:
    """The prose sentences of a document as arrays, and its thresholds."""

    def __init__(self, sentences: list[Sentence], stop: frozenset[str]):
        self.at = np.array([k for k, s in enumerate(sentences) if s.type == PROSE], int)
        self.own = [sentences[k] for k in self.at]
        self.length = np.array([len(s.words) for s in self.own], float)
        #: The stretch of uninterrupted prose that a sentence is in.
        self.part = np.cumsum(np.concatenate(([0], np.diff(self.at) != 1))) if len(self.at) else np.empty(0, int)
        self.starts, self.cvs = local_cv(self.length, self.part)
        content = [frozenset(low for w, c, low in zip(s.words, s.classes, s.lemmas, strict=True) if c in CONTENT and w not in stop) for s in sentences]
        shared = [None, *(len(b & a) / len(b) if b else 0.0 for a, b in zip(content, content[1:]))]
        self.overlaps = shared[: len(sentences)]
        self.limits: dict[str, float] = {}
        if len(self.own):
            varied = self.cvs if len(self.cvs) else moving_cv(self.length)
            known = [self.overlaps[k] for k in self.at if self.overlaps[k] is not None]
            self.limits = {n: float(np.percentile(self.length, q)) for n, q in (("p10", 10), ("p25", 25), ("median", 50), ("p75", 75), ("p90", 90))}
            self.limits |= {"local_cv_p20": float(np.percentile(varied, 20)), "local_cv_median": float(np.percentile(varied, 50))}
            self.limits["overlap_p25"] = float(np.percentile(known, 25)) if known else 0.0


def _paragraphs(sentences: list[Sentence]) -> list[tuple[int, int, int]]:
    """(block, words, sentences) of the prose blocks."""
    totals: dict[int, list[int]] = {}
    for s in sentences:
        if s.type == PROSE:
            entry = totals.setdefault(s.block, [0, 0])
            entry[0] += len(s.words)
            entry[1] += 1
    return [(b, n, k) for b, (n, k) in totals.items()]


def alone(sentences: list[Sentence]) -> tuple[list[bool], list[bool]]:
    """Which sentences end their block, and which are all of it."""
    block = [-1, *(s.block for s in sentences), -1]
    last = [a != b for a, b in zip(block[1:-1], block[2:], strict=True)]
    return last, [e and a != b for e, a, b in zip(last, block[:-2], block[1:-1], strict=True)]


def find(sentences: list[Sentence], stop: frozenset[str] = frozenset(), prose: Prose | None = None) -> list[tuple[str, int, int, float]]:
    """(pattern, first, last, value): sentences by their place in the text, for the last two patterns blocks.

    The value is the run's own variation (flat stretches, even paragraphs), the
    mean likeness of skeletons (repeats), the number of markers (dense) or the
    median of the neighbours' lengths (emphasis; null with fewer than two).
    """
    p = prose or Prose(sentences, stop)
    n, size, part, limit = len(p.own), p.length, p.part, p.limits
    out: list[tuple[str, int, int, float | None]] = []

    def add(kind: int, spans, value=lambda a, b: None) -> None:
        out.extend((PATTERNS[kind], int(p.at[a]), int(p.at[b]), value(a, b)) for a, b in spans)

    if n >= LEAST_PROSE:
        markers = np.array([sum(w in MARKERS for w in s.words) for s in p.own])
        bound = 0.5 * limit["local_cv_median"] + _EPS
        even = p.starts[p.cvs <= min(limit["local_cv_p20"] + _EPS, bound)]
        cover = np.cumsum(np.bincount(even, minlength=n + WINDOW)[:n] - np.bincount(even + WINDOW, minlength=n + WINDOW)[:n])
        add(0, [(a, b) for a, b in runs(cover > 0, part, FLAT) if cv(size[a : b + 1]) <= bound], lambda a, b: cv(size[a : b + 1]))
        short = size <= limit["p25"] + _EPS
        add(1, runs(size >= limit["p75"] - _EPS, part, LENGTHS))
        add(2, runs(short, part, LENGTHS))
        tied = np.array([(p.overlaps[k] or 0.0) > limit["overlap_p25"] + _EPS or s.words[0] in REFERRING for k, s in zip(p.at, p.own, strict=True)])
        loose = short & (markers == 0)
        for k in range(1, n):  # a tie only counts to a sentence that is loose itself
            loose[k] &= not (tied[k] and loose[k - 1] and part[k] == part[k - 1])
        add(3, runs(loose, part, REPEATS))
        near = part[1:] == part[:-1]
        likeness = np.array([1 - distance(a.skeleton, b.skeleton) if ok else 0.0 for ok, a, b in zip(near, p.own, p.own[1:])])
        opens = [_opens_alike(a, b) for a, b in zip(p.own, p.own[1:])]
        full = np.array([len(s.skeleton) >= LEAST_SKELETON for s in p.own])
        alike = near & full[1:] & full[:-1] & (1 - likeness <= ALIKE + _EPS)
        terms = [frozenset(low for w, c, low in zip(s.words[:3], s.classes, s.lemmas, strict=False) if c == "NOUN" and w not in stop) for s in p.own]
        same = near & np.array([bool(a & b) for a, b in zip(terms, terms[1:])])
        framed = near & np.array([o and not noun for o, noun in opens])
        pairs = lambda flags: [(a, b + 1) for a, b in runs(flags, part[:-1], REPEATS - 1)]
        mean = lambda a, b: float(likeness[a:b].mean())
        add(4, pairs(alike | framed), mean)
        add(5, pairs(same & ~alike), mean)
        dense = np.flatnonzero((size >= limit["p90"] - _EPS) & (markers >= DENSE))
        add(6, [(k, k) for k in dense], lambda a, _: float(markers[a]))
    _, single = alone(sentences)
    for k in range(n):
        around = np.concatenate((size[max(0, k - 3) : k], size[k + 1 : k + 4]))
        middle = float(np.median(around)) if len(around) > 1 else None
        if (middle is not None and size[k] <= 0.5 * middle) or (single[p.at[k]] and size[k] <= limit["median"]):
            add(7, [(k, k)], lambda a, b, m=middle: m)
    paras = _paragraphs(sentences)
    if n >= LEAST_PROSE and len(paras) >= 3:
        block, words, count = (np.array(x) for x in zip(*paras, strict=True))
        least = np.minimum(words[:-2], words[2:])
        inner = (count[1:-1] > 1) & (block[2:] - block[:-2] == 2) & (words[1:-1] <= 0.5 * least) & (least >= np.percentile(words, 50))
        out += [(PATTERNS[8], int(b), int(b), None) for b in block[1:-1][inner]]
        spread_ = cv(words)
        if len(paras) >= LEAST_PARAGRAPHS and spread_ > 0:
            windows = len(words) - EVEN + 1
            level = np.array([cv(words[k : k + EVEN]) <= 0.35 * spread_ and block[k + EVEN - 1] - block[k] == EVEN - 1 for k in range(windows)])
            free = 0
            for a, b in runs(level, np.zeros(windows, int), 1):
                if (a := max(a, free)) <= b:
                    free = b + EVEN
                    out.append((PATTERNS[9], int(block[a]), int(block[free - 1]), cv(words[a:free])))
    return out


def _share(flags) -> float:
    return float(np.mean(flags)) if len(flags) else 0.0


def summarise(text: str, sentences: list[Sentence], prose: Prose, found: list[tuple]) -> dict:
    """One document's numbers; medians of nothing are null."""
    own = prose.own
    stream = np.array([x for s in own for x in s.stresses], int)
    gaps = np.diff(np.flatnonzero(stream))
    after = [len(s.stresses) - 1 - max((k for k, x in enumerate(s.stresses) if x), default=-1) for s in own]
    sizes: dict[int, list[int]] = {}
    for s in own:
        sizes.setdefault(s.block, []).append(len(s.stresses))
    groups = [(v, float(np.median(v))) for v in sizes.values() if len(v) >= 3]
    landing = lambda place: float(np.median([v[place] / m for v, m in groups if m])) if any(m for _, m in groups) else None
    kinds = {s.block: s.type for s in sentences}
    flat = sum(b - a + 1 for kind, a, b, _ in found if kind == PATTERNS[0])
    return {
        "sentences": len(sentences),
        "prose_sentences": len(own),
        "paragraphs": len(kinds),
        "words": sum(len(s.words) for s in sentences),
        "prose_words": int(prose.length.sum()),
        "syllables": len(stream),
        "stresses": int(stream.sum()),
        "type_counts": [list(kinds.values()).count(k) for k in range(len(BLOCK_TYPES))],
        "clash": _share(gaps == 1),
        "alternation": _share((gaps == 2) | (gaps == 3)),
        "lapse": _share(gaps >= 4),
        "ending_stressed": _share([s.stresses[-1] for s in own]),
        "endings": [_share([min(x, 2) == k for x in after]) for k in range(3)],
        "landing_paragraphs": len(groups),
        "final_ratio": landing(-1),
        "initial_ratio": landing(0),
        "flat_share": flat / len(own) if own else 0.0,
        "one_line_paragraphs": text.count("\n") > 1 and not regex.search(r"\n[ \t]*\n", text),
        "computed": len(own) >= LEAST_PROSE,
        **{k: prose.limits.get(k) for k in ("p10", "p25", "median", "p75", "p90", "local_cv_p20", "local_cv_median")},
    }


def rows_of(sentences: list[Sentence], prose: Prose) -> list[dict]:
    """The columns of each sentence; what compares looks at the sentence before, whatever its type."""
    last, single = alone(sentences)
    out, phrase = [], 0
    for k, s in enumerate(sentences):
        before = sentences[k - 1] if k else None
        stressed = [i for i, x in enumerate(s.stresses) if x]
        out.append({
            "block": s.block, "type": s.type, "start": s.start, "end": s.end, "words": len(s.words), "syllables": len(s.stresses), "stresses": len(stressed),
            "final_stress_offset": min(2, len(s.stresses) - 1 - (stressed[-1] if stressed else -1)), "phrase_start": phrase, "phrases": len(s.phrases),
            "pauses": s.pauses, "markers": sum(w in MARKERS for w in s.words), "overlap": prose.overlaps[k],
            "opening_similarity": opening_similarity(before, s) if before else None, "skeleton_similarity": 1 - distance(before.skeleton, s.skeleton) if before else None,
            "opens_with_reference": s.words[0] in REFERRING, "is_final": last[k], "is_standalone": single[k],
        })
        phrase += len(s.phrases)
    return out


def _struct(fields: str) -> T.StructType:
    return T._parse_datatype_string(fields)


_SENTENCE = (
    "block int, type int, start int, end int, words long, syllables long, stresses long, final_stress_offset int, phrase_start long, phrases long, "
    "pauses array<double>, markers long, overlap double, opening_similarity double, skeleton_similarity double, opens_with_reference boolean, is_final boolean, is_standalone boolean"
)
_PATTERN = "pattern string, first int, last int, value double"
_SUMMARY = (
    "sentences long, prose_sentences long, paragraphs long, words long, prose_words long, syllables long, stresses long, type_counts array<long>, clash double, alternation double, "
    "lapse double, ending_stressed double, endings array<double>, landing_paragraphs long, final_ratio double, initial_ratio double, flat_share double, one_line_paragraphs boolean, "
    "computed boolean, p10 double, p25 double, median double, p75 double, p90 double, local_cv_p20 double, local_cv_median double"
)


def _kernel(build, fields: str, many: bool, stop: frozenset[str], stress: dict[str, list[int]] | None):
    """An Arrow UDF: ``build(text, sentences, prose)`` of each document as a struct, or an array of them."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = T.ArrayType(_struct(fields)) if many else _struct(fields)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            sentences = sentences_of(text or "", stress)
            out.append(build(text or "", sentences, Prose(sentences, stop)))
        return pa.array(out, arrow)

    return run("text")


def block_sentences(docs: DataFrame, stop: frozenset[str] = frozenset(), stress: dict[str, list[int]] | None = None) -> DataFrame:
    """(doc_id, sent, block, type, start, end, words, ...): a row for each sentence with a word, in order of the text."""
    build = lambda text, sentences, prose: rows_of(sentences, prose)
    rows = spread(docs).select("doc_id", F.posexplode(_kernel(build, _SENTENCE, True, stop, stress)).alias("sent", "s"))
    return rows.select("doc_id", "sent", "s.*")


def patterns(docs: DataFrame, stop: frozenset[str] = frozenset(), stress: dict[str, list[int]] | None = None) -> DataFrame:
    """(doc_id, pattern, first, last, value): what ``find`` finds in each document."""
    build = lambda text, sentences, prose: [dict(zip(("pattern", "first", "last", "value"), r, strict=True)) for r in find(sentences, stop, prose)]
    return spread(docs).select("doc_id", F.explode(_kernel(build, _PATTERN, True, stop, stress)).alias("p")).select("doc_id", "p.*")


def summary(docs: DataFrame, stop: frozenset[str] = frozenset(), stress: dict[str, list[int]] | None = None) -> DataFrame:
    """(doc_id, ...): ``summarise`` of each document, one row each."""
    build = lambda text, sentences, prose: summarise(text, sentences, prose, find(sentences, stop, prose))
    return spread(docs).select("doc_id", _kernel(build, _SUMMARY, False, stop, stress).alias("s")).select("doc_id", "s.*")
