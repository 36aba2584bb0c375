"""The per-document measures as one Arrow kernel over whole batches.

A batch's words become three integer arrays (word, sentence, document); each
distinct word is classed once a worker. Every measure is then counting over
integers for all documents of the batch at once: no nested column of strings
leaves the worker, and one pass gives all families. The plan is scan, kernel,
write, without an exchange.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexigrain.functions import lexicon as X
from lexigrain.operators import annotate as A
from lexigrain.storage import spread

CODES = {c: k for k, c in enumerate(("NOUN", "VERB", "ADJ", "ADV", "DET", "PRON", "AUX", "CONJ", "ADP", "NUM"))}
#: Characters of a block of texts, whose words are held at once; a longer text is a block of its own.
MOST_CHARS = 1 << 21
#: Words that a worker remembers.
MOST_WORDS = 500_000
_LETTERS, _ODD = re.compile(r"[^\W\d_]+"), regex.compile(r"[\p{Nl}\p{No}]")
_STOPS = regex.compile(r"[.!?…]")


class Vocabulary(dict):
    """Word to number; the arrays tell its class, its lemma's number and in which sets it (for third persons, its lemma) is."""

    def __init__(self, sets: dict[str, frozenset]):
        super().__init__()
        self.sets, self.lemmas = sets, {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 2 + len(sets)), np.int64)

    def __missing__(self, word: str) -> int:
        c, lemma = A.classed(word)
        self.rows.append((CODES[c], self.lemmas.setdefault(lemma, len(self.lemmas)), *((lemma if name == "third" else word) in s for name, s in self.sets.items())))
        self[word] = len(self)
        return self[word]

    def column(self, name: str) -> np.ndarray:
        if len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows, np.int64).reshape(len(self.rows), -1)])
            self.rows = []
        return self.table[:, {"class": 0, "lemma": 1}.get(name, 2 + list(self.sets).index(name) if name in self.sets else 0)]


class Words:
    """The words of a block of texts: word number, class, lemma, sentence; sentences and paragraphs with their documents."""

    def __init__(self, texts: Sequence[str | None], vocabulary: Vocabulary):
        found: list[str] = []
        per_sentence, per_paragraph, per_doc = [], [], []
        for text in texts:
            n = 0
            for line in (text or "").split("\n"):
                line = line.strip(A._BLANK)
                if not line:
                    continue
                n += 1
                sentences = A.sentence_texts(line) if _STOPS.search(line) else [line]
                per_paragraph.append(len(sentences))
                for s in sentences:
                    s = s.lower()
                    own = A._WORDS.findall(s) if not s.isascii() and _ODD.search(s) else _LETTERS.findall(s)
                    per_sentence.append(len(own))
                    found += own
            per_doc.append(n)
        self.n = len(texts)
        self.word = np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found))
        self.paragraph_doc = np.repeat(np.arange(self.n), np.array(per_doc, np.int64))
        self.sentence_paragraph = np.repeat(np.arange(len(per_paragraph)), np.array(per_paragraph, np.int64))
        self.sentence = np.repeat(np.arange(len(per_sentence)), np.array(per_sentence, np.int64))
        self.sentence_doc = self.paragraph_doc[self.sentence_paragraph]
        self.doc = self.sentence_doc[self.sentence]
        self.paragraph = self.sentence_paragraph[self.sentence]
        self.vocabulary = vocabulary
        self.c, self.lemma = vocabulary.column("class")[self.word], vocabulary.column("lemma")[self.word]

    def flag(self, name: str) -> np.ndarray:
        return self.vocabulary.column(name)[self.word] > 0

    def member(self, name: str) -> np.ndarray:
        """Which words are in one of the classes of ``lexicon.CLASSES``."""
        content = self.c < 4
        if name in ("noun", "verb", "adj", "adv"):
            return self.c == CODES[name.upper()]
        return {"all": np.ones_like(content), "content": content, "function": ~content}[name] if name not in ("prp", "argument") else self.flag("prp") | ((self.c == 0) & (name == "argument"))

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[mask], minlength=self.n)

    def distinct(self, values: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """How many different values the masked words of each document have."""
        if not mask.any():
            return np.zeros(self.n, np.int64)
        size = int(values.max()) + 1
        return np.bincount(np.unique(self.doc[mask] * size + values[mask]) // size, minlength=self.n)

    def repeated(self, values: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """How many masked words of each document have a value that another one has too."""
        if not mask.any():
            return np.zeros(self.n, np.int64)
        size = int(values.max()) + 1
        keys, times = np.unique(self.doc[mask] * size + values[mask], return_counts=True)
        return np.bincount(keys // size, np.where(times > 1, times, 0), self.n)

    def next_class(self) -> np.ndarray:
        """The class of the next word of the sentence, -1 at its end."""
        out = np.full(len(self.c), -1)
        out[:-1] = np.where(self.sentence[1:] == self.sentence[:-1], self.c[1:], -1)
        return out


def per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, and 0 where b is 0."""
    return np.where(b == 0, 0.0, a / np.where(b == 0, 1, b))


def basic(w: Words) -> dict[str, np.ndarray]:
    kept = ~w.flag("stop")
    tokens, types = w.count(kept), w.distinct(w.word, kept)
    length = np.bincount(w.sentence, minlength=len(w.sentence_doc))
    own, length = w.sentence_doc[length > 0], length[length > 0]
    n = np.bincount(own, minlength=w.n)
    mean = per(np.bincount(own, length, w.n), n)
    sd = np.sqrt(per(np.bincount(own, (length - mean[own]) ** 2, w.n), n))
    return {
        "n_tokens": tokens,
        "n_types": types,
        "n_sentences": np.bincount(w.sentence_doc, minlength=w.n),
        "type_token_ratio": types / np.maximum(tokens, 1),
        "sent_len_mean": mean,
        "sent_len_std": sd,
        "sent_len_cv": np.where(n > 0, sd / (mean + 1e-8), 0.0),
    }


def moving_ttr(w: Words, mask: np.ndarray, width: int) -> np.ndarray:
    """Mean type-token ratio of all windows of ``width`` masked words; the plain ratio of texts that have no more words.

    A word counts in those windows that hold it and not its last occurrence before it.
    """
    doc, lemma = w.doc[mask], w.lemma[mask]
    n = np.bincount(doc, minlength=w.n)
    begin = np.cumsum(n) - n
    j = np.arange(len(doc)) - begin[doc]
    order = np.lexsort((j, lemma, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (lemma[order][1:] == lemma[order][:-1])
    before = np.full(len(doc), -1)
    before[order[1:][same]] = j[order[:-1][same]]
    windows = np.minimum(j, n[doc] - width) - np.maximum(np.maximum(j - width + 1, before + 1), 0) + 1
    total = np.bincount(doc, np.maximum(windows, 0), w.n)
    plain = per(w.distinct(w.lemma, mask), n)
    return np.where(n <= width, plain, total / (width * np.maximum(n - width + 1, 1)))


def diversity(w: Words, width: int = 50) -> dict[str, np.ndarray]:
    masks = {name: w.member(name) for name in X.CLASSES}
    count = {k: w.count(m) for k, m in masks.items()}
    types = {k: w.distinct(w.lemma, m) for k, m in masks.items()}
    out = {
        "lemma_ttr": per(types["all"], count["all"]),
        "lemma_mattr": moving_ttr(w, masks["all"], width),
        "function_mattr": moving_ttr(w, masks["function"], width),
        "lexical_density_tokens": per(count["content"], count["all"]),
        "lexical_density_types": per(types["content"], types["all"]),
    }
    for name in ("content", "function", "noun", "verb", "adj", "adv", "prp", "argument"):
        out[f"{name}_ttr"] = per(types[name], count[name])
    gram = w.lemma
    for k, name in ((1, "bigram"), (2, "trigram")):
        # pairs of (n-1)-gram and lemma, numbered anew
        gram = gram[: max(len(w.lemma) - k, 0)] * (int(w.lemma.max(initial=0)) + 1) + w.lemma[k:]
        gram = np.unique(gram, return_inverse=True)[1]
        whole = w.doc[: len(gram)] == w.doc[k : k + len(gram)]
        n = np.bincount(w.doc[: len(gram)][whole], minlength=w.n)
        size = int(gram.max(initial=0)) + 1
        out[f"{name}_lemma_ttr"] = per(np.bincount(np.unique(w.doc[: len(gram)][whole] * size + gram[whole]) // size, minlength=w.n), n)
    return out


def givenness(w: Words) -> dict[str, np.ndarray]:
    n, third = w.count(w.c >= 0), w.flag("third")
    alone = w.flag("demonstrative") & ~np.isin(w.next_class(), [CODES[c] for c in ("NOUN", "ADJ", "NUM")])
    given = w.count(third) + w.count(alone)
    content = w.repeated(w.lemma, w.member("content"))
    return {
        "pronoun_density": per(given, n),
        "pronoun_noun_ratio": per(given, w.count(w.c == 0)),
        "repeated_content_lemmas": per(content, n),
        "repeated_content_and_pronoun_lemmas": per(content + w.repeated(w.lemma, third) + w.repeated(w.lemma, alone), n),
    }


def closed_connectives(w: Words) -> dict[str, np.ndarray]:
    n, content = w.count(w.c >= 0), w.count(w.member("content"))
    attended = w.flag("demonstrative") & np.isin(w.next_class(), [CODES[c] for c in ("NOUN", "ADJ", "NUM")])
    out = {"determiners": per(w.count(w.flag("determiner")), n), "all_demonstratives": per(w.count(w.flag("demonstrative")), n), "attended_demonstratives": per(w.count(attended), n)}
    out |= {name: per(w.count(w.flag(name)), n) for name in ("basic_connectives", "conjunctions", "disjunctions", "lexical_subordinators", "coordinating_conjuncts")}
    return out | {f"{c}_ratio": per(w.count(w.member(c)), content) for c in ("noun", "verb", "adj", "adv")}


def mtld(w: Words, floor: float = 0.72, least: int = 50) -> dict[str, np.ndarray]:
    kept = ~w.flag("stop")
    words = w.word[kept]
    edges = np.searchsorted(w.doc[kept], np.arange(w.n + 1)).tolist()
    return {"mtld_score": np.array([_mtld(words[lo:hi].tolist(), floor) if hi - lo >= least else 0.0 for lo, hi in zip(edges[:-1], edges[1:], strict=True)])}


def _mtld(words: list[int], floor: float) -> float:
    ways = []
    for way in (words, words[::-1]):
        factors, seen, run = 0.0, set(), 0
        for word in way:
            seen.add(word)
            run += 1
            if len(seen) / run <= floor:
                factors, seen, run = factors + 1, set(), 0
        if run:
            factors += (1 - len(seen) / run) / (1 - floor)
        ways.append(len(words) / factors if factors else float(len(words)))
    return sum(ways) / 2


#: The sets that measures ask for, by name; words in lower case.
SETS = {
    "prp": X.PERSONAL,
    "demonstrative": X.DEMONSTRATIVES,
    "determiner": X.ARTICLES + X.DEMONSTRATIVES,
    "basic_connectives": ["and", "nor", "but", "or", "yet", "so"],
    "conjunctions": ["and", "but"],
    "disjunctions": ["or"],
    "lexical_subordinators": X.SUBORDINATORS,
    "coordinating_conjuncts": X.CONJUNCT_COORDINATORS,
}


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= MOST_CHARS:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


INTEGERS = {"n_tokens", "n_types", "n_sentences"}
NAMES = {
    "basic": ["n_tokens", "n_types", "n_sentences", "type_token_ratio", "sent_len_mean", "sent_len_std", "sent_len_cv"],
    "diversity": ["lemma_ttr", "lemma_mattr", "function_mattr", "lexical_density_tokens", "lexical_density_types", *[f"{n}_ttr" for n in ("content", "function", "noun", "verb", "adj", "adv", "prp", "argument")], "bigram_lemma_ttr", "trigram_lemma_ttr"],
    "givenness": ["pronoun_density", "pronoun_noun_ratio", "repeated_content_lemmas", "repeated_content_and_pronoun_lemmas"],
    "closed_connectives": ["determiners", "all_demonstratives", "attended_demonstratives", "basic_connectives", "conjunctions", "disjunctions", "lexical_subordinators", "coordinating_conjuncts", "noun_ratio", "verb_ratio", "adj_ratio", "adv_ratio"],
    "mtld": ["mtld_score"],
}
FAMILIES: dict[str, Callable[[Words], dict[str, np.ndarray]]] = {"basic": basic, "diversity": diversity, "givenness": givenness, "closed_connectives": closed_connectives, "mtld": mtld}


def _vocabulary(stop: Sequence[str]) -> Vocabulary:
    return Vocabulary({"stop": frozenset(stop), "third": frozenset(X.THIRD_PERSON), **{k: frozenset(v) for k, v in SETS.items()}})


def _run(docs: DataFrame, schema: T.StructType, stop: Sequence[str], rows: Callable[[Words], tuple[np.ndarray, dict[str, pa.Array]]]) -> DataFrame:
    """``rows`` gives for each result row its document's place in the block, and the new columns; others are passed on."""
    place, passed = docs.columns.index("text"), [k for k, c in enumerate(docs.columns) if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(stop)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for lo, hi in _blocks(texts):
                if len(vocabulary) > MOST_WORDS:
                    vocabulary = _vocabulary(stop)
                pick, columns = rows(Words(texts[lo:hi], vocabulary))
                pick = pa.array(pick + lo)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pick) for k in passed), *columns.values()], schema.names)

    return spread(docs).mapInArrow(run, schema)


def measures(docs: DataFrame, families: Sequence[str], stop: Sequence[str] = ()) -> DataFrame:
    """``docs`` without its text, with the values of the families (see NAMES)."""
    names = [n for f in families for n in NAMES[f]]
    kinds = {n: (T.LongType(), pa.int64()) if n in INTEGERS else (T.DoubleType(), pa.float64()) for n in names}
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField(n, kinds[n][0]) for n in names])

    def rows(w: Words) -> tuple[np.ndarray, dict[str, pa.Array]]:
        values = {k: v for f in families for k, v in FAMILIES[f](w).items()}
        return np.arange(w.n), {n: pa.array(values[n].astype(np.int64 if n in INTEGERS else np.float64), kinds[n][1]) for n in names}

    return _run(docs, schema, stop, rows)


SIX = ("overlap", "overlap_div_seg", "binary", "overlap_2", "overlap_2_div_seg", "binary_2")


def _six(owner: np.ndarray, segment: np.ndarray, lemma: np.ndarray, n: int) -> list[np.ndarray]:
    """The six values of one level and class; ``owner`` has the document of each segment."""
    size = int(lemma.max(initial=0)) + 1
    keys = np.unique(segment * size + lemma)
    own = keys // size
    follows = np.zeros(len(owner) + 2, bool)
    follows[: max(len(owner) - 1, 0)] = owner[1:] == owner[:-1]
    second = np.zeros(len(owner) + 2, bool)
    second[: max(len(owner) - 2, 0)] = owner[2:] == owner[:-2]

    def met(k: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, keys + k * size), max(len(keys) - 1, 0))
        return keys[at] == keys + k * size if len(keys) else np.zeros(0, bool)

    one, out = met(1), []
    for on, hit in ((follows, one), (second, one | met(2))):
        on = on[: len(owner)]
        hits = np.bincount(own[hit & on[own]], minlength=len(owner)) if len(keys) else np.zeros(len(owner), np.int64)
        types = np.bincount(own, minlength=len(owner)) if len(keys) else np.zeros(len(owner), np.int64)
        total = lambda v: np.bincount(owner[on], v[on], n) if on.any() else np.zeros(n)  # noqa: E731, B023
        s, d, b, k = total(hits), total(types), total(hits > 0), total(np.ones(len(owner)))
        out += [per(s, d), per(s, k), per(b, k)]
    return out


def overlap(docs: DataFrame, classes: Sequence[str] = X.CLASSES, levels: Sequence[str] = ("sent", "para")) -> DataFrame:
    """Adjacent overlap: a row for each document, level and class with six values."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField(n, T.StringType()) for n in ("level", "class")] + [T.StructField(n, T.DoubleType()) for n in SIX])

    def rows(w: Words) -> tuple[np.ndarray, dict[str, pa.Array]]:
        values, names = [], [(level, c) for level in levels for c in classes]
        for level, c in names:
            mask = w.member(c)
            owner, segment = (w.sentence_doc, w.sentence) if level == "sent" else (w.paragraph_doc, w.paragraph)
            values.append(_six(owner, segment[mask], w.lemma[mask], w.n))
        pick = np.tile(np.arange(w.n), len(names))
        labels = {k: pa.array(np.repeat(np.array([x[i] for x in names], object), w.n), pa.string()) for i, k in enumerate(("level", "class"))}
        return pick, labels | {n: pa.array(np.concatenate([v[k] for v in values])) for k, n in enumerate(SIX)}

    return _run(docs, schema, (), rows)


def connectives(docs: DataFrame, items: Sequence[tuple[str, str]]) -> DataFrame:
    """doc_id and other columns, relation, matches, rate: leftmost-longest, non-overlapping matches of each relation, inside sentences.

    ``items`` are (item, relation), words apart by one blank; only documents with a match have a row.
    """
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("relation", T.StringType()), T.StructField("matches", T.LongType()), T.StructField("rate", T.DoubleType())])

    def rows(w: Words) -> tuple[np.ndarray, dict[str, pa.Array]]:
        # items whose words the block has, by their first word; the longest come first
        by_first: dict[int, list[tuple[list[int], str]]] = {}
        for item, relation in items:
            ids = [w.vocabulary.get(x, -1) for x in item.split(" ")]
            if min(ids) >= 0:
                by_first.setdefault(ids[0], []).append((ids, relation))
        for group in by_first.values():
            group.sort(key=lambda x: -len(x[0]))
        word, sentence, doc = w.word.tolist(), w.sentence, w.doc
        found: dict[tuple[int, str], int] = {}
        free: dict[str, int] = {}
        for p in np.flatnonzero(np.isin(w.word, list(by_first))).tolist():
            here = set()
            for ids, relation in by_first[word[p]]:
                n = len(ids)
                if relation in here or word[p : p + n] != ids or sentence[p + n - 1] != sentence[p]:
                    continue
                here.add(relation)
                if free.get(relation, 0) <= p:
                    key = (int(doc[p]), relation)
                    found[key] = found.get(key, 0) + 1
                    free[relation] = p + n
        pick = np.array([d for d, _ in found], np.int64)
        times = np.array(list(found.values()), np.int64)
        rate = times / w.count(w.c >= 0)[pick] if len(pick) else np.zeros(0)
        return pick, {"relation": pa.array([r for _, r in found], pa.string()), "matches": pa.array(times), "rate": pa.array(rate)}

    return _run(docs, schema, (), rows)


def zipf(docs: DataFrame, values: dict[str, float], stop: Sequence[str], first: int) -> DataFrame:
    """zipf_mean, zipf_std over the known words among the first content tokens of each document; 0 without any."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField(n, T.DoubleType()) for n in ("zipf_mean", "zipf_std")])
    known = docs.sparkSession.sparkContext.broadcast(values)  # the caller has bounded it

    def rows(w: Words) -> tuple[np.ndarray, dict[str, pa.Array]]:
        kept = np.flatnonzero(~w.flag("stop"))
        doc = w.doc[kept]
        n = np.bincount(doc, minlength=w.n)
        kept = kept[np.arange(len(kept)) - (np.cumsum(n) - n)[doc] < first]
        numbers, which = np.unique(w.word[kept], return_inverse=True)
        names = dict(zip(w.vocabulary.values(), w.vocabulary, strict=True))
        own = np.array([known.value.get(names[k], np.nan) for k in numbers.tolist()] or [np.nan])[which] if len(kept) else np.zeros(0)
        doc, own = w.doc[kept][~np.isnan(own)], own[~np.isnan(own)]
        n = np.bincount(doc, minlength=w.n)
        mean = per(np.bincount(doc, own, w.n), n)
        sd = np.sqrt(per(np.bincount(doc, (own - mean[doc]) ** 2, w.n), n))
        return np.arange(w.n), {"zipf_mean": pa.array(mean), "zipf_std": pa.array(sd)}

    return _run(docs, schema, stop, rows)


def grouped_overlap(docs: DataFrame, groups: dict[str, int], score: float, word_class: str) -> DataFrame:
    """syn_overlap: types of a sentence against tokens of the next, equal or, at ``score``, others of the same group, for each pair of sentences.

    A group's matches are its types times its tokens, so a large group costs no
    more than its words; what is equal is taken out of that product.
    """
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("syn_overlap", T.DoubleType())])
    known = docs.sparkSession.sparkContext.broadcast(groups)  # the caller has bounded it

    def rows(w: Words) -> tuple[np.ndarray, dict[str, pa.Array]]:
        mask = w.c == CODES[word_class]
        follows = np.zeros(len(w.sentence_doc), bool)
        follows[:-1] = w.sentence_doc[1:] == w.sentence_doc[:-1]
        size = len(w.vocabulary.lemmas) + 1
        keys, times = np.unique(w.sentence[mask] * size + w.lemma[mask], return_counts=True)
        sentence, lemma = keys // size, keys % size

        def met(keys: np.ndarray, size: int, types: np.ndarray, tokens: np.ndarray) -> np.ndarray:
            """For each key its types times the tokens of the same key in the next sentence."""
            if not len(keys):
                return np.zeros(0)
            at = np.minimum(np.searchsorted(keys, keys + size), len(keys) - 1)
            return np.where((keys[at] == keys + size) & follows[keys // size], types * tokens[at], 0).astype(float)

        same = met(keys, size, np.ones_like(times), times)
        total = np.bincount(w.sentence_doc[sentence], same, w.n)
        names = list(w.vocabulary.lemmas)
        numbers, which = np.unique(lemma, return_inverse=True)
        own = np.array([known.value.get(names[k], -1) for k in numbers.tolist()], np.int64)[which]
        grouped = own >= 0
        span = int(own.max(initial=0)) + 1
        pairs, which = np.unique(sentence[grouped] * span + own[grouped], return_inverse=True)
        near = met(pairs, span, np.bincount(which, minlength=len(pairs)), np.bincount(which, times[grouped], len(pairs)))
        near = np.bincount(w.sentence_doc[pairs // span], near, w.n) - np.bincount(w.sentence_doc[sentence[grouped]], same[grouped], w.n)
        n = np.bincount(w.sentence_doc, minlength=w.n)
        return np.arange(w.n), {"syn_overlap": pa.array(np.where(n > 1, (total + score * near) / np.maximum(n - 1, 1), 0.0))}

    return _run(docs, schema, (), rows)
