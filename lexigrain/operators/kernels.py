"""Sequential kernels as Arrow UDFs: tokenizer, word pieces, hyphenation, a trainable tagger.

Tables and weights are inputs; nothing here carries a model.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks peeled from a word's ends, contraction endings, words split in their own way, abbreviations
# that keep their period, what parts a word from the inside, and the apostrophes that are made straight.
LEADING = "\"'“‘([{«<*_"
TRAILING = "\"'”’)]}»>.,;:!?*_…"
ENDINGS = ("n't", "'s", "'re", "'ve", "'ll", "'d", "'m")
SPLIT_AT = {"can't": 2, "won't": 2, "shan't": 3, "cannot": 3}
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof st jr sr vs etc e.g i.e u.s u.k u.n a.m p.m no mt gen col lt sgt capt cmdr rep sen "
    "gov pres rev hon jan feb mar apr jun jul aug sep sept oct nov dec inc ltd co corp dept univ approx "
    "est fig vol pp ed eds al cf ca".split()
)
_INFIX = regex.compile(r"(?<=[A-Za-z])(—|–|--+|-|/|~)(?=[A-Za-z])")
STRAIGHT = str.maketrans("’‘", "''")
#: Marks at a word's end that go, all at once up to a period that may belong to the word.
_INITIALS = regex.compile(r"([A-Za-z]\.)+[A-Za-z]?|[A-Z]\.")
_TAIL = regex.compile(r"\.\.\.$|[" + regex.escape(TRAILING) + r"]$")


def _owns_period(word: str) -> bool:
    """Is the period at the end of a word part of it?"""
    return word.endswith(".") and not word.endswith("...") and (word[:-1].lower().rstrip(".") in ABBREVIATIONS or bool(_INITIALS.fullmatch(word)))


def _parts(word: str) -> list[str]:
    """A word without marks at its ends: contractions split, else parted at dashes and slashes between letters."""
    low = word.lower()
    at = SPLIT_AT.get(low) or next((len(word) - len(e) for e in ENDINGS if low.endswith(e) and len(low) > len(e)), 0)
    return [word[:at], word[at:]] if at else [p for p in _INFIX.split(word) if p]


def tokenize(text: str) -> list[str]:
    """Words and marks: marks peeled one by one, abbreviations and initials kept, contractions split."""
    out: list[str] = []
    for chunk in text.translate(STRAIGHT).split():
        word = chunk.lstrip(LEADING)
        out += chunk[: len(chunk) - len(word)]
        marks: list[str] = []
        while not _owns_period(word) and (tail := _TAIL.search(word)):
            marks.append(tail[0])
            word = word[: tail.start()]
        out += [*_parts(word), *reversed(marks)]
    return out


def wordpieces(text: str, vocabulary: frozenset[str], most: int = 254) -> list[str]:
    """Greedy longest pieces of lower-cased, accent-free words; ``##`` continues a word, unknown words are [UNK]."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    out: list[str] = []
    for word in regex.findall(r"[\p{Han}]|[^\s\p{P}\p{S}\p{Han}]+|[\p{P}\p{S}]", plain):
        pieces, at = [], 0
        while at < len(word) and len(word) <= 100:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                break
            pieces.append(("##" if at else "") + word[at:end])
            at = end
        out += pieces if pieces and at == len(word) else ["[UNK]"]
        if len(out) >= most:
            return out[:most]
    return out


def hyphen_points(word: str, patterns: dict[str, list[int]], left: int = 2, right: int = 2, longest: int | None = None) -> list[int]:
    """Places where a word may be hyphenated: those whose strongest value, of all patterns that cover them, is odd.

    ``longest``: letters of the longest pattern, if known; no longer piece is looked up.
    """
    framed = f".{word.lower()}."
    longest = longest or max(map(len, patterns), default=0)
    pieces = ((at, framed[at : at + n]) for n in range(1, min(longest, len(framed)) + 1) for at in range(len(framed) - n + 1))
    strongest: dict[int, int] = {}
    for at, values in ((at, patterns[p]) for at, p in pieces if p in patterns):
        strongest |= {at + k: max(v, strongest.get(at + k, 0)) for k, v in enumerate(values)}
    return [at - 1 for at in sorted(strongest) if strongest[at] % 2 and left < at <= len(word) - right + 1]


def parse_patterns(lines: list[str]) -> dict[str, list[int]]:
    """Hyphenation patterns such as ``a1b2c`` as letters and the values between them; comments are left out."""
    out = {}
    for line in lines:
        line = line.strip()
        if line and line[0] not in "%#" and not line.isupper():
            values = [int(d or 0) for d in regex.split(r"[^\d]", line)]
            out[regex.sub(r"\d", "", line)] = values
    return out


_STRINGS = T.ArrayType(T.StringType())


def tokenized(docs: DataFrame) -> DataFrame:
    """Adds ``tokens``: ``tokenize`` of the text."""

    @F.arrow_udf(_STRINGS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([tokenize(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    return docs.withColumn("tokens", run("text"))


def wordpieced(docs: DataFrame, vocabulary: list[str], most: int = 254) -> DataFrame:
    """Adds ``pieces``; the vocabulary is broadcast once."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    @F.arrow_udf(_STRINGS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([wordpieces(t or "", known.value, most) for t in texts.to_pylist()], pa.list_(pa.string()))

    return docs.withColumn("pieces", run("text"))


class Tagger:
    """Greedy averaged perceptron over words, two previous predictions and affixes; weights by crc32 of the feature."""

    def __init__(self, weights: dict[int, dict[str, float]] | None = None, tags: list[str] | None = None):
        self.weights, self.tags = weights or {}, tags or []

    @staticmethod
    def features(words: list[str], i: int, p1: str, p2: str) -> list[int]:
        w = words[i].lower()
        before, after = words[i - 1].lower() if i else "^", words[i + 1].lower() if i + 1 < len(words) else "$"
        shape = regex.sub(r"\d+", "9", regex.sub(r"\p{Ll}+", "x", regex.sub(r"\p{Lu}+", "X", words[i])))
        named = (f"w={w}", f"s={w[-3:]}", f"p={w[:2]}", f"b={before}", f"a={after}", f"1={p1}", f"2={p1},{p2}", f"h={shape}")
        return [zlib.crc32(f.encode()) for f in named]

    def scores(self, feats: list[int]) -> dict[str, float]:
        total = dict.fromkeys(self.tags, 0.0)
        for f in feats:
            for tag, v in self.weights.get(f, {}).items():
                total[tag] += v
        return total

    def tag(self, words: list[str]) -> list[tuple[str, float]]:
        """(tag, margin to the runner-up) of each word, left to right; ties go to the first tag."""
        out, p1, p2 = [], "^", "^"
        for i in range(len(words)):
            ranked = sorted(self.scores(self.features(words, i, p1, p2)).items(), key=lambda x: -x[1])
            out.append((ranked[0][0], ranked[0][1] - ranked[1][1] if len(ranked) > 1 else float("inf")))
            p1, p2 = ranked[0][0], p1
        return out

    def train(self, sentences: list[list[tuple[str, str]]], rounds: int = 5) -> Tagger:
        """Averaged updates over all words so far, in the order given."""
        self.tags = sorted({t for s in sentences for _, t in s})
        sums: dict[int, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        now: dict[int, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        step = 0
        for _ in range(rounds):
            for s in sentences:
                words = [w for w, _ in s]
                p1 = p2 = "^"
                for i, (_, gold) in enumerate(s):
                    step += 1
                    self.weights = now
                    feats = self.features(words, i, p1, p2)
                    score = self.scores(feats)
                    guess = max(self.tags, key=lambda t: score[t])
                    if guess != gold:
                        for f in feats:
                            for t, d in ((gold, 1.0), (guess, -1.0)):
                                now[f][t] += d
                                sums[f][t] += d * step
                    p1, p2 = guess, p1
        self.weights = {f: {t: v - sums[f][t] / (step + 1) for t, v in ts.items()} for f, ts in now.items()}
        return self


def tagged(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """Adds ``tags`` beside a column ``tokens``; the weights are broadcast once."""
    model = docs.sparkSession.sparkContext.broadcast((tagger.weights, tagger.tags))

    @F.arrow_udf(_STRINGS)
    def run(tokens: pa.Array) -> pa.Array:
        own = Tagger(*model.value)
        return pa.array([[t for t, _ in own.tag(ws or [])] for ws in tokens.to_pylist()], pa.list_(pa.string()))

    return docs.withColumn("tags", run("tokens"))
