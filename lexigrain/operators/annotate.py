"""Annotation: text to paragraphs, sentences and classed words, as nested columns of the same row.

Every per-document property is an expression over these columns, so a plan that
measures documents is scan, annotate, project, write: no exchange at any scale.
Words are runs of letters in lower case; sentences end at closing punctuation
before white space unless a lower-case letter, an abbreviation or an initial
speaks against it; paragraphs are lines with text.

Classing a word takes some fifty tests, which a lambda in a plan would
interpret for every occurrence. So this one stage is an Arrow UDF that decides
each distinct word once a batch worker and looks it up afterwards.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.functions import lexicon as X
from lexigrain.storage import spread

WORDS = r"\p{L}+"
BREAK = r"([.!?…]+[\x22\x27”’)\]]*)\s+([^\p{Ll}\s])"
#: Protects the period of abbreviations and initials.
PROTECT = r"(^|[^\p{L}])(" + "|".join(X.ABBREVIATIONS) + r"|\p{Lu})\."

_BLANK = " \t\n\x0b\x0c\r"
#: Here \s has more than the blanks that Java and RE2 mean by it.
_WORDS, _BREAK, _PROTECT = (regex.compile(p.replace(r"{Ll}\s", r"{Ll}" + _BLANK).replace(r"\s", f"[{_BLANK}]")) for p in (WORDS, BREAK, PROTECT))
_known: dict[str, tuple[str, str]] = {}
TOKEN = pa.struct([("w", pa.string()), ("c", pa.string()), ("l", pa.string())])


def classed(word: str) -> tuple[str, str]:
    """Class and lemma of a lower-case word, remembered."""
    if word not in _known:
        if len(_known) > 500_000:
            _known.clear()
        c = X.class_of(word)
        _known[word] = (c, X.lemma_of(word, c))
    return _known[word]


def sentence_texts(paragraph: str) -> list[str]:
    """The sentences of a paragraph, in order; one without words stays an element."""
    return _BREAK.sub("\\1\x01\\2", _PROTECT.sub("\\1\\2\x02", paragraph)).split("\x01")


_TYPE = T.StructType([T.StructField(k, T.StringType()) for k in "wcl"])


@F.arrow_udf(T.ArrayType(T.ArrayType(T.ArrayType(_TYPE))))
def _annotate(texts: pa.Array) -> pa.Array:
    w, c, low = [], [], []
    per_sentence, per_para, per_doc = [], [], []
    for text in texts.to_pylist():
        n_paras = 0
        for line in (text or "").split("\n"):
            line = line.strip(_BLANK)
            if not line:
                continue
            n_paras += 1
            sentences = sentence_texts(line)
            per_para.append(len(sentences))
            for s in sentences:
                found = _WORDS.findall(s.lower())
                per_sentence.append(len(found))
                w += found
                for word in found:
                    k, lemma = classed(word)
                    c.append(k)
                    low.append(lemma)
        per_doc.append(n_paras)
    nested = pa.StructArray.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.string()), pa.array(low, pa.string())], fields=list(TOKEN))
    for counts in (per_sentence, per_para, per_doc):
        nested = pa.ListArray.from_arrays(pa.array(list(accumulate(counts, initial=0)), pa.int32()), nested)
    return nested


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sents`` and ``paras``: arrays (in reading order) of arrays of struct(w, c, l)."""
    split = spread(docs).withColumn("_tokens", _annotate(text))
    return split.withColumn("sents", F.flatten("_tokens")).withColumn("paras", F.expr("transform(_tokens, p -> flatten(p))")).drop("_tokens")


def flat(docs: DataFrame, text: str = "text") -> DataFrame:
    """``annotate`` plus ``toks``: all words of the text in one array."""
    return annotate(docs, text).withColumn("toks", F.flatten("sents"))
