"""Rhythm of sentences in syllables: phrases, their variability, end weight."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.operators.annotate import _BLANK, sentence_texts

PAUSE = r"[,;:()—–]"
VOWELS = r"[aeiouyàâäáéèêëíîïóôöúùûü]+"
WORD = r"\p{L}+"
_PAUSE, _VOWELS, _WORD = regex.compile(PAUSE), regex.compile(VOWELS), regex.compile(WORD)


def syllables(word: str) -> int:
    return max(1, len(_VOWELS.findall(word.lower())))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
def _phrases(texts: pa.Array) -> pa.Array:
    known: dict[str, int] = {}
    out = []
    for text in texts.to_pylist():
        rows = []
        for line in (text or "").split("\n"):
            line = line.strip(_BLANK)
            for sentence in sentence_texts(line) if line else ():
                sizes = []
                for piece in _PAUSE.split(sentence):
                    n = 0
                    for w in _WORD.findall(piece):
                        if w not in known:
                            known[w] = syllables(w)
                        n += known[w]
                    if n:
                        sizes.append(n)
                rows.append(sizes)
        out.append(rows)
    return pa.array(out, pa.list_(pa.list_(pa.int64())))


def rhythm(docs: DataFrame) -> DataFrame:
    """doc_id, phrases, syllables, npvi, end_weight: over the stream of phrases, and the median share of last phrases."""
    a = docs.select("doc_id", _phrases("text").alias("s")).withColumn("p", F.flatten("s"))
    steps = "transform(filter(transform(p, (x, i) -> named_struct('a', x, 'b', get(p, i + 1))), q -> q.b IS NOT NULL), q -> 100D * abs(q.a - q.b) / ((q.a + q.b) / 2D))"
    ends = "array_sort(transform(filter(s, x -> size(x) >= 2), x -> element_at(x, -1) / (aggregate(x, 0L, (c, y) -> c + y) / double(size(x)))))"
    a = a.withColumn("d", F.expr(steps)).withColumn("e", F.expr(ends))
    middle = "(e[int((size(e) - 1) div 2)] + e[int(size(e) div 2)]) / 2D"
    return a.selectExpr(
        "doc_id",
        "bigint(size(p)) AS phrases",
        "aggregate(p, 0L, (c, y) -> c + y) AS syllables",
        "if(size(d) > 0, aggregate(d, 0D, (c, y) -> c + y) / size(d), 0D) AS npvi",
        f"if(size(e) > 0, {middle}, 0D) AS end_weight",
    )
