"""Per-document measures: counting over words is one Arrow kernel, the rest are expressions over the text; no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.functions import lexicon as X
from lexigrain.operators import kernel
from lexigrain.storage import spread


def ratio(a: str, b: str) -> str:
    """SQL: a / b, and 0 where b is 0."""
    return f"coalesce(try_divide(double({a}), double({b})), 0D)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, for comparison between engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def picked(array: str, name: str, field: str = "l") -> str:
    """SQL: the lemmas (or words) of one class in an array of tokens."""
    return f"transform(filter({array}, x -> {X.member(name, 'x.w', 'x.c')}), x -> x.{field})"


RAW = (
    "bigint(size(filter(split(coalesce(text, ''), r'\\n\\s*\\n'), x -> x rlike r'\\S'))) AS n_paragraphs",
    "bigint(length(coalesce(text, ''))) AS text_length",
    "bigint(regexp_count(coalesce(text, ''), r'\\S+')) AS word_count",
)


def basic(docs: DataFrame, stop: list[str]) -> DataFrame:
    """Counts over content tokens, sentences and raw text."""
    out = kernel.measures(spread(docs).selectExpr("doc_id", "text", *RAW), ["basic"], stop)
    return out.select("doc_id", "n_tokens", "n_types", "n_sentences", "n_paragraphs", "type_token_ratio", "sent_len_mean", "sent_len_std", "sent_len_cv", "text_length", "word_count")


def with_readability(docs: DataFrame) -> DataFrame:
    """``docs`` with Flesch reading ease and grade level and automated readability; syllables are groups of vowel letters."""
    kept = docs.columns
    a = spread(docs).withColumn("_t", F.expr("coalesce(text, '')")).selectExpr(
        *[f"`{c}`" for c in kept],
        "filter(split(regexp_replace(regexp_replace(_t, r\"'(?!t|s|d|ve|ll|re)\", ''), r\"[^\\p{L}\\p{N}_\\s']\", ''), r'\\s+'), x -> x != '') AS _w",
        "greatest(int(_t != ''), size(filter(regexp_extract_all(_t, r'[^.!?]+[.!?]*', 0), x -> size(filter(split(x, r'\\s+'), y -> y != '')) > 2))) AS _sentences",
        "length(regexp_replace(_t, r'\\s', '')) AS _chars",
        "regexp_count(_t, r'\\S+') AS _raw",
    )
    # a word has at least one syllable: groups of vowels in the joined words, and the words without any
    vowels = "[aeiouyàâäáéèêëíîïóôöúùûü]"
    a = a.selectExpr("*", "double(size(_w)) AS _n", f"double(regexp_count(lower(array_join(_w, ' ')), r'{vowels}+') + size(filter(_w, x -> NOT lower(x) rlike r'{vowels}'))) AS _syl")
    none = "_n = 0 OR _sentences = 0"
    return a.selectExpr(
        *[f"`{c}`" for c in kept],
        f"if({none}, 0D, 206.835D - 1.015D * (_n / _sentences) - 84.6D * (_syl / _n)) AS flesch_reading_ease",
        f"if({none}, 0D, 0.39D * (_n / _sentences) + 11.8D * (_syl / _n) - 15.59D) AS flesch_kincaid_grade",
        f"if({none} OR _raw = 0, 0D, 4.71D * (_chars / double(_raw)) + 0.5D * (_n / _sentences) - 21.43D) AS automated_readability",
    )


def readability(docs: DataFrame) -> DataFrame:
    """The three readability values of each document."""
    return with_readability(docs.select("doc_id", "text")).drop("text")


def diversity(docs: DataFrame) -> DataFrame:
    """Type-token ratios of nine classes and of n-grams, lexical density, moving averages over 50 words."""
    return kernel.measures(docs.select("doc_id", "text"), ["diversity"])


def mtld(docs: DataFrame, stop: list[str]) -> DataFrame:
    """Mean length of runs that keep the type-token ratio above 0.72, forward and backward."""
    return kernel.measures(docs.select("doc_id", "text"), ["mtld"], stop)


def overlap(docs: DataFrame, classes=X.CLASSES, levels=("sent", "para")) -> DataFrame:
    """Adjacent overlap: six values for each level and class, a row each (108 values a document)."""
    return kernel.overlap(docs.select("doc_id", "text"), classes, levels)


def givenness(docs: DataFrame) -> DataFrame:
    """Pronoun density, and repeated content lemmas and pronouns."""
    return kernel.measures(docs.select("doc_id", "text"), ["givenness"])


def closed_connectives(docs: DataFrame) -> DataFrame:
    """Rates of closed sets for each word, and shares of the open classes."""
    return kernel.measures(docs.select("doc_id", "text"), ["closed_connectives"])


def properties(docs: DataFrame, stop: list[str]) -> DataFrame:
    """All per-document families, wide, in one pass over the texts."""
    return kernel.measures(with_readability(spread(docs).selectExpr("doc_id", "text", *RAW)), list(kernel.FAMILIES), stop)


def chunks(docs: DataFrame, size: int = 300) -> DataFrame:
    """(doc_id, chunk, n_words): lines gathered to at least ``size`` words; a short tail joins the chunk before it."""
    fold = (
        f"aggregate(_lines, named_struct('done', cast(array() as array<int>), 'n', 0), (a, x) -> if(a.n + x >= {size}, "
        f"named_struct('done', concat(a.done, array(a.n + x)), 'n', 0), named_struct('done', a.done, 'n', a.n + x)), "
        f"a -> CASE WHEN a.n = 0 THEN a.done WHEN size(a.done) > 0 AND a.n * 2 < {size} THEN concat(slice(a.done, 1, size(a.done) - 1), array(element_at(a.done, -1) + a.n)) ELSE concat(a.done, array(a.n)) END)"
    )
    a = docs.selectExpr("doc_id", "filter(transform(split(coalesce(text, ''), '\\n'), x -> regexp_count(x, r'\\S+')), n -> n > 0) AS _lines")
    return a.selectExpr("doc_id", f"posexplode({fold}) AS (chunk, n_words)").selectExpr("doc_id", "bigint(chunk) AS chunk", "bigint(n_words) AS n_words")
