"""Building corpora and tables from them: paragraphs without copies, held-out text, caps, majority tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.operators import kernel
from lexigrain.operators.annotate import annotate
from lexigrain.operators.lookup import LIMIT
from lexigrain.storage import Scratch


def paragraphs(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, keep, at, text, n_words): lines with text, trimmed; ``at`` is the line's number."""
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = docs.select("doc_id", *keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return rows.select("doc_id", *keep, F.col("at").cast("long").alias("at"), trimmed.alias("text")).filter("text != ''").withColumn("n_words", F.regexp_count("text", F.lit(r"\S+")).cast("long"))


def without_copies(paras: DataFrame) -> DataFrame:
    """The first of equal paragraphs by (doc_id, at): a combined minimum, then an equi-join on the digest."""
    keyed = paras.withColumn("_key", F.md5("text"))
    first = keyed.groupBy("_key").agg(F.min(F.struct("doc_id", "at")).alias("_first"))
    return keyed.join(first, "_key").filter((F.col("doc_id") == F.col("_first.doc_id")) & (F.col("at") == F.col("_first.at"))).drop("_key", "_first")


def without_held_out(paras: DataFrame, held: DataFrame) -> DataFrame:
    """Paragraphs whose text is none of ``held`` (text)."""
    return paras.withColumn("_key", F.md5("text")).join(held.select(F.md5("text").alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def capped(paras: DataFrame, group: str, words: int) -> DataFrame:
    """Paragraphs of each group, in order, until ``words`` words are reached; the one that reaches them still counts.

    Sums of documents are accumulated first and windows then run inside a
    document, so a group need not fit one task.
    """
    per_doc = paras.groupBy(group, "doc_id").agg(F.sum("n_words").alias("n"))
    before = Window.partitionBy(group).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_doc.select(group, "doc_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")).filter(F.col("_start") < words)
    inside = Window.partitionBy(group, "doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("_start") + F.coalesce(F.sum("n_words").over(inside), F.lit(0))
    return paras.join(starts, [group, "doc_id"]).withColumn("_reached", reached).filter(F.col("_reached") < words).drop("_start", "_reached")


def majority(pairs: DataFrame, key: str, value: str, least: int = 5, share: float = 0.8) -> DataFrame:
    """(key, value, n, share): each key's commonest value, if seen often and clearly enough; ties go to the smaller value."""
    counts = pairs.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy(key).agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.min_by(value, F.struct(F.negative("c"), F.col(value))).alias(value))
    out = best.withColumn("share", F.col("top") / F.col("n"))
    return out.filter((F.col("n") >= least) & (F.col("share") >= share)).select(key, value, "n", "share")


def synonym_overlap(docs: DataFrame, synonyms: DataFrame, word_class: str = "NOUN", limit: int = 200_000) -> DataFrame:
    """(doc_id, syn_overlap): types of a sentence against tokens of the next, equal or synonymous (w, t, score), for each pair of sentences."""
    lemmas = f"transform(sents, s -> transform(filter(s, x -> x.c = '{word_class}'), x -> x.l))"
    a = annotate(docs).select("doc_id", F.expr(lemmas).alias("s"))
    small = F.broadcast(synonyms) if synonyms.count() <= limit else synonyms
    pairs = a.select("doc_id", F.expr("explode(if(size(s) > 1, transform(sequence(1, size(s) - 1), i -> named_struct('x', array_distinct(s[i - 1]), 'y', s[i])), array()))").alias("p"))
    words = pairs.select("doc_id", F.col("p.y").alias("y"), F.explode("p.x").alias("w"))
    same = words.groupBy("doc_id").agg(F.sum(F.expr("double(size(filter(y, t -> t = w)))")).alias("v"))
    near = words.join(small.filter("w != t"), "w").groupBy("doc_id").agg(F.sum(F.expr("score * size(filter(y, x -> x = t))")).alias("v"))
    total = same.unionByName(near).groupBy("doc_id").agg(F.sum("v").alias("v"))
    counts = a.select("doc_id", F.size("s").alias("n"))
    return counts.join(total, "doc_id", "left").select("doc_id", F.when(F.col("n") > 1, F.coalesce("v", F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0).alias("syn_overlap"))


def grouped_overlap(docs: DataFrame, groups: DataFrame, score: float, word_class: str = "NOUN", limit: int = LIMIT) -> DataFrame:
    """``synonym_overlap`` where the words of a group (word, group; a word is in one group) are each other's synonyms at one score.

    The pairs of a group, which are the square of its words, are never made. At
    most ``limit`` words are looked up in the row, more are joined.
    """
    docs = docs.select("doc_id", "text")
    known = groups.select("word", F.col("group").cast("string").alias("group")).limit(limit + 1).toArrow()
    if len(known) <= limit:
        codes = known["group"].combine_chunks().dictionary_encode().indices
        out = kernel.grouped_overlap(docs, dict(zip(known["word"].to_pylist(), codes.to_pylist(), strict=True)), score, word_class)
    else:
        out = _grouped_joined(docs, groups, score, word_class)
    # sentences meet by doc_id, so a row without one has none that follow another
    return out.select("doc_id", F.when(F.col("doc_id").isNull(), 0.0).otherwise(F.col("syn_overlap")).alias("syn_overlap"))


def _grouped_joined(docs: DataFrame, groups: DataFrame, score: float, word_class: str) -> DataFrame:
    """The same for any number of words: each lemma of a sentence stands as a type at its place and as tokens at the place before."""
    a = annotate(docs).select("doc_id", F.expr(f"transform(sents, s -> transform(filter(s, x -> x.c = '{word_class}'), x -> x.l))").alias("s"))
    tokens = a.select("doc_id", F.posexplode("s").alias("at", "l")).select("doc_id", "at", F.explode("l").alias("word"))
    types = tokens.groupBy("doc_id", "at", "word").agg(F.count(F.lit(1)).alias("k"))
    types = types.join(groups.select("word", "group"), "word", "left")
    roles = F.array(F.struct(F.col("at").alias("at"), F.lit(1).alias("x"), F.lit(0).cast("long").alias("y")), F.struct((F.col("at") - 1).alias("at"), F.lit(0).alias("x"), F.col("k").alias("y")))
    spots = types.select("doc_id", "word", "group", F.explode(roles).alias("r")).groupBy("doc_id", "group", "word", "r.at").agg(F.sum("r.x").alias("x"), F.sum("r.y").alias("y"))
    met = spots.groupBy("doc_id", "group", "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("same"))
    value = F.col("same") + F.when(F.col("group").isNotNull(), score * (F.col("x") * F.col("y") - F.col("same"))).otherwise(0.0)
    total = met.groupBy("doc_id").agg(F.sum(value).alias("v"))
    counts = a.select("doc_id", F.size("s").alias("n"))
    return counts.join(total, "doc_id", "left").select("doc_id", F.when(F.col("n") > 1, F.coalesce("v", F.lit(0.0)) / (F.col("n") - 1)).otherwise(0.0).alias("syn_overlap"))


def license_filter(rows: DataFrame, license: Column, known: dict[str, bool]) -> DataFrame:
    """Rows under an accepted licence; an unknown licence is an error when it is met."""
    accepted = F.lit(None).cast("boolean")
    for name, ok in known.items():
        accepted = F.when(license == name, F.lit(ok)).otherwise(accepted)
    return rows.filter(F.when(accepted.isNull(), F.raise_error(F.concat(F.lit("unknown licence: "), license)).cast("boolean")).otherwise(accepted))


def numbered(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``counts`` (word, count) with ``id``: 0 for the most frequent word, ties by the word.

    Words are dealt by ranges of that order and numbered inside each range;
    the sizes of the ranges before are added. No range holds all words, however
    many share one count.
    """
    order = (F.desc("count"), F.asc("word"))
    dealt = counts.select("word", "count").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = scratch.table(dealt, "ranges")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    # a row for each range, of which there are as many as shuffle partitions
    return dealt.withColumn("own", own).join(F.broadcast(starts), "part").select("word", "count", (F.col("start") + F.col("own")).cast("long").alias("id"))
