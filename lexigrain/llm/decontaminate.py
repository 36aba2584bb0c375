"""Benchmark decontamination by a prefix-filtered join, with DataFrame operations only.

A benchmark item is a set of windows of ``width`` consecutive words (a shorter
item is one window). A document that contains a window contains each of its
words, so the prefix that a containment join needs is one word: the window's
rarest by document frequency over the whole corpus. Document words meet windows
on that word alone; the window's length and the word's place in it bound where
the occurrence can start and end, and the words at that place are compared one
by one.

Words are runs of digits, a-z after lower-casing A-Z, and characters from
U+0080 on. Cases: a null or wordless text has no words and no hits; a null or
wordless item has no windows; items with one item_id are one item with all their
windows; hits of an item without item_id count as hits and not as an item;
repeated documents get the same result each; texts are read whole, however long;
empty tables give empty or clean results; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.names import spare
from lexigrain.storage import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Windows that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def word_list(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, words): the windows of each item, equal ones once."""
    own = items.select("item_id", word_list(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words")).distinct()


def with_prefix(wins: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Each distinct window once, with its rarest word and that word's place (from 0)."""
    vocabulary = wins.select(F.explode("words").alias("word")).distinct()
    vocabulary = scratch.table(vocabulary, "vocabulary")
    small = F.broadcast(vocabulary) if vocabulary.count() <= MOST_BROADCAST else vocabulary
    seen = docs.select(F.explode(F.array_distinct(word_list(F.col("text")))).alias("word")).join(small, "word")
    rarity = vocabulary.join(seen.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))
    distinct = wins.groupBy("words").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    placed = distinct.select("*", F.posexplode("words").alias("at", "word")).join(F.broadcast(rarity) if small is not vocabulary else rarity, "word")
    first = Window.partitionBy("words").orderBy("df", "word", "at")
    ranked = placed.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    return ranked.select(F.col("word").alias("prefix"), "at", "words", "items", F.size("words").alias("len"))


def matches(docs: DataFrame, wins: DataFrame, key: list[str], width: int, broadcast: bool) -> DataFrame:
    """Occurrences (key, start, len, items) of windows in documents; start counts words from 0."""
    w = word_list(F.col("text"))
    if broadcast:
        # the word array stays in the row being generated: it is copied for matches only
        spots = docs.select(*key, w.alias("w")).select("*", F.posexplode("w").alias("pos", "word"))
        found = spots.join(F.broadcast(wins), F.col("word") == F.col("prefix"))
        here = F.slice("w", F.col("pos") - F.col("at") + 1, F.col("len"))
        found = found.filter((F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("len") <= F.size("w")))
        return found.filter(here == F.col("words")).select(*key, (F.col("pos") - F.col("at")).alias("start"), "len", "items")
    # too many windows to broadcast: words meet the prefixes first, which are narrow rows, and only what meets takes along the words that can surround it
    prefixes = wins.select("prefix").distinct()
    spots = docs.select(*key, F.posexplode(w).alias("pos", "word")).join(prefixes, F.col("word") == F.col("prefix"), "left_semi")
    places = spots.groupBy(*key).agg(F.collect_set("pos").alias("places")).alias("p")
    own = docs.alias("d").join(places, [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key]).select(*[f"d.{k}" for k in key], w.alias("w"), "places")
    around = F.slice("w", F.greatest(F.col("pos") - width + 2, F.lit(1)), F.lit(2 * width - 1))
    met = own.select(*key, "w", F.explode("places").alias("pos")).select(*key, "pos", F.get("w", F.col("pos")).alias("word"), F.least("pos", F.lit(width - 1)).alias("lead"), around.alias("around"))
    found = met.join(wins, F.col("word") == F.col("prefix")).filter(F.col("lead") >= F.col("at"))
    return found.filter(F.slice("around", F.col("lead") - F.col("at") + 1, F.col("len")) == F.col("words")).select(*key, (F.col("pos") - F.col("at")).alias("start"), "len", "items")


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch, width: int = 10) -> DataFrame:
    """(doc_id, text_hash, hits, items) of each contaminated document, once.

    hits: [start, end) in words of the occurrences' union; items: ids as sorted strings.
    """
    wins = scratch.table(with_prefix(windows(items, width), docs, scratch), "windows")
    key = ["doc_id", "text_hash"]
    found = matches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), wins, key, width, wins.count() <= MOST_BROADCAST).distinct()
    # islands of overlapping occurrences; a document's window is as long as its own matches
    order = Window.partitionBy(*key).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    reach = found.withColumn("end", F.col("start") + F.col("len")).withColumn("before", F.coalesce(F.max("end").over(order), F.lit(0)))
    fresh = reach.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before")))
    return fresh.groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def flag(docs: DataFrame, items: DataFrame, scratch: Scratch, width: int = 10) -> DataFrame:
    """Every document with n_words, n_hit, items (sorted) and contaminated; columns of ``docs`` but the text stay."""
    found = contamination(docs, items, scratch, width)
    # splitting at gaps costs far less than matching words
    count = F.coalesce(F.size(F.array_remove(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")), F.lit(0)).cast("long")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    base = docs.select("doc_id", *rest, F.xxhash64("text").alias("text_hash"), count.alias("n_words")).alias("b")
    joined = base.join(found.alias("f"), [F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("b.text_hash") == F.col("f.text_hash")], "left")
    return joined.select(*[F.col(f"b.`{c}`") for c in ("doc_id", *rest, "n_words")], F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("f.items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, width: int = 10) -> DataFrame:
    """``docs`` without the documents that contain a window of an item."""
    found = contamination(docs, items, scratch, width).select("doc_id", "text_hash").alias("f")
    name = spare(docs.columns, "text_hash")
    own = docs.withColumn(name, F.xxhash64("text")).alias("d")
    return own.join(found, [F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), F.col(f"d.`{name}`") == F.col("f.text_hash")], "left_anti").drop(name)
