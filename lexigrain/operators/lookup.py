"""Measures that look words up in tables: connectives, frequencies, keywords.

Lexicons are inputs. Each is joined on an equality; a broadcast is only asked
for where the table's row count has been checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.functions import lexicon as X
from lexigrain.operators import kernel
from lexigrain.operators.annotate import flat
from lexigrain.operators.measures import ratio

#: A small default inventory: relation, items. Any table (relation, item) can take its place.
CONNECTIVES = {
    "addition": ["and", "also", "in addition", "as well as", "moreover"],
    "cause": ["because", "since", "as", "because of", "due to"],
    "result": ["so", "thus", "therefore", "as a result"],
    "contrast": ["but", "while", "whereas", "however", "in contrast"],
    "concession": ["although", "though", "even though", "yet"],
    "condition": ["if", "unless", "as long as", "in case"],
    "purpose": ["in order to", "so that", "for"],
    "temporal": ["when", "then", "before", "after", "until", "as soon as", "by then"],
    "alternative": ["or", "nor", "or else"],
    "reference": ["as for", "as to", "in that"],
}
LIMIT = 500_000
#: Connectives that are matched in the row at most.
SHORT = 5_000


def inventory(spark, relations: dict[str, list[str]] = CONNECTIVES) -> DataFrame:
    """(relation, item, n): one row for each item of a relation."""
    rows = [(r, i, len(i.split())) for r, items in relations.items() for i in items]
    return spark.createDataFrame(rows, "relation string, item string, n int").distinct()


def _grams(words: str, most: int, firsts: list[str] | None) -> str:
    """SQL: struct(at, n, item) for every n-gram up to ``most`` words of an array of words; with ``firsts`` only those that begin with one of them."""
    begins = f", i -> element_at({words}, i) IN ({X.quoted(firsts)}))" if firsts else ""
    at = lambda n: f"{'filter(' if firsts else ''}sequence(1, size({words}) - {n - 1}){begins}"
    sizes = [f"if(size({words}) >= {n}, transform({at(n)}, i -> named_struct('at', i, 'n', {n}, 'item', array_join(slice({words}, i, {n}), ' '))), array())" for n in range(1, most + 1)]
    return f"concat({', '.join(sizes)})"


def connectives(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, relation, matches, rate): leftmost-longest, non-overlapping matches of each relation, inside sentences.

    A short inventory is matched in the row of its document. Of a longer one only
    matches leave the row; the greedy choice folds over the few of one document
    and relation.
    """
    short = items.select("item", "relation").limit(SHORT + 1).collect()
    if len(short) <= SHORT:
        return kernel.connectives(docs.select("doc_id", "text"), [tuple(r) for r in short])
    return _joined(docs, items)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same for any number of items, by a join of n-grams."""
    most = items.agg(F.max("n")).first()[0] or 1
    n_items = items.count()
    small = F.broadcast(items) if n_items <= LIMIT else items
    firsts = None
    a = flat(docs).selectExpr("doc_id", "size(toks) AS n_words", "transform(sents, s -> transform(s, x -> x.w)) AS s")
    spots = a.selectExpr("doc_id", "n_words", "posexplode(s) AS (sent, words)").selectExpr("doc_id", "n_words", "sent", f"explode({_grams('words', most, firsts)}) AS g")
    met = spots.selectExpr("doc_id", "n_words", "sent", "g.at", "g.n AS len", "g.item").join(small.drop("n"), "item")
    lists = met.groupBy("doc_id", "relation").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_list(F.struct("sent", "at", F.negative("len").alias("len")))).alias("m"))
    fold = "aggregate(m, named_struct('k', 0L, 'sent', -1, 'free', 0), (a, x) -> if(x.sent = a.sent AND x.at < a.free, a, named_struct('k', a.k + 1L, 'sent', x.sent, 'free', x.at - x.len)), a -> a.k)"
    return lists.withColumn("matches", F.expr(fold)).selectExpr("doc_id", "relation", "matches", f"{ratio('matches', 'n_words')} AS rate")


def word_counts(docs: DataFrame, by: str | None = None) -> DataFrame:
    """(word[, by], count): counted map-side first."""
    keys = [by] if by else []
    words = docs.select(*keys, F.explode(F.expr(r"regexp_extract_all(lower(coalesce(text, '')), r'\p{L}+', 0)")).alias("word"))
    return words.groupBy("word", *keys).agg(F.count(F.lit(1)).alias("count"))


def baseline(docs: DataFrame, by: str, groups: list[str], floor: int = 3) -> DataFrame:
    """word, a count for each group, total: words at or above the floor."""
    counts = word_counts(docs, by).groupBy("word").agg(*[F.sum(F.when(F.col(by) == g, F.col("count")).otherwise(0)).alias(g) for g in groups], F.sum("count").alias("total"))
    return counts.filter(F.col("total") >= floor)


def zipf_table(docs: DataFrame, floor: int = 5) -> DataFrame:
    """(word, zipf): log10 of occurrences in a billion words, from the corpus itself."""
    counts = word_counts(docs)
    total = counts.agg(F.sum("count").alias("all"))
    return counts.filter(F.col("count") >= floor).crossJoin(F.broadcast(total)).select("word", F.log10(F.col("count") / F.col("all") * F.lit(1e9)).alias("zipf"))  # one row


def zipf(docs: DataFrame, table: DataFrame, stop: list[str], first: int = 500) -> DataFrame:
    """zipf_mean, zipf_std over the known words among the first content tokens of each document.

    A table of at most LIMIT words is looked up in the row, a longer one is joined.
    """
    known = table.select("word", "zipf").limit(LIMIT + 1).toArrow()
    if len(known) <= LIMIT:
        values = dict(zip(known["word"].to_pylist(), known["zipf"].to_pylist(), strict=True))
        return kernel.zipf(docs.select("doc_id", "text"), values, stop, first)
    return _zipf_joined(docs, table, stop, first)


def _zipf_joined(docs: DataFrame, table: DataFrame, stop: list[str], first: int) -> DataFrame:
    """The same with a table of any size."""
    a = flat(docs).selectExpr("doc_id", f"slice(filter(transform(toks, x -> x.w), w -> w NOT IN ({X.quoted(stop)})), 1, {first}) AS t")
    words = a.select("doc_id", F.explode("t").alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("k"))
    known = words.join(table, "word").groupBy("doc_id").agg(F.sum(F.col("k") * F.col("zipf")).alias("s"), F.sum(F.col("k") * F.col("zipf") * F.col("zipf")).alias("q"), F.sum("k").alias("n"))
    mean = F.col("s") / F.col("n")
    known = known.select("doc_id", mean.alias("zipf_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("zipf_std"))
    return docs.select("doc_id").join(known, "doc_id", "left").na.fill(0.0)


MASKS = {"plain": None, "n": ("NOUN",), "adj": ("ADJ",), "v": ("VERB",), "v_n": ("VERB", "NOUN"), "a_n": ("ADJ", "NOUN")}


def gram_lists(docs: DataFrame, sizes=(2, 3, 4)) -> DataFrame:
    """(doc_id, variant, item, at): unigrams of five classes, and n-grams inside sentences under six masks; a masked word is ``_``."""
    a = flat(docs).select("doc_id", "sents")
    uni = {"uni": "all", "n_uni": "noun", "v_uni": "verb", "v_n_uni": "verb_noun", "adj_uni": "adj"}
    tests = {k: X.member(v, "x.w", "x.c") if v != "verb_noun" else "x.c IN ('VERB', 'NOUN')" for k, v in uni.items()}
    parts = [f"named_struct('v', '{k}', 's', transform(sents, s -> transform(filter(s, x -> {t}), x -> x.l)), 'n', 1)" for k, t in tests.items()]
    for name, classes in MASKS.items():
        shown = "x.l" if classes is None else f"if(x.c IN ({X.quoted(classes)}), x.l, '_')"
        parts += [f"named_struct('v', '{name}_{n}', 's', transform(sents, s -> transform(s, x -> {shown})), 'n', {n})" for n in sizes]
    rows = a.selectExpr("doc_id", f"explode(array({', '.join(parts)})) AS r")
    grams = "if(size(s) >= r.n, transform(sequence(1, size(s) - r.n + 1), i -> array_join(slice(s, i, r.n), ' ')), array())"
    return rows.selectExpr("doc_id", "r.v AS variant", f"posexplode(flatten(transform(r.s, s -> {grams}))) AS (at, item)")


def keywords(lists: DataFrame, table: DataFrame, share: float = 0.1) -> DataFrame:
    """(doc_id, variant, item): the top tenth of a source's types by percentage difference to a baseline.

    ``table`` has variant, item, per_million; an item that it lacks counts as infinitely key.
    """
    types = lists.groupBy("doc_id", "variant", "item").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    whole = Window.partitionBy("doc_id", "variant")
    sized = types.withColumn("n", F.sum("c").over(whole)).withColumn("keep", F.floor(F.count(F.lit(1)).over(whole) * share))
    cands = sized.filter((F.col("c") >= 2) & ~F.col("item").rlike("^[_ ]+$")).join(table, ["variant", "item"], "left")
    tf, rf = F.col("c") / F.col("n"), F.col("per_million") / 1e6
    cands = cands.withColumn("pd", F.when(F.coalesce("per_million", F.lit(0.0)) == 0, F.lit(1e6)).otherwise((tf - rf) * 100 / rf)).withColumn("tf", tf)
    order = whole.orderBy(F.desc(F.round("pd", 6)), F.desc("c"), "first")
    return cands.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("keep")).select("doc_id", "variant", "item")


def gram_baseline(lists: DataFrame, floor: int = 5) -> DataFrame:
    """(variant, item, per_million): occurrences in a million items of the variant, from the corpus itself."""
    counts = lists.groupBy("variant", "item").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("variant").agg(F.sum("c").alias("n"))
    return counts.filter(F.col("c") >= floor).join(F.broadcast(total), "variant").select("variant", "item", (F.col("c") * 1e6 / F.col("n")).alias("per_million"))  # a row a variant


def source_comparison(pairs: DataFrame, lists: DataFrame, table: DataFrame) -> DataFrame:
    """(source, target, variant, share): how many of a target's items are keywords of its source."""
    keys = keywords(lists.join(pairs.select(F.col("source").alias("doc_id")).distinct(), "doc_id"), table)
    own = lists.groupBy("doc_id", "variant", "item").agg(F.count(F.lit(1)).alias("c"))
    target = pairs.join(own.withColumnRenamed("doc_id", "target"), "target")
    hit = target.join(keys.select(F.col("doc_id").alias("source"), "variant", "item", F.lit(1).alias("key")), ["source", "variant", "item"], "left")
    return hit.groupBy("source", "target", "variant").agg((F.sum(F.when(F.col("key") == 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("share"))


def merged_items(tables: list[DataFrame]) -> DataFrame:
    """(item, class, senses): one row for each item and class of several tables (item, class, senses), senses sorted and once each."""
    rows = tables[0].select("item", "class", "senses")
    for more in tables[1:]:
        rows = rows.unionByName(more.select("item", "class", "senses"))
    each = rows.select("item", "class", F.explode("senses").alias("s")).distinct()
    return each.groupBy("item", "class").agg(F.array_sort(F.collect_list("s")).alias("senses"))


def with_sense(matches: DataFrame, defaults: DataFrame) -> DataFrame:
    """``matches`` (.., item, class) with ``sense``: the default of the item in that class, else that of the item in any class, else null.

    ``defaults`` is (item, class, sense); a null class stands for any.
    """
    table = F.broadcast(defaults) if defaults.limit(LIMIT + 1).count() <= LIMIT else defaults
    own = table.filter(F.col("class").isNotNull()).select("item", "class", F.col("sense").alias("_own"))
    other = table.filter(F.col("class").isNull()).select("item", F.col("sense").alias("_any"))
    return matches.join(own, ["item", "class"], "left").join(other, "item", "left").withColumn("sense", F.coalesce("_own", "_any")).drop("_own", "_any")
