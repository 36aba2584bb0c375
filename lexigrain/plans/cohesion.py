"""Queries over passages, sentence pairs, blends, senses and vocabularies, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.operators import corpus as C
from lexigrain.operators import lookup as L
from lexigrain.operators import measures as M
from lexigrain.operators import models as D
from lexigrain.operators import passages as P
from lexigrain.operators import semantic as S
from lexigrain.operators import surface as U
from lexigrain.operators.annotate import flat
from lexigrain.plans import oracle as O
from lexigrain.plans import tables
from lexigrain.plans.registry import STOP, table
from lexigrain.storage import Scratch


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def passage_sentences(spark, sf_dir):
    return M.rounded(P.block_sentences(_docs(spark, sf_dir), frozenset(STOP)))


def passage_patterns(spark, sf_dir):
    return M.rounded(P.patterns(_docs(spark, sf_dir), frozenset(STOP)))


def passage_summary(spark, sf_dir):
    return M.rounded(P.summary(_docs(spark, sf_dir), frozenset(STOP)))


def sentence_pairs(spark, sf_dir):
    pairs = S.sentence_pairs(_docs(spark, sf_dir))
    return pairs.select("doc_id", "place", F.md5("first").alias("first_md5"), F.md5("second").alias("second_md5"))


# route, component, mean, sd, a, b
ROUTES = [("both", "cosine", 0.1, 0.2, 0.5, 0.25), ("both", "js", 0.6, 0.125, 0.5, 0.25), ("cosine", "cosine", 0.0, 0.5, 0.0, 1.0)]


def vector_blend(spark, sf_dir):
    """Two routes over the rounded cosine and divergence of neighbouring vectors."""
    scores = tables.vector_cosine(spark, sf_dir)
    values = scores.select("vec_id", F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in ("cosine", "js")])).alias("x")).select("vec_id", "x.*")
    return M.rounded(S.blend(values, spark.createDataFrame(ROUTES, "route string, component string, mean double, sd double, a double, b double"), ["vec_id"]), 9)


def vector_without_axes(spark, sf_dir):
    """Norms of vectors without their mean and two leading axes."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    mean, leading = S.axes(vectors, "embedding", 2)
    left = vectors.select("vec_id", S.without_axes(F.col("embedding"), mean, leading).alias("v"))
    return M.rounded(left.select("vec_id", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")), 4)


def fragment_lines(spark, sf_dir):
    return M.rounded(_docs(spark, sf_dir).select("doc_id", U.fragment_share(F.col("text")).alias("fragment_share")))


def vector_tokens(spark, sf_dir):
    tokens = U.vector_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("tokens_md5"))


def vocabulary_ids(spark, sf_dir):
    return C.numbered(L.word_counts(_docs(spark, sf_dir)), Scratch(spark, "vocabulary"))


# item, class, senses
ITEMS = [("and", "CONJ", ["addition"]), ("while", "CONJ", ["contrast", "temporal"]), ("as", "CONJ", ["cause"]), ("so", "CONJ", ["result"]), ("before", "ADP", ["temporal"])]
MORE_ITEMS = [("as", "CONJ", ["temporal", "cause"]), ("so", "CONJ", ["purpose"]), ("also", "ADV", ["addition"])]
DEFAULTS = [("and", "CONJ", "addition"), ("as", "CONJ", "cause"), ("as", None, "reference"), ("for", None, "purpose"), ("before", "ADP", "temporal"), ("so", "ADV", "degree"), ("so", None, "result")]


def _items(spark, rows):
    return spark.createDataFrame(rows, "item string, class string, senses array<string>")


def merged_items(spark, sf_dir):
    """Two inventories as one, and how often the corpus has each item."""
    counts = L.word_counts(_docs(spark, sf_dir)).withColumnRenamed("word", "item")
    merged = L.merged_items([_items(spark, ITEMS), _items(spark, MORE_ITEMS)])
    return merged.join(counts, "item", "left").select("item", "class", F.array_join("senses", " ").alias("senses"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def connective_senses(spark, sf_dir):
    """How often each document has each sense, by default senses."""
    defaults = spark.createDataFrame(DEFAULTS, "item string, class string, sense string")
    words = flat(_docs(spark, sf_dir)).select("doc_id", F.explode("toks").alias("t")).select("doc_id", F.col("t.w").alias("item"), F.col("t.c").alias("class"))
    return L.with_sense(words, defaults).filter("sense IS NOT NULL").groupBy("doc_id", "sense").agg(F.count(F.lit(1)).alias("n"))


def label_agreement(spark, sf_dir):
    """The quality label against a rule on the length of the text."""
    d = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return M.rounded(D.agreement(d.withColumn("guess", F.when(F.length("text") > 1500, 1).otherwise(0)), "quality", "guess"))


QUERIES = {
    f.__name__: f
    for f in (passage_sentences, passage_patterns, passage_summary, sentence_pairs, vector_blend, vector_without_axes, fragment_lines, vector_tokens, vocabulary_ids, merged_items, connective_senses, label_agreement)
}


def _values(rows) -> str:
    show = lambda x: "NULL" if x is None else str(x) + "::DOUBLE" if isinstance(x, float) else f"[{', '.join(map(show, x))}]" if isinstance(x, list) else f"'{x}'"
    return "VALUES " + ", ".join(f"({', '.join(map(show, r))})" for r in rows)


_LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x != '')"

ORACLE_SQL = {
    "sentence_pairs": rf"""WITH {O.TOKENS}, s AS (SELECT doc_id, para, sent, replace(t, chr(2), '.') AS t FROM sent),
pairs AS (
  SELECT a.doc_id, 0 AS p, a.sent AS i, b.sent AS j, a.t AS x, b.t AS y FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.sent = a.sent + 1
  UNION ALL SELECT a.doc_id, 1, a.sent, b.sent, a.t, b.t FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.para = a.para + 1
  UNION ALL SELECT a.doc_id, 2, a.sent, b.sent, a.t, b.t FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.para = a.para AND b.sent > a.sent),
once AS (SELECT * FROM pairs WHERE x <> y QUALIFY row_number() OVER (PARTITION BY doc_id, least(x, y), greatest(x, y) ORDER BY p, i, j) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, i, j) - 1 AS place FROM once),
most AS (SELECT doc_id, greatest(50, 100 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) // 1000) AS most FROM documents)
SELECT doc_id, place::BIGINT AS place, md5(x) AS first_md5, md5(y) AS second_md5 FROM placed JOIN most USING (doc_id) WHERE place < most""",
    "vector_blend": f"""WITH c AS ({tables.ORACLE_SQL['vector_cosine']}), v AS (SELECT vec_id, 'cosine' AS component, cosine AS value FROM c UNION ALL SELECT vec_id, 'js', js FROM c),
r(route, component, mean, sd, a, b) AS ({_values(ROUTES)})
SELECT vec_id, route, round(any_value(a) + any_value(b) * avg(coalesce((value - mean) / sd, 0)), 9) AS value FROM v JOIN r USING (component) GROUP BY 1, 2""",
    "fragment_lines": rf"""WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents)
SELECT doc_id, round(len(list_filter(l, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < {U.FULL_WORDS} OR NOT regexp_matches(x, '{U.FULL_END.replace("'", "''")}')))::DOUBLE / greatest(len(l), 1), 6) AS fragment_share FROM l""",
    "vector_tokens": f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(lower(coalesce(text, '')), '’‘', ''''''), '{U.TOKEN.replace("'", "''")}') AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(coalesce(array_to_string(t, ' '), '')) AS tokens_md5 FROM t""",
    "vocabulary_ids": rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS word FROM documents), c AS (SELECT word, count(*) AS count FROM w GROUP BY 1)
SELECT word, count, (row_number() OVER (ORDER BY count DESC, word) - 1)::BIGINT AS id FROM c""",
    "merged_items": rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS item FROM documents), n AS (SELECT item, count(*) AS n FROM w GROUP BY 1),
i(item, class, senses) AS ({_values(ITEMS + MORE_ITEMS)}), m AS (SELECT item, class, array_to_string(list_sort(list_distinct(flatten(list(senses)))), ' ') AS senses FROM i GROUP BY 1, 2)
SELECT item, class, senses, coalesce(n, 0)::BIGINT AS count FROM m LEFT JOIN n USING (item)""",
    "connective_senses": f"""WITH {O.TOKENS}, d(item, class, sense) AS ({_values(DEFAULTS)}),
s AS (SELECT doc_id, coalesce(o.sense, a.sense) AS sense FROM tok LEFT JOIN d o ON o.item = w AND o.class = c LEFT JOIN d a ON a.item = w AND a.class IS NULL)
SELECT doc_id, sense, count(*)::BIGINT AS n FROM s WHERE sense IS NOT NULL GROUP BY 1, 2""",
    "label_agreement": """WITH d AS (SELECT quality AS g, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
k AS (SELECT DISTINCT unnest([g, p]) AS class FROM d), n AS (SELECT class, count(*) FILTER (WHERE g = class) AS support, count(*) FILTER (WHERE p = class) AS given, count(*) FILTER (WHERE g = class AND p = class) AS met FROM k, d GROUP BY 1)
SELECT class, support::BIGINT AS support, round(CASE WHEN given > 0 THEN met::DOUBLE / given ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN met::DOUBLE / support ELSE 0 END, 6) AS recall,
  round(2 * met::DOUBLE / (support + given), 6) AS f1, round((SELECT count(*) FILTER (WHERE g = p)::DOUBLE / count(*) FROM d), 6) AS accuracy FROM n""",
}
