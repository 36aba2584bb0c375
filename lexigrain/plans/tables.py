"""Queries over words, vectors, events and profiles, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import lexicon as X
from lexigrain.operators import kernel
from lexigrain.operators import keyness as K
from lexigrain.operators import lookup as L
from lexigrain.operators import measures as M
from lexigrain.operators import profiles as P
from lexigrain.operators import sequence as S
from lexigrain.operators import vectors as V
from lexigrain.plans import oracle as O
from lexigrain.plans.registry import STOP, table
from lexigrain.storage import Scratch

LANGS = ["de", "en", "es", "fr"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def connective_matches(spark, sf_dir):
    return M.rounded(L.connectives(_docs(spark, sf_dir), L.inventory(spark)))


def word_baseline(spark, sf_dir):
    return L.baseline(table(spark, sf_dir, "documents").select("lang", "text"), "lang", LANGS)


def zipf_table(spark, sf_dir):
    return M.rounded(L.zipf_table(_docs(spark, sf_dir)))


def zipf_scores(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return M.rounded(L.zipf(docs, L.zipf_table(docs), STOP), 5)


def keyness(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    ids = docs.select("doc_id")
    pairs = ids.withColumnRenamed("doc_id", "source").join(ids.select((F.col("doc_id") - 1).alias("source"), F.col("doc_id").alias("target")), "source")
    return M.rounded(K.source_comparison(docs, pairs, Scratch(spark, "keyness")))


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")


def vector_adjacent(spark, sf_dir):
    return M.rounded(V.adjacent(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding"), 5)


def vector_cosine(spark, sf_dir):
    squares = lambda c: F.transform(c, lambda x: x.cast("double") * x.cast("double"))
    p = _pairs(spark, sf_dir)
    return M.rounded(p.select("vec_id", V.cosine(F.col("embedding"), F.col("next")).alias("cosine"), V.js_similarity(squares("embedding"), squares("next")).alias("js")), 5)


def vector_centred(spark, sf_dir):
    c = V.centred(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return M.rounded(c.select("vec_id", F.sqrt(V.dot(F.col("centred"), F.col("centred"))).alias("norm")), 5)


def vector_pooled(spark, sf_dir):
    p = V.pooled(table(spark, sf_dir, "embeddings"), ["label"], "embedding", V.sif_weight((F.col("vec_id") % 100 + 1) / 1000.0))
    return p.select("label", F.posexplode("pooled").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 4).alias("x"))


_ORDER = ["ts", "event_id"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


def events_rolling(spark, sf_dir):
    out = S.neighbour_median(S.rolling(_events(spark, sf_dir), "user_id", _ORDER, "value"), "user_id", _ORDER, "value")
    return M.rounded(out.select("event_id", "rolling_mean", "rolling_cv", "neighbour_median"), 5)


def events_rhythm(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = S.autocorrelation(e, "user_id", _ORDER, "value").join(S.npvi(e, "user_id", _ORDER, "value"), "user_id", "left")
    return M.rounded(out.join(S.thresholds(e, "user_id", "value"), "user_id"), 5)


def events_runs(spark, sf_dir):
    return S.runs(_events(spark, sf_dir), ["user_id"], _ORDER, F.col("value") > 20, 2)


def events_null(spark, sf_dir):
    return M.rounded(S.shuffled_null(_events(spark, sf_dir), "user_id", _ORDER, "value"), 8)


def _properties(spark, sf_dir):
    docs = M.with_readability(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return P.long(M.rounded(kernel.measures(docs, ["closed_connectives"])), ["doc_id", "lang", "source"])


def profile_ranges(spark, sf_dir):
    return P.profile(_properties(spark, sf_dir), ["source"])


def profile_compare(spark, sf_dir):
    values = _properties(spark, sf_dir)
    ranges = P.profile(values.filter("lang = 'en' and source = 'src1'"), [])
    flags = P.compare(values.select("doc_id", "property", "value"), ranges, [])
    family = F.when(F.col("property").rlike("^(flesch|automated)"), "readability").otherwise("connectives")
    top = P.strongest(flags, ["doc_id"], family)
    return top.select("doc_id", "family", "property", "side", F.round("spans", 2).alias("spans"))


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.length("text").alias("len"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("x", F.col("n_chars").cast("double")).withColumn("y", (F.col("quality") * 1000 + F.col("len") % 500).cast("double"))


def validate_spearman(spark, sf_dir):
    return M.rounded(P.spearman(_scored(spark, sf_dir), ["lang"], "x", "y"))


def validate_bootstrap(spark, sf_dir):
    return M.rounded(P.bootstrap(_scored(spark, sf_dir), ["lang"], "doc_id", "x", "y"), 5)


QUERIES = {f.__name__: f for f in (connective_matches, word_baseline, zipf_table, zipf_scores, keyness, vector_adjacent, vector_cosine, vector_centred, vector_pooled, events_rolling, events_rhythm, events_runs, events_null, profile_ranges, profile_compare, validate_spearman, validate_bootstrap)}

_ITEMS = ", ".join(f"('{r}', '{i}', {len(i.split())})" for r, items in L.CONNECTIVES.items() for i in items)
_MOST = max(len(i.split()) for items in L.CONNECTIVES.values() for i in items)
_GRAMS = " UNION ALL ".join(f"SELECT doc_id, sent, k, {n} AS n, w{''.join(f' || chr(32) || lead(w, {j}) OVER s' for j in range(1, n))} AS item FROM tok WINDOW s AS (PARTITION BY doc_id, sent ORDER BY k)" for n in range(1, _MOST + 1))
_COUNTS = r"SELECT {key} unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) AS word FROM documents"
_EV = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _mask_grams() -> str:
    uni = {"uni": "true", "n_uni": "c = 'NOUN'", "v_uni": "c = 'VERB'", "v_n_uni": "c IN ('VERB', 'NOUN')", "adj_uni": "c = 'ADJ'"}
    parts = [f"SELECT doc_id, '{k}' AS variant, l AS item, pos AS place FROM tok WHERE {t}" for k, t in uni.items()]
    for name, classes in L.MASKS.items():
        shown = "l" if classes is None else f"CASE WHEN c IN ({X.quoted(classes)}) THEN l ELSE '_' END"
        for n in (2, 3, 4):
            gram = "m" + "".join(f" || ' ' || lead(m, {j}) OVER s" for j in range(1, n))
            parts.append(f"SELECT doc_id, '{name}_{n}' AS variant, {gram} AS item, pos AS place FROM (SELECT doc_id, sent, k, pos, {shown} AS m FROM tok) WINDOW s AS (PARTITION BY doc_id, sent ORDER BY k)")
    return " UNION ALL ".join(parts)


def _properties_sql() -> str:
    from lexigrain.plans.registry import ORACLE_SQL as B

    names = ["flesch_reading_ease", "flesch_kincaid_grade", "automated_readability", "determiners", "all_demonstratives", "attended_demonstratives", "basic_connectives", "conjunctions", "disjunctions", "lexical_subordinators", "coordinating_conjuncts", "noun_ratio", "verb_ratio", "adj_ratio", "adv_ratio"]
    rows = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS property, {n}::DOUBLE AS value FROM a" for n in names)
    return f"a AS (SELECT * FROM ({B['readability']}) JOIN ({B['closed_connectives']}) USING (doc_id)), props AS (SELECT p.*, d.lang, d.source FROM ({rows}) p JOIN documents d USING (doc_id))"


#: Decimals round half up, as Spark does for doubles.
_HALF_UP = ", ".join(f"round({f}(value)::DECIMAL(24, 10), 4)::DOUBLE AS {n}" for f, n in (("min", "lo"), ("median", "med"), ("max", "hi")))
_SCORED = "SELECT doc_id, lang, n_chars::DOUBLE AS x, (quality * 1000 + length(text) % 500)::DOUBLE AS y FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL AND text IS NOT NULL"


def _spearman(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, count(DISTINCT round(x, 9)) AS kinds, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) ELSE 0 END AS rho FROM (
  SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0::DOUBLE AS ry FROM {source}) GROUP BY {by}"""


ORACLE_SQL = {
    "connective_matches": f"""WITH {O.TOKENS}, items AS (SELECT DISTINCT * FROM (VALUES {_ITEMS}) v(relation, item, n)), grams AS ({_GRAMS}),
met AS (SELECT g.doc_id, relation, sent, k, max(i.n) AS n FROM grams g JOIN items i ON g.item = i.item GROUP BY ALL),
m AS (SELECT doc_id, relation, list({{'s': sent, 'k': k, 'n': n, 'c': 0::BIGINT}} ORDER BY sent, k) AS m FROM met GROUP BY 1, 2),
f AS (SELECT doc_id, relation, list_reduce(m, lambda a, x: CASE WHEN x.s = a.s AND x.k < a.k THEN a ELSE {{'s': x.s, 'k': x.k + x.n, 'n': x.n, 'c': a.c + 1}} END, {{'s': -1::BIGINT, 'k': 0::BIGINT, 'n': 0::INTEGER, 'c': 0::BIGINT}}) AS r FROM m),
n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1)
SELECT doc_id, relation, r.c::BIGINT AS matches, round(r.c::DOUBLE / n, 6) AS rate FROM f JOIN n USING (doc_id)""",
    "word_baseline": f"WITH w AS ({_COUNTS.format(key='lang,')}) SELECT word, {', '.join(f'(count(*) FILTER (WHERE lang = {g!r}))::BIGINT AS {g}' for g in LANGS)}, count(*)::BIGINT AS total FROM w GROUP BY 1 HAVING count(*) >= 3",
    "zipf_table": f"WITH w AS ({_COUNTS.format(key='')}), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1) SELECT word, round(log10(n::DOUBLE / (SELECT sum(n) FROM c) * 1e9::DOUBLE), 6) AS zipf FROM c WHERE n >= 5",
    "zipf_scores": f"""WITH {O.TOKENS}, w_ AS ({_COUNTS.format(key='')}), c_ AS (SELECT word, count(*) AS n FROM w_ GROUP BY 1), z AS (SELECT word, log10(n::DOUBLE / (SELECT sum(n) FROM c_) * 1e9::DOUBLE) AS zipf FROM c_ WHERE n >= 5),
t AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM tok WHERE w NOT IN ({O.stop_sql(STOP)})),
s AS (SELECT doc_id, avg(zipf) AS m, stddev_pop(zipf) AS sd FROM t JOIN z ON t.w = z.word WHERE i <= 500 GROUP BY 1)
SELECT doc_id, round(coalesce(m, 0)::DOUBLE, 5) AS zipf_mean, round(coalesce(sd, 0)::DOUBLE, 5) AS zipf_std FROM documents LEFT JOIN s USING (doc_id)""",
    "keyness": f"""WITH {O.TOKENS}, lists AS (SELECT * FROM ({_mask_grams()}) WHERE item IS NOT NULL),
own AS (SELECT doc_id, variant, item, count(*) AS c, min(place) AS first FROM lists GROUP BY ALL),
corpus AS (SELECT variant, item, sum(c) AS c FROM own GROUP BY ALL), totals AS (SELECT variant, sum(c) AS n FROM corpus GROUP BY 1),
base AS (SELECT variant, item, c * 1e6::DOUBLE / n AS pm FROM corpus JOIN totals USING (variant) WHERE c >= 5),
sized AS (SELECT *, sum(c) OVER s AS n, floor(count(*) OVER s * 0.1::DOUBLE) AS keep FROM own WINDOW s AS (PARTITION BY doc_id, variant)),
cands AS (SELECT s.*, CASE WHEN coalesce(pm, 0) = 0 THEN 1e6::DOUBLE ELSE (c / n::DOUBLE - pm / 1e6::DOUBLE) * 100 / (pm / 1e6::DOUBLE) END AS pd FROM sized s LEFT JOIN base USING (variant, item) WHERE c >= 2 AND NOT regexp_matches(item, '^[_ ]+$')),
keys AS (SELECT doc_id, variant, item FROM cands QUALIFY row_number() OVER (PARTITION BY doc_id, variant ORDER BY round(pd, 6) DESC, c DESC, first) <= keep),
pairs AS (SELECT a.doc_id AS source, b.doc_id AS target FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT p.source, p.target, o.variant, round(coalesce(sum(o.c) FILTER (WHERE k.item IS NOT NULL), 0)::DOUBLE / sum(o.c), 6) AS share
FROM pairs p JOIN own o ON o.doc_id = p.target LEFT JOIN keys k ON k.doc_id = p.source AND k.variant = o.variant AND k.item = o.item GROUP BY ALL""",
    "vector_adjacent": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT label, v, lead(v, 1) OVER w AS a, lead(v, 2) OVER w AS b FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT label, list_cosine_similarity(v, a) AS one, CASE WHEN b IS NOT NULL THEN list_cosine_similarity(v, list_transform(list_zip(a, b), lambda x: x[1] + x[2])) END AS two FROM n)
SELECT label, count(*)::BIGINT AS n, round(coalesce(avg(one), 0), 5) AS next_mean, round(coalesce(stddev_pop(one), 0), 5) AS next_std, round(coalesce(min(one), 0), 5) AS next_min, round(coalesce(max(one), 0), 5) AS next_max, round(coalesce(avg(two), 0), 5) AS next_two FROM c GROUP BY 1""",
    "vector_cosine": """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
q AS (SELECT vec_id, a, b, list_transform(a, lambda x: x * x) AS sa, list_transform(b, lambda x: x * x) AS sb FROM p),
r AS (SELECT *, list_transform(sa, lambda x: x / list_sum(sa)) AS pa, list_transform(sb, lambda x: x / list_sum(sb)) AS pb FROM q),
t AS (SELECT vec_id, a, b, list_sum(list_transform(list_zip(pa, pb), lambda x: CASE WHEN x[1] > 0 THEN x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) ELSE 0 END)) AS d FROM r)
SELECT vec_id, round(list_cosine_similarity(a, b), 5) AS cosine, round(1 - d / 2, 5) AS js FROM t""",
    "vector_centred": """WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM x GROUP BY 1)
SELECT vec_id, round(sqrt(sum((x.x - m) * (x.x - m))), 5) AS norm FROM x JOIN m USING (i) GROUP BY 1""",
    "vector_pooled": """WITH x AS (SELECT label, 0.001::DOUBLE / (0.001::DOUBLE + (vec_id % 100 + 1) / 1000.0::DOUBLE) AS w, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding)))::BIGINT AS i FROM embeddings)
SELECT label, i, round(sum(w * x), 4) AS x FROM x GROUP BY 1, 2""",
    "events_rolling": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT event_id, user_id, i, greatest(1, least(i - 2, n - 4)) AS s, n FROM a),
r AS (SELECT b.event_id, avg(a.value) AS m, stddev_pop(a.value) AS sd FROM b JOIN a ON a.user_id = b.user_id AND a.i BETWEEN b.s AND b.s + 4 GROUP BY 1),
k AS (SELECT b.event_id, median(a.value) AS med, count(*) AS c FROM b JOIN a ON a.user_id = b.user_id AND a.i BETWEEN b.i - 3 AND b.i + 3 AND a.i != b.i GROUP BY 1)
SELECT event_id, round(m, 5) AS rolling_mean, round(CASE WHEN m = 0 THEN 0 ELSE sd / m END, 5) AS rolling_cv, round(CASE WHEN c >= 2 THEN med END, 5) AS neighbour_median FROM r LEFT JOIN k USING (event_id)""",
    "events_rhythm": f"""WITH a AS (SELECT user_id, value, avg(value) OVER (PARTITION BY user_id) AS m, lead(value) OVER w AS nx FROM events {_EV}),
b AS (SELECT user_id, count(value) AS n, sum((value - m) * (nx - m)) AS c, sum((value - m) * (value - m)) AS s, avg(CASE WHEN nx IS NOT NULL AND value + nx != 0 THEN abs(value - nx) / ((value + nx) / 2) END) * 100 AS npvi,
  {', '.join(f'quantile_cont(value, {q}) AS p{round(100 * q)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM a GROUP BY 1)
SELECT user_id, n::BIGINT AS n, round(CASE WHEN n < 3 OR s = 0 THEN 0 ELSE c / s END, 5) AS lag1, round(npvi, 5) AS npvi, {', '.join(f'round(p{p}, 5) AS p{p}' for p in (10, 25, 50, 75, 90))} FROM b""",
    "events_runs": """WITH a AS (SELECT user_id, value > 20 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
b AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM a WHERE f)
SELECT user_id, min(i)::BIGINT AS first, max(i)::BIGINT AS last, count(*)::BIGINT AS length FROM b GROUP BY user_id, g HAVING count(*) >= 2""",
    "events_null": """WITH a AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT a.*, rep, CASE WHEN rep = 0 THEN lpad(i::VARCHAR, 12, '0') ELSE md5('1729:' || rep || ':' || user_id || ':' || i) END AS k FROM a, range(0, 21) r(rep)),
s AS (SELECT user_id, rep, abs(v - lead(v) OVER (PARTITION BY user_id, rep ORDER BY k, i)) AS d FROM c),
m AS (SELECT user_id, rep, coalesce(avg(d), 0) AS m FROM s GROUP BY 1, 2),
o AS (SELECT user_id, max(m) FILTER (WHERE rep = 0) AS observed, avg(m) FILTER (WHERE rep > 0) AS null_mean, stddev_pop(m) FILTER (WHERE rep > 0) AS null_sd FROM m GROUP BY 1)
SELECT user_id, round(observed, 8) AS observed, round(null_mean, 8) AS null_mean, round(null_sd, 8) AS null_sd, round(CASE WHEN null_sd < 1e-9 THEN 0 ELSE (observed - null_mean) / null_sd END, 8) AS z FROM o""",
    "profile_ranges": f"WITH {_properties_sql()} SELECT source, property, count(value)::BIGINT AS samples, {_HALF_UP} FROM props GROUP BY 1, 2",
    "profile_compare": f"""WITH {_properties_sql()},
r AS (SELECT property, {_HALF_UP} FROM props WHERE lang = 'en' AND source = 'src1' GROUP BY 1),
j AS (SELECT doc_id, p.property, value, lo, hi, greatest(hi - lo, 0.25::DOUBLE * abs(med), 1e-9::DOUBLE) AS span, CASE WHEN regexp_matches(p.property, '^(flesch|automated)') THEN 'readability' ELSE 'connectives' END AS family FROM props p JOIN r USING (property)),
f AS (SELECT *, CASE WHEN value < lo THEN 'below' ELSE 'above' END AS side, CASE WHEN value < lo THEN lo - value ELSE value - hi END / span AS spans FROM j WHERE value < lo - 0.15::DOUBLE * span OR value > hi + 0.15::DOUBLE * span)
SELECT doc_id, family, property, side, round(spans, 2) AS spans FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, family ORDER BY spans DESC, property) <= 2""",
    "validate_spearman": f"WITH p AS ({_SCORED}), s AS ({_spearman('p', 'lang')}) SELECT lang, n::BIGINT AS n, round(rho, 6) AS rho, CASE WHEN n < 10 THEN 'too few' WHEN kinds < 8 THEN 'flat' WHEN rho >= 0.8 THEN 'pass' ELSE 'fail' END AS status FROM s",
    "validate_bootstrap": f"""WITH p AS ({_SCORED}), a AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM p),
d AS (SELECT lang, rep, ('0x' || substr(md5('11:' || rep || ':' || i), 1, 12))::BIGINT % n AS i FROM a, range(1, 401) r(rep)),
x AS (SELECT d.lang, d.rep, a.x, a.y FROM d JOIN a USING (lang, i)), s AS ({_spearman('x', 'lang, rep')})
SELECT lang, round(quantile_cont(rho, 0.05), 5) AS lower FROM s GROUP BY 1""",
}
