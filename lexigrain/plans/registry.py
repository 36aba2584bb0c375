"""Registered queries over the driver's tables, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrain.functions import lexicon as X
from lexigrain.operators import measures as M
from lexigrain.plans import oracle as O

#: The default stop list of the queries; operators take any list.
STOP = sorted({*X.PERSONAL, *X.DEMONSTRATIVES, *X.ARTICLES, *X.COORDINATORS, *X.AUXILIARIES, *X.PREPOSITIONS, *X.SUBORDINATORS, *X.ADVERBS, *X.WH_ADVERBS})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(measure, *args):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return M.rounded(measure(table(spark, sf_dir, "documents").select("doc_id", "text"), *args))

    return run


QUERIES: dict = {
    "adjacent_overlap": _documents(lambda d: M.overlap(d, ("all",), ("sent",)).drop("level", "class")),
    "overlap_all_classes": _documents(M.overlap),
    "basic_counts": _documents(M.basic, STOP),
    "readability": _documents(M.readability),
    "lexical_diversity": _documents(M.diversity),
    "mtld": _documents(M.mtld, STOP),
    "givenness": _documents(M.givenness),
    "closed_connectives": _documents(M.closed_connectives),
    "word_chunks": _documents(M.chunks),
}


def _overlap_sql(classes, levels, labelled: bool) -> str:
    parts = []
    for level in levels:
        spine = "SELECT doc_id, sent AS seg FROM sent" if level == "sent" else "SELECT doc_id, para AS seg FROM paras"
        key = "sent" if level == "sent" else "para"
        for name in classes:
            parts.append(f"""SELECT '{level}' AS level, '{name}' AS class, s.doc_id, s.seg, coalesce(t.s, []) AS s
  FROM ({spine}) s LEFT JOIN (SELECT doc_id, {key} AS seg, list(DISTINCT l) AS s FROM tok WHERE {X.member(name, 'w', 'c')} GROUP BY 1, 2) t USING (doc_id, seg)""")
    label = "level, class, " if labelled else ""
    return f"""WITH {O.TOKENS},
segs AS ({' UNION ALL '.join(parts)}),
pairs AS (
  SELECT *, lead(s, 1) OVER w AS n1, lead(s, 2) OVER w AS n2 FROM segs WINDOW w AS (PARTITION BY level, class, doc_id ORDER BY seg)),
o AS (
  SELECT level, class, doc_id, len(s) AS d,
    CASE WHEN n1 IS NOT NULL THEN len(list_intersect(s, n1)) END AS o1,
    CASE WHEN n2 IS NOT NULL THEN len(list_intersect(s, list_concat(n1, n2))) END AS o2 FROM pairs),
agg AS (
  SELECT level, class, doc_id, coalesce(sum(o1), 0) AS s1, coalesce(sum(d) FILTER (WHERE o1 IS NOT NULL), 0) AS d1, count(o1) AS k1, count(*) FILTER (WHERE o1 > 0) AS b1,
    coalesce(sum(o2), 0) AS s2, coalesce(sum(d) FILTER (WHERE o2 IS NOT NULL), 0) AS d2, count(o2) AS k2, count(*) FILTER (WHERE o2 > 0) AS b2
  FROM o GROUP BY 1, 2, 3),
every AS (SELECT doc_id, level, class FROM documents, (SELECT DISTINCT level, class FROM segs))
SELECT doc_id, {label}
  round({O.ratio('coalesce(s1, 0)', 'coalesce(d1, 0)')}, 6) AS overlap, round({O.ratio('coalesce(s1, 0)', 'coalesce(k1, 0)')}, 6) AS overlap_div_seg, round({O.ratio('coalesce(b1, 0)', 'coalesce(k1, 0)')}, 6) AS binary,
  round({O.ratio('coalesce(s2, 0)', 'coalesce(d2, 0)')}, 6) AS overlap_2, round({O.ratio('coalesce(s2, 0)', 'coalesce(k2, 0)')}, 6) AS overlap_2_div_seg, round({O.ratio('coalesce(b2, 0)', 'coalesce(k2, 0)')}, 6) AS binary_2
FROM every LEFT JOIN agg USING (doc_id, level, class)"""


def _diversity_sql() -> str:
    plain = ("content", "function", "noun", "verb", "adj", "adv", "prp", "argument")
    ttr = lambda p: O.ratio(f"count(DISTINCT l) FILTER (WHERE {p})", f"count(l) FILTER (WHERE {p})")

    def moving(name: str) -> str:
        return f"""{name}_w AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM tok WHERE {X.member(name, 'w', 'c')}),
{name}_win AS (SELECT doc_id, n, i, len(list_distinct(list(l) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))) AS d FROM {name}_w),
{name}_m AS (SELECT doc_id, sum(d)::DOUBLE / (50 * count(*)) AS m FROM {name}_win WHERE i >= 50 AND n > 50 GROUP BY 1)"""

    members = {n: X.member(n, "w", "c") for n in X.CLASSES}
    return f"""WITH {O.TOKENS}, {moving('all')}, {moving('function')},
grams AS (SELECT doc_id, pos, CASE WHEN lead(l, 1) OVER w IS NOT NULL THEN l || ' ' || lead(l, 1) OVER w END AS bi, CASE WHEN lead(l, 2) OVER w IS NOT NULL THEN l || ' ' || lead(l, 1) OVER w || ' ' || lead(l, 2) OVER w END AS tri FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, {O.ratio('count(DISTINCT bi)', 'count(bi)')} AS bi, {O.ratio('count(DISTINCT tri)', 'count(tri)')} AS tri FROM grams GROUP BY 1),
base AS (SELECT d.doc_id, {', '.join(f'{ttr(members[n])} AS {n}_ttr' for n in X.CLASSES)},
  {O.ratio(f"count(l) FILTER (WHERE {members['content']})", 'count(l)')} AS dens, {O.ratio(f"count(DISTINCT l) FILTER (WHERE {members['content']})", 'count(DISTINCT l)')} AS dens_types
  FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY 1)
SELECT doc_id, round(all_ttr, 6) AS lemma_ttr, round(coalesce(a.m, all_ttr), 6) AS lemma_mattr, round(coalesce(f.m, function_ttr), 6) AS function_mattr,
  round(dens, 6) AS lexical_density_tokens, round(dens_types, 6) AS lexical_density_types, {', '.join(f'round({n}_ttr, 6) AS {n}_ttr' for n in plain)},
  round(coalesce(bi, 0), 6) AS bigram_lemma_ttr, round(coalesce(tri, 0), 6) AS trigram_lemma_ttr
FROM base LEFT JOIN g USING (doc_id) LEFT JOIN all_m a USING (doc_id) LEFT JOIN function_m f USING (doc_id)"""


_S = O.stop_sql(STOP)
_DEM = X.quoted(X.DEMONSTRATIVES)
_NEXT = "coalesce(lead(c) OVER (PARTITION BY doc_id, sent ORDER BY k), '')"

ORACLE_SQL: dict[str, str] = {
    "adjacent_overlap": _overlap_sql(("all",), ("sent",), False),
    "overlap_all_classes": _overlap_sql(X.CLASSES, ("sent", "para"), True),
    "basic_counts": rf"""WITH {O.TOKENS},
t AS (SELECT doc_id, count(w) AS n, count(DISTINCT w) AS d FROM tok WHERE w NOT IN ({_S}) GROUP BY 1),
len_ AS (SELECT doc_id, avg(n) AS m, stddev_pop(n) AS s FROM (SELECT doc_id, sent, count(*) AS n FROM tok GROUP BY 1, 2) GROUP BY 1),
ns AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY 1)
SELECT doc_id, coalesce(t.n, 0)::BIGINT AS n_tokens, coalesce(t.d, 0)::BIGINT AS n_types, coalesce(ns.n, 0)::BIGINT AS n_sentences,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: regexp_matches(x, '\S')))::BIGINT AS n_paragraphs,
  round(coalesce(t.d, 0)::DOUBLE / greatest(coalesce(t.n, 0), 1), 6) AS type_token_ratio, round(coalesce(m, 0)::DOUBLE, 6) AS sent_len_mean, round(coalesce(s, 0)::DOUBLE, 6) AS sent_len_std,
  round(coalesce(s / (m + 1e-8), 0)::DOUBLE, 6) AS sent_len_cv, length(coalesce(text, ''))::BIGINT AS text_length, len(regexp_extract_all(coalesce(text, ''), '\S+'))::BIGINT AS word_count
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN len_ USING (doc_id) LEFT JOIN ns USING (doc_id)""",
    "readability": r"""WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(t, '''($|[^tsdvlr])', '\1', 'g'), '[^\p{L}\p{N}_\s'']', '', 'g'), '\s+'), lambda x: x != '') AS w,
  greatest((t != '')::INT, len(list_filter(regexp_extract_all(t, '[^.!?]+[.!?]*'), lambda x: len(regexp_extract_all(x, '\S+')) > 2))) AS s, length(regexp_replace(t, '\s', '', 'g')) AS chars, len(regexp_extract_all(t, '\S+')) AS raw FROM a),
c AS (SELECT doc_id, s, chars, raw, len(w)::DOUBLE AS n, coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouyàâäáéèêëíîïóôöúùûü]+'))))), 0)::DOUBLE AS syl FROM b)
SELECT doc_id, round(CASE WHEN n = 0 OR s = 0 THEN 0 ELSE 206.835::DOUBLE - 1.015::DOUBLE * (n / s) - 84.6::DOUBLE * (syl / n) END, 6) AS flesch_reading_ease,
  round(CASE WHEN n = 0 OR s = 0 THEN 0 ELSE 0.39::DOUBLE * (n / s) + 11.8::DOUBLE * (syl / n) - 15.59::DOUBLE END, 6) AS flesch_kincaid_grade,
  round(CASE WHEN n = 0 OR s = 0 OR raw = 0 THEN 0 ELSE 4.71::DOUBLE * (chars / raw::DOUBLE) + 0.5::DOUBLE * (n / s) - 21.43::DOUBLE END, 6) AS automated_readability FROM c""",
    "lexical_diversity": _diversity_sql(),
    "mtld": rf"""WITH RECURSIVE {O.TOKENS},
t AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM tok WHERE w NOT IN ({_S})),
both_ AS (SELECT doc_id, 1 AS way, i, n, w FROM t WHERE n >= 50 UNION ALL SELECT doc_id, 2, n + 1 - i, n, w FROM t WHERE n >= 50),
lists AS (SELECT doc_id, way, max(n) AS n, list({{'w': w}} ORDER BY i) AS w FROM both_ GROUP BY 1, 2),
run AS (
  SELECT doc_id, way, n, list_reduce(list_transform(w, lambda x: {{'f': 0.0::DOUBLE, 'k': 0::BIGINT, 'seen': [x.w]}}),
    lambda a, x: CASE WHEN len(list_distinct(list_concat(a.seen, x.seen)))::DOUBLE / (a.k + 1) <= 0.72
      THEN {{'f': a.f + 1.0, 'k': 0::BIGINT, 'seen': []::VARCHAR[]}}
      ELSE {{'f': a.f, 'k': a.k + 1, 'seen': list_distinct(list_concat(a.seen, x.seen))}} END, {{'f': 0.0::DOUBLE, 'k': 0::BIGINT, 'seen': []::VARCHAR[]}}) AS r FROM lists),
f AS (SELECT doc_id, n, r.f + CASE WHEN r.k > 0 THEN (1 - len(r.seen)::DOUBLE / r.k) / (1 - 0.72::DOUBLE) ELSE 0 END AS f FROM run),
m AS (SELECT doc_id, avg(CASE WHEN f = 0 THEN n ELSE n / f END) AS v FROM f GROUP BY 1)
SELECT doc_id, round(coalesce(v, 0)::DOUBLE, 6) AS mtld_score FROM documents LEFT JOIN m USING (doc_id)""",
    "givenness": rf"""WITH {O.TOKENS},
x AS (SELECT *, {_NEXT} AS nxt FROM tok),
k AS (SELECT doc_id, l, c IN ('NOUN', 'VERB', 'ADJ', 'ADV') AS content, c = 'NOUN' AS noun, l IN ({X.quoted(X.THIRD_PERSON)}) AS third, w IN ({_DEM}) AND nxt NOT IN ('NOUN', 'ADJ', 'NUM') AS alone FROM x),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE noun) AS nouns, count(*) FILTER (WHERE third) + count(*) FILTER (WHERE alone) AS giv FROM k GROUP BY 1),
rep AS (
  SELECT doc_id, sum(a) FILTER (WHERE a > 1) AS a, sum(b) FILTER (WHERE b > 1) AS b, sum(e) FILTER (WHERE e > 1) AS e FROM (
    SELECT doc_id, l, count(*) FILTER (WHERE content) AS a, count(*) FILTER (WHERE third) AS b, count(*) FILTER (WHERE alone) AS e FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, round({O.ratio('coalesce(giv, 0)', 'coalesce(n, 0)')}, 6) AS pronoun_density, round({O.ratio('coalesce(giv, 0)', 'coalesce(nouns, 0)')}, 6) AS pronoun_noun_ratio,
  round({O.ratio('coalesce(a, 0)', 'coalesce(n, 0)')}, 6) AS repeated_content_lemmas, round({O.ratio('coalesce(a, 0) + coalesce(b, 0) + coalesce(e, 0)', 'coalesce(n, 0)')}, 6) AS repeated_content_and_pronoun_lemmas
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id)""",
    "closed_connectives": rf"""WITH {O.TOKENS},
x AS (SELECT *, {_NEXT} AS nxt, c IN ('NOUN', 'VERB', 'ADJ', 'ADV') AS content FROM tok)
SELECT doc_id, {', '.join(f"round({O.ratio(f'count(w) FILTER (WHERE {p})', 'count(w)')}, 6) AS {n}" for n, p in {
        'determiners': f"w IN ({X.quoted(X.ARTICLES + X.DEMONSTRATIVES)})",
        'all_demonstratives': f"w IN ({_DEM})",
        'attended_demonstratives': f"w IN ({_DEM}) AND nxt IN ('NOUN', 'ADJ', 'NUM')",
        'basic_connectives': "w IN ('and', 'nor', 'but', 'or', 'yet', 'so')",
        'conjunctions': "w IN ('and', 'but')",
        'disjunctions': "w IN ('or')",
        'lexical_subordinators': f"w IN ({X.quoted(X.SUBORDINATORS)})",
        'coordinating_conjuncts': f"w IN ({X.quoted(X.CONJUNCT_COORDINATORS)})",
    }.items())}, {', '.join(f"round({O.ratio(f'count(w) FILTER (WHERE c = {c.upper()!r})', 'count(w) FILTER (WHERE content)')}, 6) AS {c}_ratio" for c in ('noun', 'verb', 'adj', 'adv'))}
FROM documents LEFT JOIN x USING (doc_id) GROUP BY 1""",
    "word_chunks": r"""WITH lines AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: len(regexp_extract_all(x, '\S+'))), lambda n: n > 0) AS n FROM documents),
run AS (SELECT doc_id, list_reduce(list_transform(n, lambda x: {'done': [x], 'n': x}), lambda a, x: CASE WHEN a.n + x.n >= 300 THEN {'done': list_append(a.done, a.n + x.n), 'n': 0::BIGINT} ELSE {'done': a.done, 'n': a.n + x.n} END, {'done': []::BIGINT[], 'n': 0::BIGINT}) AS r FROM lines WHERE len(n) > 0),
c AS (SELECT doc_id, CASE WHEN r.n = 0 THEN r.done WHEN len(r.done) > 0 AND r.n * 2 < 300 THEN list_append(r.done[1:len(r.done) - 1], r.done[len(r.done)] + r.n) ELSE list_append(r.done, r.n) END AS c FROM run)
SELECT doc_id, unnest(range(0, len(c)))::BIGINT AS chunk, unnest(c)::BIGINT AS n_words FROM c""",
}
