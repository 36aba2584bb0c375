"""Queries over blocks, sentences, pages, versions and question batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrain.operators import cadence as C
from lexigrain.operators import judge as J
from lexigrain.operators import kernels as K
from lexigrain.operators import measures as M
from lexigrain.plans import oracle as O
from lexigrain.plans.registry import table
from lexigrain.sources import readers as R


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def cadence_sentences(spark, sf_dir):
    return M.rounded(C.sentences(_docs(spark, sf_dir)))


def cadence_patterns(spark, sf_dir):
    return C.patterns(_docs(spark, sf_dir))


def cadence_blocks(spark, sf_dir):
    return C.blocks(_docs(spark, sf_dir))


def align_versions(spark, sf_dir):
    """Each text against the next document's."""
    d = _docs(spark, sf_dir)
    after = d.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("after"))
    return C.align(d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("before")).join(after, "pair_id"))


def page_paragraphs(spark, sf_dir):
    return R.page_paragraphs(table(spark, sf_dir, "pages"))


def full_tokens(spark, sf_dir):
    return K.tokenized(_docs(spark, sf_dir)).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.array_join("tokens", "\n"), 256).alias("tokens_sha256"))


def question_batches(spark, sf_dir):
    return J.batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", budget=200, most=4)


def judged_turns(spark, sf_dir):
    """The stub's answers to one question about each turn."""
    turns = table(spark, sf_dir, "conversations")
    questions = turns.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.array(*map(F.lit, "0123")).alias("criteria"))
    return J.ask(questions).select("id", "choice", F.round(J.expected_level(F.col("probabilities")), 6).alias("level"))


QUERIES = {f.__name__: f for f in (cadence_sentences, cadence_patterns, cadence_blocks, align_versions, page_paragraphs, full_tokens, question_batches, judged_turns)}

_SENTENCES = f"""{O.TOKENS},
s0 AS (
  SELECT doc_id, sent AS s, count(*) AS n, arg_min(w, k) AS opening, string_agg(substr(c, 1, 2), '' ORDER BY k) AS shape,
    coalesce(list(DISTINCT l) FILTER (WHERE c IN ('NOUN', 'VERB', 'ADJ', 'ADV')), []) AS lemmas
  FROM tok GROUP BY 1, 2),
s1 AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(lemmas) OVER w AS pl, lag(opening) OVER w AS po, lag(shape) OVER w AS ps FROM s0 WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
s AS (
  SELECT doc_id, i::BIGINT AS sent, n::BIGINT AS n_words, opening,
    CASE WHEN pl IS NOT NULL THEN len(list_intersect(lemmas, pl))::DOUBLE / greatest(1, least(len(lemmas), len(pl))) END AS overlap,
    opening = po AS same_opening, levenshtein(shape, ps)::DOUBLE / greatest(1, length(shape), length(ps)) AS shape_distance FROM s1)"""

ORACLE_SQL = {
    "cadence_sentences": f"WITH {_SENTENCES} SELECT doc_id, sent, n_words, opening, round(overlap, 6) AS overlap, same_opening, round(CASE WHEN overlap IS NOT NULL THEN shape_distance END, 6) AS shape_distance FROM s",
    "cadence_patterns": f"""WITH {_SENTENCES}, cuts AS (SELECT doc_id, quantile_cont(n_words, 0.25) AS p25, quantile_cont(n_words, 0.75) AS p75 FROM s GROUP BY 1),
f AS (
  SELECT doc_id, sent, 'long' AS kind, n_words > p75 AS f FROM s JOIN cuts USING (doc_id) UNION ALL SELECT doc_id, sent, 'short', n_words < p25 FROM s JOIN cuts USING (doc_id)
  UNION ALL SELECT doc_id, sent, 'disconnected', overlap = 0 FROM s UNION ALL SELECT doc_id, sent, 'opening', same_opening FROM s),
g AS (SELECT doc_id, kind, sent, sent - row_number() OVER (PARTITION BY doc_id, kind ORDER BY sent) AS island FROM f WHERE f)
SELECT doc_id, kind, min(sent)::BIGINT AS first, max(sent)::BIGINT AS last, count(*)::BIGINT AS length FROM g GROUP BY doc_id, kind, island HAVING count(*) >= 3""",
    "question_batches": """WITH q AS (SELECT conv_id, list({'o': turn, 's': length(text) // 3 + 1, 'b': 0, 'n': 0::BIGINT, 'k': 0, 'out': []::INTEGER[]} ORDER BY turn) AS q FROM conversations GROUP BY 1),
r AS (SELECT conv_id, q, list_reduce(q, lambda a, x: CASE WHEN (a.n + x.s > 200 OR a.k >= 4) AND a.k > 0
  THEN {'o': x.o, 's': x.s, 'b': a.b + 1, 'n': x.s, 'k': 1, 'out': list_append(a.out, a.b + 1)}
  ELSE {'o': x.o, 's': x.s, 'b': a.b, 'n': a.n + x.s, 'k': a.k + 1, 'out': list_append(a.out, a.b)} END, {'o': 0::BIGINT, 's': 0::BIGINT, 'b': 0, 'n': 0::BIGINT, 'k': 0, 'out': []::INTEGER[]}) AS r FROM q)
SELECT conv_id, unnest(list_transform(q, lambda x: x.o)) AS turn, unnest(r.out)::BIGINT AS batch FROM r""",
}
