"""DuckDB building blocks: the same tokens as ``operators.annotate``, in relational form."""

from __future__ import annotations

from lexigrain.functions import lexicon as X
from lexigrain.operators.annotate import BREAK, PROTECT

#: paras(doc_id, para, t), sent(doc_id, para, sent, t), tok(doc_id, para, sent, pos, w, c, l); sent and pos count through the document
TOKENS = rf"""
paras AS (
  SELECT doc_id, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS para FROM (
    SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x != '') AS p FROM documents)),
sent0 AS (
  SELECT doc_id, para, unnest(s) AS t, unnest(range(1, len(s) + 1)) AS k FROM (
    SELECT doc_id, para, string_split(regexp_replace(regexp_replace(t, '{PROTECT}', '\1\2' || chr(2), 'g'), '{BREAK}', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM paras)),
sent AS (SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY para, k) AS sent, t FROM sent0),
words AS (
  SELECT doc_id, para, sent, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS k FROM (
    SELECT doc_id, para, sent, regexp_extract_all(lower(t), '\p{{L}}+') AS w FROM sent)),
tok AS (
  SELECT doc_id, para, sent, k, row_number() OVER (PARTITION BY doc_id ORDER BY sent, k) AS pos, w, {X.word_class("w")} AS c, {X.lemma("w")} AS l FROM words)"""


def stop_sql(stop: list[str]) -> str:
    return X.quoted(stop)


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END"
