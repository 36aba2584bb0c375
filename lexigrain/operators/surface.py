"""Expressions over the raw text alone: fragment lines and plain tokens. No Python, no exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a full line, the words that it has at least, and the tokens of word vectors.
FULL_END = r"[.!?\"'”’)]$"
FULL_WORDS = 8
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"
_BLANKS = r"[\x20\x09-\x0D]"


def fragment_share(text: Column) -> Column:
    """The share of lines with text that have fewer than eight words or do not end as sentences do; 0 for none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n"), lambda x: F.regexp_replace(x, f"^{_BLANKS}+|{_BLANKS}+$", "")), lambda x: x != "")
    short = lambda x: F.size(F.regexp_extract_all(x, F.lit(_BLANKS.replace("[", "[^") + "+"), F.lit(0))) < FULL_WORDS
    fragments = F.filter(lines, lambda x: short(x) | ~F.regexp_like(x, F.lit(FULL_END)))
    return F.size(fragments) / F.greatest(F.size(lines), F.lit(1))


def vector_tokens(text: Column) -> Column:
    """The tokens that word vectors are looked up by: lower case, apostrophes straight; null has none."""
    straight = F.translate(F.lower(F.coalesce(text, F.lit(""))), "’‘", "''")
    return F.regexp_extract_all(straight, F.lit(TOKEN), F.lit(0))
