"""Information-theoretic sanitisation of personal data, with DataFrame operations only.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers that patterns and checks find. A term (a run of letters) in the text of
an entity, however far away, discloses it as far as seeing the term predicts the
entity: with c(.) counting distinct texts of the whole corpus,

    PMI(e; t) = log2( c(e, t) * N / (c(e) * c(t)) ),   IC(e) = log2( N / c(e) ).

A term whose PMI reaches ``alpha`` times the entity's information content, on
at least ``support`` texts, is a further span in every text that holds the
entity. ``sanitise`` removes it where it gives all of the information (it is in
no text without the entity), and else generalises it to a mark of its shape.
``support`` is a statistical limit: of an entity in one or two texts every other
rare word of them would be a disclosing term, on no evidence at all. The
entities themselves are spans whatever their number.

Offsets are code points, ends exclusive. Matches have no positions in SQL, so
they come from the pieces between matches: a fold adds up the lengths of both,
in stretches of ``STRETCH`` matches that are shifted into place afterwards, so
that a text with very many matches isn't copied for each of them.
All patterns run in linear time on texts without blanks (possessive runs that
start at a run's edge or at the end of the previous match).

Cases: null is an empty text without spans; repeated rows get the same spans
each and count as one text; empty tables give empty results; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.names import spare
from lexigrain.storage import Scratch

#: A removed term (the last) is written like any other term.
KINDS = ("email", "ip", "card", "phone", "term", "term")
STRETCH = 256
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[A-Za-z\x{80}-\x{10FFFF}]{3,}"
#: What must be in a text before its pattern is tried.
SIGNS = {"email": "instr(t, '@') > 0", "ip": "digits", "card": "digits", "phone": "instr(t, '+') > 0"}
DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
LUHN = (
    f"aggregate(transform(split(reverse({DIGITS}), ''), (c, i) -> if(i % 2 = 0, int(c), if(int(c) > 4, 2 * int(c) - 9, 2 * int(c)))), 0, (a, b) -> a + b) % 10 = 0"
)
CHECKS = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 and coalesce(try_cast(p as bigint), 0) <= 255)",
    "card": f"length({DIGITS}) between 14 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 10 and 15",
}
SPAN = "struct<s:int,k:int,e:int>"
#: Shared terms that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _fold(pattern: str, kind: str, check: str, text: str = "t") -> str:
    """SQL: the (s, k, e) of all matches that pass ``check`` (on x.m); ``kind`` may look at x.m too."""
    p = _quoted(pattern)
    none = f"cast(array() as array<{SPAN}>)"
    pieces = f"zip_with(split({text}, {p}), regexp_extract_all({text}, {p}, 0), (g, m) -> named_struct('g', g, 'm', m))"
    span = f"named_struct('s', a.at + length(x.g), 'k', {kind}, 'e', a.at + length(x.g) + length(x.m))"
    step = f"named_struct('at', a.at + length(x.g) + coalesce(length(x.m), 0), 'out', if(x.m is not null and ({check}), concat(a.out, array({span})), a.out))"
    one = f"aggregate(slice(z, i * {STRETCH} + 1, {STRETCH}), named_struct('at', 0, 'out', {none}), (a, x) -> {step})"
    shifted = "transform(c.out, y -> named_struct('s', y.s + b.at, 'k', y.k, 'e', y.e + b.at))"
    # the one-element array names the pieces z, which are found once
    stretches = f"element_at(transform(array({pieces}), z -> transform(sequence(0, (size(z) - 1) div {STRETCH}), i -> {one})), 1)"
    joined = f"aggregate({stretches}, named_struct('at', 0, 'out', cast(array() as array<array<{SPAN}>>)), (b, c) -> named_struct('at', b.at + c.at, 'out', if(size(c.out) > 0, concat(b.out, array({shifted})), b.out)), b -> flatten(b.out))"
    return joined


def with_base(docs: DataFrame) -> DataFrame:
    """Adds ``base``: sorted spans of the four kinds of a text column ``t``."""
    docs = docs.withColumn("digits", F.expr("t rlike '[0-9]'"))
    lists = [f"if({SIGNS[k]}, {_fold(PATTERNS[k], str(i), CHECKS[k])}, cast(array() as array<{SPAN}>))" for i, k in enumerate(KINDS[:4])]
    return docs.withColumn("base", F.expr(f"array_sort(concat({', '.join(lists)}))")).drop("digits")


def disclosing(docs: DataFrame, mentions: DataFrame, scratch: Scratch, alpha: float, support: int) -> DataFrame:
    """(entity, term, share): terms that disclose an entity, and how much of its information they give.

    ``mentions`` has the distinct (text_hash, entity); ``docs`` (t, text_hash)
    is the whole corpus. An entity in fewer than ``support`` texts cannot share
    so many with a term, so only texts of the other entities are read for pairs.
    """
    texts = docs.select("text_hash").distinct().agg(F.count(F.lit(1)).alias("n"))
    entities = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("ce")).filter(F.col("ce") >= support)
    common = scratch.table(mentions.join(entities, "entity"), "common")
    holding = common.select("text_hash").distinct()
    holding = F.broadcast(holding) if holding.count() <= MOST_BROADCAST else holding
    words = F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(t), {_quoted(TERM)}, 0)"))).alias("term")
    held = scratch.table(docs.join(holding, "text_hash").select("text_hash", words).distinct(), "held")
    information = F.log2(F.col("n") / F.col("ce"))
    pmi = lambda ct: F.log2(F.col("both") * F.col("n") / (F.col("ce") * F.expr(ct)))
    # a term is in at least as many texts as hold it and an entity: most common words end here
    beside = held.groupBy("term").agg(F.count(F.lit(1)).alias("least")).filter(F.col("least") >= support)
    together = common.join(held, "text_hash").groupBy("entity", "term", "ce").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= support)
    together = together.join(beside, "term").crossJoin(F.broadcast(texts))  # one row
    together = scratch.table(together.filter((information > 0) & (pmi("least") >= alpha * information)), "together")
    counts = lambda of, terms: of.select("text_hash", words).join(terms, "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("ct"))
    small = lambda terms: F.broadcast(terms) if terms.count() <= MOST_BROADCAST else terms
    # a term is in at least as many texts as in any part of them: a sixteenth bounds away the common words, and all texts are counted for the rest
    part = counts(docs.filter(F.pmod("text_hash", F.lit(16)) == 0), small(together.select("term").distinct())).withColumnRenamed("ct", "part")
    together = scratch.table(together.join(part, "term", "left").filter(pmi("greatest(coalesce(part, 0L), least)") >= alpha * information).drop("part"), "bounded")
    seen = counts(docs, small(together.select("term").distinct()))
    joined = together.join(seen, "term")
    return joined.filter(pmi("ct") >= alpha * information).select("entity", "term", (pmi("ct") / information).alias("share"))


def find(docs: DataFrame, scratch: Scratch, alpha: float = 0.9, support: int = 3) -> DataFrame:
    """doc_id, text_hash, base, spans of every row of ``docs`` (doc_id, text).

    The texts are read three times: for the patterns, for the terms of texts with
    a repeated entity, and for the corpus counts of terms; only texts with
    disclosing terms are read again.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("text_hash", F.xxhash64("t"))
    based = with_base(own)
    entities = (
        f"array_distinct(transform(base, x -> concat(element_at(array({', '.join(repr(k) for k in KINDS)}), x.k + 1), ':', "
        f"if(x.k < 2, lower(substring(t, x.s + 1, x.e - x.s)), regexp_replace(substring(t, x.s + 1, x.e - x.s), '[^0-9]', '')))))"
    )
    found = scratch.table(based.select("doc_id", "text_hash", "base", F.when(F.size("base") > 0, F.expr(entities)).alias("entities")), "base")
    mentions = found.filter("entities is not null").select("text_hash", F.explode("entities").alias("entity")).distinct()
    telling = scratch.table(disclosing(own.select("t", "text_hash"), mentions, scratch, alpha, support), "telling")
    # a term that is removed for one entity of a text is removed for all
    terms = mentions.join(telling, "entity").groupBy("text_hash", "term").agg(F.max(F.col("share") >= 1 - 1e-9).alias("whole"))
    wanted = terms.groupBy("text_hash").agg(F.collect_set("term").alias("telling"), F.collect_set(F.when(F.col("whole"), F.col("term"))).alias("gone"))
    # of equal texts only one is read again and moves
    first = found.filter("entities is not null").groupBy("text_hash").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("doc_id"))
    wanted = scratch.table(wanted.join(first, "text_hash"), "wanted")
    asked = F.broadcast(wanted.select("text_hash").distinct()) if wanted.count() <= MOST_BROADCAST else wanted.select("text_hash").distinct()
    some = own.join(asked, "text_hash", "left_semi").alias("o")
    marks = _fold(TERM, "if(array_contains(gone, lower(x.m)), 5, 4)", "array_contains(telling, lower(x.m))")
    one = some.join(wanted.alias("w"), [F.col("o.text_hash") == F.col("w.text_hash"), F.col("o.doc_id").eqNullSafe(F.col("w.doc_id"))])
    texts = one.select("w.text_hash", "t", "telling", "gone").dropDuplicates(["text_hash"]).select("text_hash", F.expr(marks).alias("marks"))
    more = scratch.table(texts, "marks")
    joined = found.select("doc_id", "text_hash", "base").join(more, "text_hash", "left")
    apart = "filter(coalesce(marks, cast(array() as array<struct<s:int,k:int,e:int>>)), m -> not exists(base, b -> b.s < m.e and m.s < b.e))"
    return joined.select("doc_id", "text_hash", "base", F.expr(f"array_sort(concat(base, {apart}))").alias("spans"))


def as_text(spans: str) -> str:
    names = ", ".join(repr(k) for k in KINDS)
    return f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), string(x.s), string(x.e))), ',')"


def report(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """doc_id, counts of each base kind, the digest of the base spans, and all spans."""
    found = find(docs, scratch, **options)
    counts = [F.expr(f"bigint(size(filter(base, x -> x.k = {i})))").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.expr(f"sha2(cast({as_text('base')} as binary), 256)").alias("base_sha256"), F.expr(as_text("spans")).alias("spans"))


def sanitise(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``docs`` with its spans replaced: base kinds by their name in brackets, generalised terms by [Term] or [term] as they began, removed terms by nothing.

    Overlapping spans give one mark.
    """
    found = find(docs.select("doc_id", "text"), scratch, **options).filter(F.size("spans") > 0).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]).alias("f")
    name = spare(docs.columns, "text_hash")
    own = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit("")))).alias("d")
    joined = own.join(found, [F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), F.col(f"d.{name}") == F.col("f.text_hash")], "left")
    names = ", ".join(repr(f"[{k.upper()}]") for k in KINDS[:4])
    word = "substring(d.text, x.s + 1, 1)"
    mark = f"case when x.k < 4 then element_at(array({names}), x.k + 1) when x.k = 5 then '' when {word} != lower({word}) then '[Term]' else '[term]' end"
    masked = (
        f"aggregate(f.spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> if(x.e <= a.at, a, named_struct('at', x.e, 'out', "
        f"concat(a.out, if(x.s >= a.at, array(substring(d.text, a.at + 1, x.s - a.at), {mark}), array())))), "
        f"a -> concat(array_join(a.out, ''), substring(d.text, a.at + 1)))"
    )
    text = F.when(F.col("f.spans").isNotNull(), F.expr(masked)).otherwise(F.col("d.text")).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])
