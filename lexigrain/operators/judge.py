"""External judgements: questions packed to budgets, asked through a pluggable answerer, read back as columns.

No service is bundled. An answerer is a function from a list of question
dicts to a list of answers; the stub answers from a hash of the question, so
plans can run and be tested without a network.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "id string, choice string, score double, probabilities map<string,double>"


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3) + 1


def packed(sizes: str, budget: int, most: int) -> str:
    """SQL: the batch number of each element of an array of sizes; a batch ends before it would pass either limit."""
    start = "named_struct('b', 0, 'n', 0L, 'k', 0, 'out', cast(array() as array<int>))"
    full = f"(a.n + x > {budget} OR a.k >= {most}) AND a.k > 0"
    step = f"if({full}, named_struct('b', a.b + 1, 'n', bigint(x), 'k', 1, 'out', concat(a.out, array(a.b + 1))), named_struct('b', a.b, 'n', a.n + x, 'k', a.k + 1, 'out', concat(a.out, array(a.b))))"
    return f"aggregate({sizes}, {start}, (a, x) -> {step}, a -> a.out)"


def batches(questions: DataFrame, group: str, order: str, text: str, budget: int = 24_000, most: int = 300) -> DataFrame:
    """(group, order, batch): questions of one state packed in order."""
    lists = questions.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), token_estimate(F.col(text)).alias("s")))).alias("q"))
    numbered = lists.withColumn("b", F.expr(packed("transform(q, x -> x.s)", budget, most)))
    return numbered.select(group, F.explode(F.arrays_zip("q", "b")).alias("x")).select(group, F.col("x.q.o").alias(order), F.col("x.b").cast("long").alias("batch"))


def stub(questions: list[dict]) -> list[dict]:
    """Deterministic answers: probabilities from the crc32 of question and option."""
    out = []
    for q in questions:
        raw = {c: 1 + zlib.crc32(f"{q['text']}|{c}".encode()) % 97 for c in q["criteria"]}
        total = sum(raw.values())
        p = {c: v / total for c, v in raw.items()}
        out.append({"id": q["id"], "choice": max(p, key=lambda c: (p[c], c)), "score": sum(k * v for k, v in enumerate(p.values())), "probabilities": p})
    return out


class TooLarge(Exception):
    """Raised by an answerer that wants fewer questions at once."""


def ask(questions: DataFrame, answerer: Callable[[list[dict]], list[dict]] = stub, at_once: int = 300) -> DataFrame:
    """ANSWER for each question (id, text, criteria); requests too large are halved."""

    def halves(items: list[dict]) -> list[dict]:
        try:
            return answerer(items)
        except TooLarge:
            if len(items) == 1:
                raise
            mid = len(items) // 2
            return halves(items[:mid]) + halves(items[mid:])

    def run(frames):
        for frame in frames:
            items = [{"id": i, "text": t, "criteria": list(c)} for i, t, c in zip(frame["id"], frame["text"], frame["criteria"], strict=True)]
            answers = [a for k in range(0, len(items), at_once) for a in halves(items[k : k + at_once])]
            yield pd.DataFrame(answers, columns=["id", "choice", "score", "probabilities"])

    return questions.select("id", "text", "criteria").mapInPandas(run, ANSWER)


def expected_level(probabilities: Column) -> Column:
    """Mean level of an answer whose options are named by numbers; null without any."""
    pairs = F.map_entries(probabilities)
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["value"])
    return F.when(total > 0, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["key"].cast("double") * x["value"]) / total)


def confident(choice: Column, probability: Column, otherwise: Column, least: float = 0.8) -> Column:
    """An answer overrides only if it is sure enough."""
    return F.when(probability >= least, choice).otherwise(otherwise)


def canonical(question: dict) -> str:
    return json.dumps(question, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
