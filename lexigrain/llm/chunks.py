"""Substring dedup by content-defined chunks.

A gear rolling hash cuts each text where the hash of the last 32 bytes has its
top bits zero, so that cuts follow content and an insertion only moves the cuts
around it. Chunks are identified by a 128-bit digest. The first chunk of each
digest, by (doc_id, place), is the original; every later one is a repeat and is
removed, however short its run of neighbouring repeats. A run then grows bytewise
on both sides as far as its text agrees with the text around the originals of its
outer chunks (by whole characters, and by at most ``most`` bytes, the size of the
longest chunk), so that it reaches the edges of a shared passage, which lie inside
chunks. Each removed byte equals one at an earlier place, so one copy stays.

Digests are counted before anything else moves; chunks that occur once go no
further. A digest that a third of all documents share is one row in the count
and a skewed key in one equi-join, which adaptive execution splits. Only texts
that hold an original at the edge of a run are read for its surroundings.

Cases: null is an empty text, without chunks; rows with the same doc_id are
told apart by a hash of the text, and rows equal in both are one document, with
one result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm import blocks as B
from lexigrain.storage import Scratch

GEAR = (B.BYTE_KEYS >> np.uint64(20)).astype(np.uint32)
#: Texts with originals whose wanted places are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000
CHUNK_SCHEMA = "doc_id long, text_hash long, at long, size int, d1 long, d2 long"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, n_repeat_chunks long, first_docs array<long>"


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 32 bytes that end there (fewer at the start)."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)  # the right side is computed before it is added
    return h


def cut(data: np.ndarray, bits: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one text: at a gear cut, at least ``least`` and at most ``most`` bytes long."""
    n = len(data)
    if not n:
        return []
    ends, last = [], 0
    for c in (np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1).tolist():
        while c - last > most:
            last += most
            ends.append(last)
        if c - last >= least:
            last = c
            ends.append(c)
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunk(docs: DataFrame, bits: int, least: int, most: int) -> DataFrame:
    """CHUNK_SCHEMA: a row for each chunk of each text (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.utf8(batch.column(2))
            for lo, hi in B.blocks(offsets, 1 << 22):
                rows, at, size, digests = [], [], [], []
                for d in range(lo, hi):
                    text = data[offsets[d] : offsets[d + 1]]
                    raw, start = text.tobytes(), 0
                    ends = cut(text, bits, least, most)
                    rows += [d] * len(ends)
                    at += [0, *ends[:-1]] if ends else []
                    for end in ends:
                        digests.append(hashlib.blake2b(raw[start:end], digest_size=16).digest())
                        size.append(end - start)
                        start = end
                pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(at, pa.int64()), pa.array(size, pa.int32()), pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))],
                    ["doc_id", "text_hash", "at", "size", "d1", "d2"],
                )

    return docs.mapInArrow(run, CHUNK_SCHEMA)


def around(docs: DataFrame, runs: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(first, before, after): up to ``most`` bytes on the outer side of the originals at the edges of runs."""
    edges = runs.filter("at > 0").select("left.*", F.lit(True).alias("before")).unionByName(runs.select("right.*", F.lit(False).alias("before")))
    places = scratch.table(edges.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("place", "before")).alias("places")), "edges")
    places = F.broadcast(places) if places.count() <= MOST_BROADCAST else places
    d, p = docs.alias("d"), places.alias("p")
    on = [F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("d.text_hash") == F.col("p.text_hash")]
    texts = d.join(p, on).select("d.doc_id", "d.text_hash", "text", "places").dropDuplicates(["doc_id", "text_hash"])
    asked = texts.select("doc_id", "text_hash", F.encode("text", "UTF-8").alias("raw"), F.explode("places").alias("x"))
    start = F.when(F.col("x.before"), F.greatest(F.col("x.place") - most, F.lit(0))).otherwise(F.col("x.place"))
    length = F.when(F.col("x.before"), F.col("x.place") - start).otherwise(F.lit(most))
    return scratch.table(asked.select("doc_id", "text_hash", "x.place", "x.before", F.substring("raw", (start + 1).cast("int"), length.cast("int")).alias("bytes")), "around")


def repeats(docs: DataFrame, scratch: Scratch, bits: int = 5, least: int = 32, most: int = 1024) -> DataFrame:
    """(doc_id, text_hash, spans, first_docs): [at, end) of runs of removed chunks with the bytes around their originals, and whose copies stay."""
    chunks = scratch.table(chunk(docs, bits, least, most), "chunks")
    place = F.struct("doc_id", "text_hash", "at")
    shared = chunks.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    met = chunks.join(shared, ["d1", "d2"])
    # equal rows (doc_id and text) are one document here; the first keeps its chunks
    later = met.filter(~F.col("first").eqNullSafe(place)).select("doc_id", "text_hash", "at", (F.col("at") + F.col("size")).alias("end"), "first").distinct()
    key = ["doc_id", "text_hash"]
    order = Window.partitionBy(*key).orderBy("at")
    runs = later.withColumn("new", (F.coalesce(F.lag("end").over(order), F.lit(-1)) != F.col("at")).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    original = lambda at: F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), at.alias("place"))
    left, right = original(F.col("first.at")), original(F.col("first.at") + F.col("end") - F.col("at"))
    runs = runs.groupBy(*key, "run").agg(
        F.min("at").alias("at"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.collect_set("first.doc_id").alias("firsts"), F.min_by(left, "at").alias("left"), F.max_by(right, "at").alias("right")
    )
    runs = scratch.table(runs.drop("run"), "runs")
    scratch.drop("chunks")
    near = around(docs, runs, scratch, most)
    spans = runs
    for side, name in (("left", "before"), ("right", "after")):
        n = near.filter(F.col("before") == F.lit(side == "left")).alias("n")
        r = spans.alias("r")
        on = [F.col(f"r.{side}.doc_id").eqNullSafe(F.col("n.doc_id")), F.col(f"r.{side}.text_hash") == F.col("n.text_hash"), F.col(f"r.{side}.place") == F.col("n.place")]
        spans = r.join(n, on, "left").select("r.*", F.col("n.bytes").alias(f"{name}_bytes"))
    span = F.struct("at", "end", F.col("before_bytes").alias("before"), F.col("after_bytes").alias("after"))
    return spans.groupBy(*key).agg(F.sort_array(F.collect_list(span)).alias("spans"), F.sum("n").alias("n_repeat_chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("first_docs"))


def with_text(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents beside what was found about them (null where nothing was)."""
    d, f = docs.alias("d"), found.alias("f")
    on = [F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("d.text_hash") == F.col("f.text_hash")]
    return d.join(f, on, "left").select("d.*", *[F.col(f"f.`{c}`") for c in found.columns if c not in ("doc_id", "text_hash")])


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of sorted, disjoint spans."""
    parts, last = [], 0
    for start, end in spans:
        parts.append(raw[last:start])
        last = end
    return b"".join([*parts, raw[last:]])


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes two texts start with in common."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    return int(unlike[0]) if len(unlike) else n


def grown(raw: np.ndarray, spans: list[dict]) -> list[tuple[int, int]]:
    """Spans (at, end, and bytes before and after their originals) extended as far as the text agrees; sorted, disjoint."""
    out: list[tuple[int, int]] = []
    for s in spans:
        start, end = s["at"], s["end"]
        if s["before"]:
            start -= _agreeing(raw[:start][::-1], np.frombuffer(s["before"], np.uint8)[::-1])
            while start < s["at"] and raw[start] & 0xC0 == 0x80:  # inside a character
                start += 1
        if s["after"]:
            end += _agreeing(raw[end:], np.frombuffer(s["after"], np.uint8))
            while s["end"] < end < len(raw) and raw[end] & 0xC0 == 0x80:
                end -= 1
        out.append((start, end))
    merged: list[tuple[int, int]] = []
    for start, end in sorted(out):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


def dedup(docs: DataFrame, scratch: Scratch, bits: int = 5, least: int = 32, most: int = 1024, text: bool = False) -> DataFrame:
    """RESULT_SCHEMA for every document; with ``text``, also the kept bytes as text."""
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    found = repeats(own, scratch, bits, least, most)
    joined = with_text(own, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.utf8(batch.column(2))
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            spans, none = batch.column(3), batch.column(3).is_null().to_pylist()
            for i in range(len(batch)):
                raw = data[offsets[i] : offsets[i + 1]]
                gone = [] if none[i] else grown(raw, spans[i].as_py())
                kept = without(raw.tobytes(), gone)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept.decode("utf-8", "replace") if text else None)
            columns = [batch.column(0), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.string()), batch.column(4), batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "n_repeat_chunks", "first_docs"])

    out = joined.select("doc_id", "text_hash", "text", "spans", "n_repeat_chunks", "first_docs").mapInArrow(run, RESULT_SCHEMA)
    return out if text else out.drop("kept_text")
