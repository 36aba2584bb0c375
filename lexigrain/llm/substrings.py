"""Exact substring dedup: bytes covered by a string of ``width`` bytes that starts twice or more.

Sharding. Each window of ``width`` bytes has anchors: the ``ANCHOR``-byte
strings in it whose hash is the window's smallest. Equal windows have equal
anchors at equal places, so what an occurrence of an anchor can share with
another lies in its neighbourhood, ``width`` - ANCHOR bytes to either side, and
all of that meets under the anchor's hash. Anchors that occur once go no
further. Equal neighbourhoods (128-bit hash and place of the anchor) are one
text with a count: all their windows are repeats. Only anchors with different
neighbourhoods are left to compare, one copy of each.

Each shard sorts the suffixes of its texts by external induced sorting
(``induced``); neighbours in suffix order with a common prefix of ``width``
bytes are repeats. A shard holds as many anchors as make up ``shard_bytes`` on
average; one that holds more (an anchor with very many different
neighbourhoods) sorts on disk.

Cases: null is an empty text; texts shorter than ``width`` have no repeats;
rows with the same doc_id are told apart by a hash of the text; rows equal in
both are repeats of each other and get the same result; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm import blocks as B
from lexigrain.llm import induced
from lexigrain.storage import Scratch

ANCHOR = 100
ANCHORS = "anchor long, n1 long, n2 long, doc_id long, text_hash long, at long, size int, end long, n long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64) for b in (base, pow(base, -1, 2**64)))
    return up, down


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of each ``ANCHOR``-byte string, modulo 2**64: it picks and groups places, and never decides that texts are equal."""
    powers, inverse = _powers(max(len(data), 1 << 18))
    powers = powers[: len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(B.BYTE_KEYS[data] * powers, out=sums[1:])
    n = len(data) - ANCHOR + 1
    return B.mix((sums[ANCHOR:] - sums[:n]) * inverse[:n])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, at, hash, n1, n2, start, end): anchors of a block with their neighbourhoods' hashes and bounds."""
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    if len(data) < width:
        return none
    h = _grams(data)
    key = (h >> np.uint64(32)).astype(np.uint32)
    reach = width - ANCHOR + 1
    least = _sliding(key, reach, np.minimum)  # for the window that starts at each byte
    whole = np.zeros(len(least), bool)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        whole[lo : max(lo, hi - width + 1)] = True
    padded = np.zeros(len(key) + reach - 1, np.uint32)
    padded[reach - 1 : reach - 1 + len(least)] = np.where(whole, least, 0)
    chosen = (_sliding(padded, reach, np.maximum) == key) & (key > 0)
    # a smallest hash of 0 can't be told from no window: take all of those, which only adds anchors
    chosen |= key == 0
    at = np.flatnonzero(chosen)
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + ANCHOR <= offsets[row + 1]
    at, row = at[inside], row[inside]
    if not len(at):
        return none
    start = np.maximum(at - (width - ANCHOR), offsets[row])
    end = np.minimum(at + width, offsets[row + 1])
    raw = data.tobytes()
    digests = [hashlib.blake2b(raw[a:b], digest_size=16, salt=(c - a).to_bytes(8, "little")).digest() for a, b, c in zip(start.tolist(), end.tolist(), at.tolist(), strict=True)]
    pairs = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return row, at, h[at], np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), start, end


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """ANCHORS: the anchors of every text; neighbours with equal neighbourhoods (periodic text) are one row.

    ``at``, ``size``: the first neighbourhood; ``end``: of the last; ``n``: how many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.utf8(batch.column(2))
            for lo, hi in B.blocks(offsets, 1 << 18):
                base = offsets[lo : hi + 1] - offsets[lo]
                row, _, h, n1, n2, start, end = anchors(data[offsets[lo] : offsets[hi]], base, width)
                if not len(row):
                    continue
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(row)] - 1
                pick = pa.array(row[first] + lo)
                zero = base[row[first]]
                signed = lambda x: pa.array(x[first].view(np.int64))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [signed(h), signed(n1), signed(n2), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(start[first] - zero), pa.array((end[first] - start[first]).astype(np.int32)), pa.array(end[last] - zero), pa.array(last - first + 1)],
                    ["anchor", "n1", "n2", "doc_id", "text_hash", "at", "size", "end", "n"],
                )

    return docs.mapInArrow(run, ANCHORS)


def _cut(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """anchor, doc_id, text_hash, at, bytes of each piece (anchor, doc_id, text_hash, at, size)."""
    lists = pieces.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "at", "size")).alias("p")).alias("p")
    d = docs.alias("d")
    joined = d.join(lists, [F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("d.text_hash") == F.col("p.text_hash")])
    rows = joined.select("d.doc_id", "d.text_hash", F.encode("d.text", "UTF-8").alias("raw"), F.col("p.p").alias("p")).dropDuplicates(["doc_id", "text_hash"])
    rows = rows.select("doc_id", "text_hash", "raw", F.explode("p").alias("x"))
    return rows.select("x.anchor", "doc_id", "text_hash", "x.at", F.expr("substring(raw, int(x.at) + 1, x.size)").alias("bytes"))


def sort_shards(pieces: DataFrame, width: int, budget: int) -> DataFrame:
    """(doc_id, text_hash, at, end): repeats within each partition of ``pieces``, which come sorted by text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = induced.spill_folder()
        try:
            # overlapping pieces of a text become one segment, so that each byte stands in the shard's text once
            doc, nothing, hashed, first, place = (array("q") for _ in range(5))  # of each segment: its text, its start there and in the shard's text
            path, size, key, upto = f"{folder}/text", 0, None, 0
            with open(path, "wb") as out:
                for batch in batches:
                    for doc_id, text_hash, at, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                        if (doc_id, text_hash) != key or at > upto:
                            out.write(b"\x01\x00")
                            size += 1
                            for column, value in zip((doc, nothing, hashed, first, place), (doc_id or 0, doc_id is None, text_hash, at, size), strict=True):
                                column.append(value)
                            key, upto = (doc_id, text_hash), at
                        fresh = raw[upto - at :]
                        out.write((np.frombuffer(fresh, np.uint8).astype("<u2") + 2).tobytes())
                        size, upto = size + len(fresh), max(upto, at + len(raw))
                out.write(b"\x00\x00")
            if not place:
                return
            text = np.fromfile(path, "<u2") if size * 4 <= budget else np.memmap(path, "<u2", "r")
            flags = induced.repeated(text, 258, width, budget, folder)
            doc, nothing, hashed, first, place = (np.frombuffer(x, np.int64) for x in (doc, nothing, hashed, first, place))
            limits = np.append(place[1:] - 1, size + 1)
            for lo, hi in induced.blocks(len(flags)):  # a run that goes on in the next block becomes two spans that overlap
                hits = np.flatnonzero(flags[lo:hi]) + lo
                own = np.searchsorted(place, hits, "right") - 1
                inside = (own >= 0) & (hits + width <= limits[own])
                own, hits = own[inside], hits[inside]
                if not len(hits):
                    continue
                new = np.flatnonzero(np.r_[True, (hits[1:] != hits[:-1] + 1) | (own[1:] != own[:-1])])
                last = np.r_[new[1:], len(hits)] - 1
                pick = own[new]
                zero = first[pick] - place[pick]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[pick], mask=nothing[pick] == 1), pa.array(hashed[pick]), pa.array(hits[new] + zero), pa.array(hits[last] + zero + width)],
                    ["doc_id", "text_hash", "at", "end"],
                )
        finally:
            induced.remove(folder)

    return pieces.select("doc_id", "text_hash", "at", "bytes").mapInArrow(run, "doc_id long, text_hash long, at long, end long")


def repeats(docs: DataFrame, scratch: Scratch, width: int = 400, shard_bytes: int = 8 << 20, budget: int = 1 << 22) -> DataFrame:
    """(doc_id, text_hash, spans): [at, end) in bytes, sorted, possibly overlapping."""
    rows = scratch.table(anchor_rows(docs, width), "anchors")
    often = rows.groupBy("anchor").agg(F.sum("n").alias("times")).filter("times > 1").select("anchor")
    rows = scratch.table(rows.join(often, "anchor", "left_semi"), "often")
    scratch.drop("anchors")
    near = ["anchor", "n1", "n2"]
    texts = rows.groupBy(*near).agg(F.sum("n").alias("times"), F.min(F.struct("doc_id", "text_hash", "at", "size")).alias("one"))
    texts = scratch.table(texts, "texts")
    copied = rows.join(texts.filter("times > 1").select(*near), near, "left_semi").filter(F.col("size") >= width).select("doc_id", "text_hash", "at", "end")
    mixed = texts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("anchor")
    pieces = scratch.table(texts.join(mixed, "anchor", "left_semi").select("anchor", "one.*").filter(F.col("size") >= width), "pieces")
    total = pieces.agg(F.sum("size")).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // shard_bytes + 1)
    dealt = _cut(docs, pieces).repartition(shards, "anchor").sortWithinPartitions("doc_id", "text_hash", "at", F.desc(F.length("bytes")))
    sorted_ = sort_shards(dealt, width, budget)
    spans = scratch.table(copied.unionByName(sorted_).distinct(), "spans")
    return spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("spans"))


def dedup(docs: DataFrame, scratch: Scratch, width: int = 400, text: bool = False, **options) -> DataFrame:
    """RESULT for every document; with ``text`` also the bytes kept, as text."""
    from lexigrain.llm.chunks import without

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    found = repeats(own, scratch, width, **options).alias("f")
    d = own.alias("d")
    joined = d.join(found, [F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("d.text_hash") == F.col("f.text_hash")], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.utf8(batch.column(1))
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
            lists = batch.column(2)
            empty = lists.is_null().to_pylist()
            for i in range(len(batch)):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                gone: list[tuple[int, int]] = []
                for s in [] if empty[i] else lists[i].as_py():
                    if gone and s["at"] <= gone[-1][1]:
                        gone[-1] = (gone[-1][0], max(gone[-1][1], s["end"]))
                    else:
                        gone.append((s["at"], s["end"]))
                kept = without(raw, gone)
                for k, v in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(gone)), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept_text", kept.decode("utf-8", "replace") if text else None)):
                    out[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["doc_id", *out])

    result = joined.select("d.doc_id", "d.text", "f.spans").mapInArrow(run, RESULT)
    return result if text else result.drop("kept_text")
