"""Quality classifier: random-indexing vectors pooled per document, then a two-layer network.

Each of ``UNITS`` classes of byte trigrams (by a hash; a blank stands for a
word's edge) has a sparse ternary index vector. A word's index vector is the sum
of its trigrams', divided by the root of their number, so that words alike in spelling are
alike, also unseen ones. Its word vector adds half of its context: the index
vectors of the words within ``REACH`` places, summed over the labelled sample in
one of ``ROWS`` rows that a hash gives the word, at unit length (nothing for words
that the sample has not). A document is the mean of its words' vectors with its
length, the mean's norm and the share of words that repeat the word before them.
A network with one hidden layer scores that, and a temperature fitted on a part
it wasn't trained on calibrates the score.

Fitting uses at most ``sample`` labelled documents (documented bound; the ones
with the lowest hash of doc_id, one row of each); scoring covers every document.

Cases: null is an empty text and gets the score of a document without words;
without labels every score is 0.5, with labels of one kind only the smoothed
share; a null quality is no label; of several labels of one doc_id the largest
counts, of several texts the first in order; repeated rows are scored each; a
text of any length is pooled whole; other columns never are inputs; the columns
added are ``score`` and ``predicted``, with underscores in front where the input
has such names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain.llm import blocks as B
from lexigrain.llm.names import spare
from lexigrain.storage import Scratch

UNITS, ROWS, DIM, HIDDEN = 4096, 1 << 13, 64, 32
REACH, EXTRA = 2, 3
#: Rows of vectors that are looked up at once, and documents in a block, whose units are a dense matrix.
STRETCH, DOCS = 1 << 16, 256


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, 8 entries of 64 set, the same on every machine."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((UNITS, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, 8, replace=False)] = rng.choice([-1.0, 1.0], 8)
    return out / np.sqrt(8, dtype=np.float32)


def _sums(values, groups: np.ndarray, n: int, step: int) -> np.ndarray:
    """Sums of rows values(lo, hi) by their (rising) group, a stretch of rows at a time."""
    out = np.zeros((n, DIM), np.float32)
    for lo in range(0, len(groups), step):
        part = groups[lo : lo + step]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out[part[cut]] += np.add.reduceat(values(lo, lo + len(part)), cut, axis=0)
    return out


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash and document of each word of a block; of each byte of a word its unit, its word and what it weighs."""
    start, end, first = B.words(data, offsets)
    size = end - start
    word = np.repeat(np.arange(len(start)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + start[word]
    padded = np.full(len(data) + 2, 32, np.uint32)
    padded[1:-1] = data
    before, after = padded[at], padded[at + 2]
    before[at == start[word]] = 32
    after[at + 1 == end[word]] = 32
    gram = (before << np.uint32(16)) | (padded[at + 1] << np.uint32(8)) | after
    unit = ((gram * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    # the sum of so many random unit vectors is about this long
    weight = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
    return B.Ranges(data).hash(start, end), np.repeat(np.arange(len(offsets) - 1), np.diff(first)), unit, word, weight


def rows_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (ROWS - 1).bit_length())).astype(np.int64)


def contexts(data: np.ndarray, offsets: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words near it."""
    hashes, doc, unit, word, weight = word_units(data, offsets)
    if not len(doc):
        return
    vectors = _sums(lambda lo, hi: index[unit[lo:hi]] * weight[lo:hi, None].astype(np.float32), word, len(doc), STRETCH)
    near = np.zeros((len(doc), DIM), np.float32)
    for k in range(1, min(REACH, len(doc) - 1) + 1):
        same = (doc[k:] == doc[:-k])[:, None]
        near[k:] += vectors[:-k] * same
        near[:-k] += vectors[k:] * same
    rows = rows_of(hashes)
    order = np.argsort(rows, kind="stable")
    into += _sums(lambda lo, hi: near[order[lo:hi]], rows[order], ROWS, STRETCH)


def features(data: np.ndarray, offsets: np.ndarray, index: np.ndarray, around: np.ndarray) -> np.ndarray:
    """DIM + EXTRA numbers for each document of a block."""
    hashes, doc, unit, word, weight = word_units(data, offsets)
    n = len(offsets) - 1
    n_words = np.bincount(doc, minlength=n)
    # index vectors are added for each document's units, contexts for its words
    units = np.bincount(doc[word] * UNITS + unit, weight, n * UNITS).reshape(n, UNITS).astype(np.float32)
    rows = rows_of(hashes)
    total = units @ index + np.float32(0.5) * _sums(lambda lo, hi: around[rows[lo:hi]], doc, n, STRETCH)
    pooled = total / np.maximum(n_words, 1)[:, None]
    again = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    extra = np.stack([np.log1p(n_words), np.linalg.norm(pooled, axis=1), again / np.maximum(n_words, 1)], axis=1)
    return np.concatenate([pooled, extra], axis=1).astype(np.float32)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Inputs in standard deviations, four at most, so that no odd text outweighs all else."""
    return np.clip((x - mean) / scale, -4, 4)


@dataclass
class Network:
    """Standardised input, one tanh layer, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(standard(x, self.mean, self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, steps: int = 600, rate: float = 0.02, decay: float = 1e-3) -> Network:
    """Adam on all rows outside of ``calibrate``; the temperature on those inside."""
    x = x.astype(np.float64)
    if len(set(y.tolist())) < 2:
        prior = (y.sum() + 1.0) / (len(y) + 2.0)
        width = DIM + EXTRA
        return Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))))
    train = ~calibrate if len(set(y[~calibrate].tolist())) == 2 else np.ones(len(y), bool)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, t = standard(x[train], mean, scale), y[train].astype(float)
    rng = np.random.Generator(np.random.PCG64(11))
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for k in range(1, steps + 1):
        h = np.tanh(z @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t) / len(t)
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [z.T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()])]
        for a, d, mm, vv in zip(p, grads, m, v, strict=True):
            mm += 0.1 * (d - mm)
            vv += 0.001 * (d * d - vv)
            a -= rate * (mm / (1 - 0.9**k)) / (np.sqrt(vv / (1 - 0.999**k)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if calibrate.any():
        raw, t = net.logits(x[calibrate]), y[calibrate].astype(float)
        loss = lambda c: float(np.mean(np.logaddexp(0, raw / c) - t * raw / c))
        net.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return net


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = 6000) -> tuple[np.ndarray, Network]:
    """Contexts of words and network from labelled documents outside of the held-out fold."""
    usable = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one row a doc_id, so `sample` rows at most
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text")))["text"].alias("text"), F.first("quality").alias("quality"))
    texts = texts.select(F.col("quality").cast("int"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("calibrate"), "text")
    texts = scratch.table(texts, "sample")
    index = index_vectors()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, DIM), np.float32)
        for batch in batches:
            data, offsets = B.utf8(batch.column(0))
            for lo, hi in B.blocks(offsets, 1 << 18):
                contexts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], index, total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    around = np.zeros((ROWS, DIM), np.float32)
    for row in texts.select("text").coalesce(8).mapInArrow(gather, "total binary").collect():  # 8 times 2 MB
        around += np.frombuffer(row.total, np.float32).reshape(ROWS, DIM)
    around /= np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-6)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.utf8(batch.column(2))
            for lo, hi in B.blocks(offsets, 1 << 18, DOCS):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], index, around)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "calibrate", "x"])

    rows = texts.mapInArrow(pool, "quality int, calibrate boolean, x binary").collect()
    rows.sort(key=lambda r: (bytes(r.x), r.quality))  # the order in which tasks end must not matter
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), DIM + EXTRA)
    net = fit(x, np.array([r.quality for r in rows], int), np.array([r.calibrate for r in rows], bool))
    scratch.drop("sample")
    return around, net


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = 6000) -> DataFrame:
    """Every row of ``docs`` with its score and whether it reaches one half, the last two columns; one pass over the texts after fitting."""
    around, net = train(docs.select("doc_id", "text"), labels, scratch, sample)
    model = docs.sparkSession.sparkContext.broadcast((index_vectors(), around, net))  # 3 MB, whatever the input
    place = docs.columns.index("text")
    added = [spare(docs.columns, name) for name in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, near, network = model.value
        for batch in batches:
            data, offsets = B.utf8(batch.column(place))
            for lo, hi in B.blocks(offsets, 1 << 18, DOCS):
                s = network.score(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], index, near))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], [*part.schema.names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.IntegerType())])
    return docs.mapInArrow(run, schema)


def good(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = 6000) -> DataFrame:
    """The rows of ``docs`` that score one half or more."""
    scored = score(docs, labels, scratch, sample)
    return scored.filter(F.col(scored.columns[-1]) == 1).drop(*scored.columns[-2:])
