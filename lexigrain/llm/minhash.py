"""Near duplicates by MinHash, banding, verification and connected components.

A document's set holds the hashes of its distinct word shingles. Documents with
equal sets become one node. Each node's signature has ``HASHES`` minima of
universal hash functions, cut into bands that deal nodes to buckets: 30 bands
of 6 minima from similarity 0.85 on, 36 of 5 below, so that a pair at the
threshold meets in no band with probability under 1e-6.

No bucket emits all its pairs. Its pivot is the node that most others meet in
all buckets; every other node meets the pivot only, on full sets, and
components are formed. What is left are pairs of a node x that is not linked
with its pivot p and any y of the bucket from another component. Let D be what
p has and a node lacks, A what the node has and p lacks, S = D + A. Then, for a
threshold of num / den, x and y are linked exactly if
    2 (num + den) |Sx & Sy| >= far(x) + far(y),
    far(x) = 2 num |x| + 2 (num + den) |Dx| - (num + den) |p|,
and as x is not linked with p, the right side is positive: x and y must share a
token of S. Both sides are known, so each pair has its own prefix: with tokens
ordered from rare to common in the star, the first shared one lies among the
first |S| - need + 1 of both. Thousands of copies of one text, each changed in
its own way, have their own changes in that prefix and meet nowhere.
Of the pairs that pass, first one for each node and component is verified (by
signature at a margin of six standard errors, then on full sets), components are
merged, and only pairs that are still apart follow. No link between different
components is lost. How many pairs pass depends on the texts: nodes that share
rare changes and yet are not alike are compared one by one.

Cases: null, empty and wordless texts have an empty set and are linked with
nothing; fewer words than a shingle make one shingle; repeated rows are copies;
a null doc_id is larger than others; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm import blocks as B
from lexigrain.llm.components import connected
from lexigrain.llm.names import spare
from lexigrain.storage import Scratch

HASHES = 180
_RNG = np.random.Generator(np.random.PCG64(42))
#: h(x) = a * x + b modulo 2**32 with odd a, compared by the high bits first.
A = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
C = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
STAR = "node binary, pivot binary, linked boolean, n long, far long, least long, tokens array<long>"
#: Nodes of a pivot that one copy of its text serves.
MOST_SERVED = 128
#: Pivots (16 bytes each) that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 200_000
SIGNED = "doc_id long, text_hash long, n_shingles long, node binary, signature binary, bands array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, sorted, and where each document's begin."""
    n = len(offsets) - 1
    raw = B.LOWER[data] if lower else data
    start, end, first = B.words(raw, offsets)
    words = B.Ranges(raw).hash(start, end)
    n_words = np.diff(first)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), counts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    a = first[doc] + k
    h = B.runs(words, a, np.minimum(a + width, first[doc + 1]) - a)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def signature(h: np.ndarray) -> np.ndarray:
    """HASHES minima over a set of 64-bit hashes."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(least, (x[k : k + 2048, None] * A + C).min(axis=0), out=least)
    return least


def rows_of_band(num: int, den: int) -> int:
    """Minima in a band for a similarity threshold of num / den."""
    return next(r for r in (6, 5, 4, 3, 2, 1) if (1 - (num / den) ** r) ** (HASHES // r) < 1e-6 or r == 1)


def sign(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """SIGNED for each row of (doc_id, text_hash, text)."""
    n_bands = HASHES // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.utf8(batch.column(2))
            for lo, hi in B.blocks(offsets):
                h, at = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                nodes, signed, bands = [], [], []
                for i in range(hi - lo):
                    own = h[at[i] : at[i + 1]]
                    if not len(own):
                        nodes.append(None)
                        signed.append(None)
                        bands.append([])
                        continue
                    nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    s = signature(own)
                    signed.append(s.tobytes())
                    keys = np.arange(n_bands, dtype=np.uint64)
                    for part in s.reshape(n_bands, rows).T:
                        keys = B.mix(keys * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
                    bands.append(keys.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(nodes, pa.binary()), pa.array(signed, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_shingles", "node", "signature", "bands"],
                )

    return docs.mapInArrow(run, SIGNED)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets have den * intersection >= num * union.

    ``nodes`` has the signatures, ``texts`` one text a node. Signatures take out
    pairs far below the threshold before any text moves.
    """
    least = num / den
    floor = int(HASHES * (least - 6 * (least * (1 - least) / HASHES) ** 0.5))
    sides = [nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("signature").alias(f"s{k}")) for k in "uv"]
    near = pairs.join(sides[0], "u").join(sides[1], "v").filter(F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
            ok = pa.array((u == v).sum(axis=1) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    likely = near.select("u", "v", "su", "sv").mapInArrow(agree, "u binary, v binary")
    both = likely.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [den * common >= num * (len(x) + len(y) - common) for x, y, common in _compared(batch, width)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return both.select("u", "v", "tu", "tv").mapInArrow(exact, "u binary, v binary")


def _compared(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For rows (u, v, text of u, text of v): both sets and how many they share."""
    sets: dict[bytes, np.ndarray] = {}
    for i in range(len(batch)):
        pair = []
        for k in (0, 1):
            node = batch.column(k)[i].as_py()
            if node not in sets:
                if len(sets) > 64:
                    sets.clear()
                data, offsets = B.utf8(batch.column(2 + k).slice(i, 1))
                sets[node] = shingles(data, offsets, width)[0]
            pair.append(sets[node])
        yield *pair, len(np.intersect1d(*pair, assume_unique=True))


def stars(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """STAR for nodes and pivots (node, pivot): is it a link; the size of S; far; what S must share with any partner; S itself.

    A pivot's text is copied once for each MOST_SERVED of its nodes, so that no task has to take them all.
    """
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / MOST_SERVED).cast("int").alias("copies"))
    dealt = pairs.join(sizes, "pivot").withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int")).drop("copies")
    pivots = texts.select(F.col("node").alias("pivot"), F.col("text").alias("tv")).join(sizes, "pivot").select("pivot", "tv", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    both = dealt.join(texts.select("node", F.col("text").alias("tu")), "node").join(pivots, ["pivot", "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = num + den
        for batch in batches:
            linked, n, far, least, tokens = [], [], [], [], []
            for x, p, common in _compared(batch, width):
                own = np.setxor1d(x, p, assume_unique=True)
                gap = (den - num) * len(p)
                f = 2 * num * len(x) + 2 * k * (len(p) - common) - k * len(p)
                linked.append(f <= gap)
                n.append(len(own))
                far.append(f)
                # no partner of an unlinked node is nearer than the pivot; each partner of a linked one is farther than the links go
                least.append(-((gap - f) // (2 * k)) if f > gap else -(-(f + gap + 1) // (2 * k)))
                tokens.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(n, pa.int64()), pa.array(far, pa.int64()), pa.array(least, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["node", "pivot", "linked", "n", "far", "least", "tokens"])

    return both.select("node", "pivot", "tu", "tv").mapInArrow(run, STAR)


def prefixes(star: DataFrame) -> DataFrame:
    """pivot, token, node, linked, n, far, at: the tokens in which a node can meet an unlinked one; at counts from 1, rare to common."""
    # a star without unlinked nodes has one component: nothing to compare
    open_ = star.filter("not linked").select("pivot").distinct()
    open_ = F.broadcast(open_) if open_.count() <= MOST_BROADCAST else open_
    own = star.join(open_, "pivot", "left_semi").select("pivot", "node", "linked", "n", "far", "least", F.explode("tokens").alias("token"))
    # tokens of one node alone come first and meet nobody: they only count
    counts = own.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("times"), F.min("linked").alias("all_linked")).filter("times > 1")
    each = Window.partitionBy("pivot", "node")
    met = own.join(counts, ["pivot", "token"]).withColumn("at", F.col("n") - F.count(F.lit(1)).over(each) + F.row_number().over(each.orderBy("times", "token")))
    return met.filter("at <= n - least + 1 and not all_linked").select("pivot", "token", "node", "linked", "n", "far", "at")


def apart(tokens: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v, component): an unlinked node u and a node v of another component that may be linked; may repeat.

    ``placed`` has the component of each node that has one.
    """
    own = tokens.join(placed, "node", "left").withColumn("component", F.coalesce("component", "node"))
    x, y = own.filter("not linked").alias("x"), own.alias("y")
    need = F.ceil((F.col("x.far") + F.col("y.far")) / (2 * (num + den)))
    other = (F.col("x.component") != F.col("y.component")) & (F.col("y.linked") | (F.col("x.node") < F.col("y.node")))
    within = (F.col("x.at") <= F.col("x.n") - need + 1) & (F.col("y.at") <= F.col("y.n") - need + 1)
    both = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token")) & other & within)
    return both.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), F.col("y.component").alias("component"))


def rest(star: DataFrame, linked: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, width: int, num: int, den: int) -> DataFrame:
    """``linked`` (node, component) with the links inside stars that do not touch the pivot."""
    join = lambda placed, more, name: connected(placed.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), scratch, name)
    tokens = scratch.table(prefixes(star), "prefixes")
    # one partner of each component for a node: most links are found so, and merge what else would be compared
    first = scratch.table(apart(tokens, linked, num, den).groupBy("u", "component").agg(F.min("v").alias("v"), F.max("v").alias("last")), "first")
    if first.isEmpty():
        return linked
    found = scratch.table(verified(first.select("u", "v"), nodes, texts, width, num, den), "found")
    if not found.isEmpty():
        linked = scratch.table(join(linked, found, "b"), "merged")
    if first.filter("v != last").isEmpty():
        return linked
    left = apart(tokens, linked, num, den).select("u", "v").distinct().join(first.select("u", "v"), ["u", "v"], "left_anti")
    found = scratch.table(verified(left, nodes, texts, width, num, den), "found2")
    return linked if found.isEmpty() else join(linked, found, "c")


def components(docs: DataFrame, scratch: Scratch, width: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    signed = scratch.table(sign(own, width, rows_of_band(num, den)), "signed")
    # equal sets are one node; a row's signature and bands follow from its set
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("top"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    nodes = scratch.table(nodes, "nodes")
    slots = nodes.select("node", F.explode("bands").alias("band"))
    shared = slots.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    slots = scratch.table(slots.join(shared, "band"), "slots")
    # a node's degree: how many others it meets in all its buckets
    degree = slots.groupBy("node").agg(F.sum(F.col("size") - 1).alias("degree"))
    slots = scratch.table(slots.join(degree, "node"), "ranked")
    scratch.drop("slots")
    pivots = slots.groupBy("band").agg(F.max(F.struct("degree", "node"))["node"].alias("pivot"))
    met = scratch.table(slots.select("node").distinct().join(nodes.drop("bands"), "node"), "met")
    wanted = met.select("node", F.col("top.doc_id").alias("doc_id"), F.col("top.text_hash").alias("text_hash")).alias("w")
    texts = own.alias("o").join(wanted, [F.col("o.doc_id").eqNullSafe(F.col("w.doc_id")), F.col("o.text_hash") == F.col("w.text_hash")])
    texts = scratch.table(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    first = slots.join(pivots, "band").filter("node != pivot").select("node", "pivot").distinct()
    star = scratch.table(stars(first, texts, width, num, den), "star")
    links = star.filter("linked").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    linked = scratch.table(connected(links, scratch, "a"), "linked")
    final = rest(star, linked, met, texts, scratch, width, num, den)
    grouped = nodes.select("node", "top").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("top.doc_id").alias("component_id"))
    named = scratch.table(grouped.join(smallest, "component").select("node", "component_id"), "named")
    rows = signed.select("doc_id", "text_hash", "n_shingles", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_copies(docs: DataFrame, scratch: Scratch, width: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: the one that names it (of repeated rows, one)."""
    found = components(docs.select("doc_id", "text"), scratch, width, num, den)
    gone = found.filter("not kept").select("doc_id", "text_hash").distinct().alias("g")
    name = spare(docs.columns, "text_hash")
    own = docs.withColumn(name, F.xxhash64("text")).alias("d")
    left = own.join(gone, [F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), F.col(f"d.{name}") == F.col("g.text_hash")], "left_anti")
    return left.dropDuplicates(["doc_id", name]).select(*docs.columns)
