"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked. Each group of links starts scattered
over the shards by a hash of its documents; in every round a group's documents
move to the shard that already holds most of them, as far as that shard's quota
has room: where more want in than fit, a fixed share of the groups (by hash)
may move. What the rounds leave scattered is settled: every group takes the label
of most of its documents, whole groups fill each shard up to its quota, and the
groups beyond it are laid one after another into the room that is left, where
only those at a shard's edge are cut. A group larger than a quarter of a quota
is placed before the rounds, in as few neighbouring shards as hold it. So at
most twice ``shards`` groups are cut, whatever share of the documents is linked.
Documents without links then fill the rest, so that all shards hold the same
number of rows, one more or less.

Nothing is kept per pair of documents: a group is one row for each shard that
it occupies. Ranks are sums over buckets of a hash plus a window inside a
bucket, so neither a shard nor a large group has to fit one task.

Cases: a null text is 8 bytes and crc32 of nothing, and is linked with nothing;
empty texts are equal texts; repeated rows are rows of their own; with fewer
rows than shards some shards stay empty; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.names import spare
from lexigrain.storage import Scratch

#: Buckets of each rank; (shards + 1) * MOST_BUCKETS rows is what a broadcast of them can hold at most.
MOST_BUCKETS = 4096


def _unit(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def _quotas(scratch: Scratch, n: int, shards: int) -> DataFrame:
    """One row a shard: how many rows it holds in the end."""
    return scratch.spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(n // shards) + (F.col("id") < n % shards).cast("long")).alias("quota"))


def propagate(linked: DataFrame, quotas: DataFrame, scratch: Scratch, shards: int, rounds: int) -> DataFrame:
    """(link, shard, rows): how many of each group's rows every shard takes.

    ``linked`` has a row for each linked document: link, member (a hash).
    """
    start = F.pmod(F.xxhash64("member", F.lit(3)), F.lit(shards)).cast("int")
    state = scratch.table(linked.groupBy("link", start.alias("shard")).agg(F.count(F.lit(1)).alias("rows")), "labels0")
    whole = Window.partitionBy("link")
    for k in range(rounds):
        loads = state.groupBy("shard").agg(F.sum("rows").alias("load"))
        room = quotas.join(F.broadcast(loads), "shard", "left").select("shard", "quota", F.coalesce("load", F.lit(0)).alias("load"))
        seen = state.join(F.broadcast(room), "shard")
        # the neighbours' plurality; a shard that is full only counts while the group is wholly inside
        fit = F.greatest(F.col("quota") - F.col("load"), F.lit(0))
        best = F.max_by(F.struct("shard", "rows", fit.alias("free")), F.struct((fit > 0).cast("int"), F.col("rows"), -_unit(F.col("link"), F.col("shard")))).over(whole)
        wish = seen.select("link", "shard", "rows", best.alias("best"), F.sum("rows").over(whole).alias("all"))
        moving = wish.filter(F.col("shard") == F.col("best.shard")).select("link", F.col("best.shard").alias("to"), (F.col("all") - F.col("rows")).alias("more"))
        demand = moving.groupBy("to").agg(F.sum("more").alias("demand")).join(F.broadcast(room.select(F.col("shard").alias("to"), (F.col("quota") - F.col("load")).alias("free"))), "to")
        # what wants in beyond the quota stays out: whole small groups by hash, large groups in part
        rates = demand.select("to", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("free") / F.greatest(F.col("demand"), F.lit(1)))).alias("rate"), F.greatest("free", F.lit(0)).alias("free"))
        judged = wish.withColumn("to", F.col("best.shard")).join(F.broadcast(rates), "to")
        large = F.col("all") * 4 > F.col("free")
        goes = F.when(large, F.floor(F.col("rows") * F.col("rate"))).otherwise(F.when(_unit(F.col("link"), F.lit(k)) < F.col("rate"), F.col("rows")).otherwise(0))
        goes = F.when(F.col("shard") == F.col("to"), 0).otherwise(goes).cast("long")
        parts = judged.withColumn("goes", goes).select("link", F.explode(F.array(F.struct(F.col("shard").alias("shard"), (F.col("rows") - F.col("goes")).alias("rows")), F.struct(F.col("to").alias("shard"), F.col("goes").alias("rows")))).alias("p"))
        state = scratch.table(parts.groupBy("link", F.col("p.shard").alias("shard")).agg(F.sum("p.rows").alias("rows")).filter("rows > 0"), f"labels{k + 1}")
        scratch.drop(f"labels{k}")
    return state


def _laid(groups: DataFrame, room: DataFrame) -> DataFrame:
    """(link, shard, lo, hi): which documents [lo, hi) of each group every shard takes, where ``start`` and ``n`` place the group on the line of all room."""
    upto = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    line = room.select("shard", "free", F.sum("free").over(upto).alias("to")).withColumn("from", F.col("to") - F.col("free"))
    end = F.col("start") + F.col("n")
    met = groups.join(F.broadcast(line), (F.col("start") < F.col("to")) & (end > F.col("from")) & (F.col("free") > 0))
    return met.select("link", "shard", (F.greatest("start", "from") - F.col("start")).alias("lo"), (F.least(end, F.col("to")) - F.col("start")).alias("hi"))


def _begun(groups: DataFrame, group: list[str], buckets: int) -> DataFrame:
    """Adds ``start``: the rows ``n`` of all links before this one inside each group, by a hash."""
    groups = groups.withColumn("place", F.pmod(F.xxhash64("link", F.lit(5)), F.lit(1 << 40))).withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int"))
    keys = [*group, "bucket"]
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy(*keys).agg(F.sum("n").alias("s")).select(*keys, F.coalesce(F.sum("s").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*keys).orderBy("place", "link").rowsBetween(Window.unboundedPreceding, -1)
    out = groups.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), keys)
    return out.withColumn("start", F.col("start") + F.col("first")).drop("first", "bucket", "place")


def settle(state: DataFrame, room: DataFrame, scratch: Scratch, buckets: int) -> DataFrame:
    """(link, shard, lo, hi) from the labels that the rounds left: groups stay whole but for those at the edges of what is free."""
    label = F.max_by("shard", F.struct(F.col("rows"), -_unit(F.col("link"), F.col("shard"))))
    groups = state.groupBy("link").agg(F.sum("rows").alias("n"), label.alias("shard"))
    placed = _begun(groups, ["shard"], buckets).join(F.broadcast(room.select("shard", F.col("quota").alias("free"))), "shard")
    placed = scratch.table(placed.withColumn("fits", F.col("start") + F.col("n") <= F.col("free")).drop("free"), "settled")
    stays = placed.filter("fits").select("link", "shard", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))
    loads = placed.filter("fits").groupBy("shard").agg(F.sum("n").alias("load"))
    left = room.join(F.broadcast(loads), "shard", "left").select("shard", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("free"))
    others = _begun(placed.filter("not fits").select("link", "n", F.lit(0).alias("pool")), ["pool"], buckets)
    return stays.unionByName(_laid(others, left))


def _ranked(rows: DataFrame, group: list[str], buckets: int) -> DataFrame:
    """Adds a gapless ``rank`` from 0 inside each group, by (place, member)."""
    rows = rows.withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int"))
    keys = [*group, "bucket"]
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy(*keys).orderBy("place", "member", "doc_id")
    return rows.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(starts), keys).withColumn("rank", F.col("rank") + F.col("first")).drop("first", "bucket")


def shard(docs: DataFrame, scratch: Scratch, shards: int = 24, rounds: int = 4, keep: tuple[str, ...] = (), bucket_rows: int = 2_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, and columns of ``docs`` named in ``keep``.

    Only a narrow table (hashes and sizes) goes through the rounds.
    """
    raw = F.encode("text", "UTF-8")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(raw).alias("link"),
        F.xxhash64("doc_id", "text").alias("member"),
        *keep,
    )
    narrow = scratch.table(narrow, "narrow")
    n = narrow.count()
    quotas = scratch.table(_quotas(scratch, n, shards).coalesce(1), "quotas")
    counts = scratch.table(narrow.filter("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    buckets = max(1, min(MOST_BUCKETS, n // bucket_rows + 1))
    # at most 4 * shards groups are large
    large = counts.filter(F.col("n") * 4 > n // shards)
    upto = Window.partitionBy().orderBy(F.desc("n"), "link").rowsBetween(Window.unboundedPreceding, -1)
    first = scratch.table(_laid(large.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))), quotas.withColumnRenamed("quota", "free")), "large")
    taken = F.broadcast(first.groupBy("shard").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken")))
    room = scratch.table(quotas.join(taken, "shard", "left").select("shard", (F.col("quota") - F.coalesce("taken", F.lit(0))).alias("quota")).coalesce(1), "room")
    linked = narrow.join(counts.filter(F.col("n") * 4 <= n // shards).select("link"), "link", "left_semi")
    state = propagate(linked.select("link", "member"), room, scratch, shards, rounds)
    pieces = scratch.table(first.unionByName(settle(state, room, scratch, buckets)), "pieces")
    # where a group occupies several shards, the rank of a document in it says which it goes to; at most 2 * shards groups do
    cut = scratch.table(pieces.groupBy("link").agg(F.sort_array(F.collect_list(F.struct("hi", "shard"))).alias("spans")).filter(F.size("spans") > 1), "cut")
    rows = narrow.withColumn("place", F.pmod(F.xxhash64("member", F.lit(17)), F.lit(1 << 40)))
    at = F.element_at(F.filter("spans", lambda x: x["hi"] > F.col("rank")), 1)["shard"]
    split = _ranked(rows.join(F.broadcast(cut), "link"), ["link"], buckets).withColumn("label", at).drop("spans", "rank")
    whole = rows.join(F.broadcast(cut.select("link")), "link", "left_anti").join(pieces.select("link", F.col("shard").alias("label")), "link", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    ranked = scratch.table(_ranked(whole.unionByName(split), ["label"], buckets), "ranked")
    loads = F.broadcast(ranked.filter("label >= 0").groupBy(F.col("label").alias("shard")).agg(F.count(F.lit(1)).alias("load")))
    upto = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    room = quotas.join(loads, "shard", "left").withColumn("held", F.least("quota", F.coalesce("load", F.lit(0))))
    room = room.withColumn("to", F.sum(F.col("quota") - F.col("held")).over(upto)).withColumn("from", F.col("to") - F.col("quota") + F.col("held"))
    room = F.broadcast(room.select("shard", "quota", "held", "from", "to"))
    placed = ranked.join(room.select(F.col("shard").alias("label"), "quota"), "label", "left")
    stays = placed.filter(F.col("rank") < F.col("quota"))
    pool = placed.filter(F.col("quota").isNull() | (F.col("rank") >= F.col("quota"))).drop("rank", "quota").withColumn("pool", F.lit(0))
    filled = _ranked(pool, ["pool"], buckets).join(F.broadcast(room), (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    out = ["doc_id", "size", "text_crc32", "shard", "slot", *keep]
    return stays.withColumn("shard", F.col("label")).withColumn("slot", F.col("rank").cast("long")).select(*out).unionByName(filled.withColumn("slot", (F.col("held") + F.col("rank") - F.col("from")).cast("long")).select(*out))


def assign(docs: DataFrame, scratch: Scratch, shards: int = 24) -> DataFrame:
    """``docs`` with shard and slot (instead of columns of these names); rows that are equal in all columns are interchangeable."""
    row = spare([*docs.columns, "shard", "slot"], "row_hash")
    own = docs.withColumn(row, F.xxhash64(*docs.columns))
    placed = shard(own, scratch, shards, keep=(row,)).select("doc_id", row, "shard", "slot").alias("p")
    once = own.dropDuplicates(["doc_id", row]).alias("d")
    joined = once.join(placed, [F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), F.col(f"d.`{row}`") == F.col(f"p.`{row}`")])
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns if c not in ("shard", "slot")], "p.shard", "p.slot")
