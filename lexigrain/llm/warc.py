"""A deterministic, sharded WARC writer, and a reader of what it wrote.

Records are sorted by page_id and dealt to shards by ranges of it that hold about
equally many bytes. Their bounds come from exact byte counts: ranges with too
many bytes are divided again until all are small or one page_id is left, so the
same rows always give the same files, however their page_ids are spread. Each
shard is written by one task, record by record, and rolls to the next file when
its compressed size passes ``roll`` or its plain size ``ROLL_PLAIN`` times that.
Headers and digests are made anew.

A file is written under a temporary name and renamed when complete; its name
holds its digest, so another attempt at the same shard writes the same name with
the same content and removes nothing. The table of complete files (the manifest)
is committed last. Readers take exactly the files that it names, and fail if one
is missing, is altered, or holds another number of records.

Of records with equal payloads of at least ``least`` bytes the one with the
largest page_id is a response, the others are revisits that refer to it.

Cases: a null payload is empty; a null url is left out; a null page_id sorts
first and never is what others refer to unless all are null; rows with the same
page_id and payload are all responses if that page_id is the largest, and
records of one page_id are numbered in their ids; an empty table gives no files;
other columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = 4096
#: Shards at most; their bounds are kept on the driver, and shards grow beyond that.
MOST_SHARDS = 8192
#: A file's plain size at most, as a multiple of ``roll``: it is what a reader may have to pass through.
ROLL_PLAIN = 16
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
#: Fixed value: records carry a constant date, as files must not depend on when they are written.
DATE = "2000-01-01T00:00:00Z"


def _head(lines: list[tuple[str, str]], block: bytes) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + f"Content-Length: {len(block)}\r\n\r\n"
    return text.encode() + block + b"\r\n\r\n"


def _base32(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, copy: int = 0) -> bytes:
    """One record, uncompressed; ``copy`` counts the records of one page_id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda x: f"<urn:x-page:{'none' if x is None else x}>"
    uri = "" if url is None else "".join(c for c in url if c >= " ").strip()
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id) if not copy else f"{name(page_id)[:-1]}.{copy}>")]
    lines += [("WARC-Target-URI", uri)] if uri else []
    lines += [("WARC-Date", DATE), ("WARC-Payload-Digest", _base32(payload)), ("WARC-Block-Digest", _base32(block)), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    return _head([*lines, ("Content-Type", "application/http; msgtype=response")], block)


def parse(file: BinaryIO) -> Iterator[dict]:
    """The records of an uncompressed WARC stream, one in memory at a time; lengths and digests are checked."""
    n = 0
    while line := file.readline():
        n, head = n + 1, {}
        while (line := file.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"record {n} ends in its head")
            key, value = line.decode().rstrip("\r\n").split(": ", 1)
            head[key] = value
        block = file.read(int(head["Content-Length"]))
        if file.read(4) != b"\r\n\r\n" or _base32(block) != head["WARC-Block-Digest"]:
            raise ValueError(f"record {n} is damaged")
        if head["WARC-Type"] == "warcinfo":
            continue
        number = lambda k: None if (x := head[k][len("<urn:x-page:") : -1].split(".")[0]) == "none" else int(x)
        response = head["WARC-Type"] == "response"
        digest = base64.b32decode(head["WARC-Payload-Digest"][5:])
        payload = block[block.index(b"\r\n\r\n") + 4 :] if response else None
        if response and hashlib.sha1(payload).digest() != digest:
            raise ValueError(f"the payload of record {n} is damaged")
        yield {"page_id": number("WARC-Record-ID"), "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest.hex(), "record_type": head["WARC-Type"], "refers_to": None if response else number("WARC-Refers-To"), "url": head.get("WARC-Target-URI"), "payload": payload}


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, sha1, refers_to): the records that repeat a payload; payloads themselves do not move."""
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("size"))
    rows = rows.filter(F.col("size") >= least).drop("size")
    groups = rows.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return rows.join(groups, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha1", "refers_to").distinct()


def _unsigned(ids: np.ndarray) -> np.ndarray:
    """64-bit ids in their order, as numbers from 0: differences of any two fit."""
    return ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _steps(starts: list[int], widths: list[int], ends: list[int], steps: int):
    """A column function: page_id to range * steps + step, null outside of all ranges."""
    low, high, width = (np.array(x, np.uint64) for x in (starts, ends, widths))

    @F.arrow_udf(T.LongType())
    def place(ids: pa.Array) -> pa.Array:
        at = _unsigned(ids.fill_null(0).to_numpy(zero_copy_only=False))
        k = np.searchsorted(low, at, "right").astype(np.int64) - 1
        inside = (k >= 0) & (at <= high[np.maximum(k, 0)]) & ids.is_valid().to_numpy(zero_copy_only=False)
        k = np.maximum(k, 0)
        step = ((at - low[k]) // width[k]).astype(np.int64)
        return pa.array(np.where(inside, k * steps + step, 0), pa.int64(), mask=~inside)

    return place


def ranges(pages: DataFrame, shard_bytes: int) -> list[int]:
    """Smallest page_ids of shards 1, 2, ...

    ``pages`` has page_id and size. A range with more than its share of bytes is
    divided into equal steps, whose bytes are counted; STEPS + 2 * MOST_SHARDS
    rows at most come to the driver for each division.
    """
    lo, hi, total = pages.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    if lo is None or total <= shard_bytes:
        return []
    most = max(shard_bytes, total // (MOST_SHARDS // 2) + 1)
    bias = 1 << 63
    done, heavy = [], [(lo + bias, hi + bias)]
    while heavy:
        steps = max(2, STEPS // len(heavy))
        widths = [(b - a) // steps + 1 for a, b in heavy]
        place = _steps([a for a, _ in heavy], widths, [b for _, b in heavy], steps)
        found = pages.select(place("page_id").alias("k"), "size").filter("k is not null").groupBy("k").agg(F.sum("size").alias("n")).collect()
        again = []
        for k, n in sorted(map(tuple, found)):
            (a, b), width = heavy[k // steps], widths[k // steps]
            part = (a + k % steps * width, min(b, a + (k % steps + 1) * width - 1))
            if n > most and part[0] < part[1]:
                again.append(part)
            else:
                done.append((*part, n))
        heavy = again
    cuts, held = [], 0
    for a, _, n in sorted(done):
        if held and held + n > most:
            cuts.append(a - bias)
            held = 0
        held += n
    return cuts


def write(pages: DataFrame, path: str, least: int = 1000, shard_bytes: int = 32 << 20, roll: int = 16 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``path``; returns the committed manifest."""
    sizes = pages.select(F.col("page_id").cast("long"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 512).cast("long").alias("size"))
    cuts = ranges(sizes, shard_bytes)
    shard = F.lit(0)
    if cuts:
        bounds = np.array(cuts, np.int64)

        @F.arrow_udf(T.IntegerType())
        def shard_of(ids: pa.Array) -> pa.Array:
            k = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
            return pa.array(np.where(ids.is_valid().to_numpy(zero_copy_only=False), k, 0).astype(np.int32))

        shard = shard_of("page_id")
    # what is known of a record comes right before it: payloads go through one shuffle only
    known = revisits(pages, least).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha1", "refers_to", F.lit(0).alias("kind"))
    bodies = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    rows = known.unionByName(bodies).withColumn("shard", shard)
    # one partition a shard: shard numbers are their own partition numbers
    dealt = rows.repartitionByRange(len(cuts) + 1, "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{root}/data", recursive=True)
        done: list[tuple] = []
        state = {"shard": None, "seq": 0, "buffer": None, "n": 0, "plain": 0, "page": (None, None), "known": {}, "copy": 0}

        def close() -> None:
            if state["buffer"] is None:
                return
            raw = state["buffer"].getvalue()
            digest = hashlib.sha256(raw).hexdigest()
            name = f"part-{state['shard']:06d}-{state['seq']:05d}-{digest[:16]}.warc.gz"
            temporary, final = f"{root}/data/.{name}.{uuid.uuid4().hex}", f"{root}/data/{name}"
            if fs.get_file_info(final).type == pafs.FileType.NotFound:
                with fs.open_output_stream(temporary) as out:
                    out.write(raw)
                try:
                    fs.move(temporary, final)
                except OSError:  # another attempt was first, with the same content
                    if fs.get_file_info(final).type == pafs.FileType.NotFound:
                        raise
                    fs.delete_file(temporary)
            done.append((name, state["shard"], state["n"], len(raw), digest))
            state.update(buffer=None, n=0, plain=0, seq=state["seq"] + 1)

        for batch in batches:
            ids, urls, payloads, digests, refers, kinds, shards = (batch.column(k) for k in range(7))
            for i in range(len(batch)):
                s, page_id = shards[i].as_py(), ids[i].as_py()
                if state["page"] != (s, page_id):
                    state.update(page=(s, page_id), known={}, copy=0)
                if kinds[i].as_py() == 0:
                    state["known"][digests[i].as_py()] = refers[i].as_py()
                    continue
                if s != state["shard"]:
                    close()
                    state.update(shard=s, seq=0)
                if state["buffer"] is None:
                    state["buffer"] = io.BytesIO()
                    info = _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-part:{s}:{state['seq']}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", _base32(b"format: WARC File Format 1.1\r\n"))], b"format: WARC File Format 1.1\r\n")
                    state["buffer"].write(gzip.compress(info, 6, mtime=0))
                payload = payloads[i].as_py()
                refers_to = state["known"].get(hashlib.sha1(payload).hexdigest()) if state["known"] else None
                one = record(page_id, urls[i].as_py(), payload, refers_to, refers_to is not None, state["copy"])
                state["buffer"].write(gzip.compress(one, 6, mtime=0))
                state["n"] += 1
                state["copy"] += 1
                state["plain"] += len(one)
                if state["buffer"].tell() >= roll or state["plain"] >= ROLL_PLAIN * roll:
                    close()
        close()
        columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["file", "shard", "records", "bytes", "sha256"])

    manifest = dealt.select("page_id", "url", "payload", "sha1", "refers_to", "kind", "shard").mapInArrow(run, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return dealt.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read(spark, path: str, payload: bool = True) -> DataFrame:
    """READ: every record of the files that the manifest names."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(f"{path}/data")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # every file of the manifest, found or not; a shard's folder may hold files of other runs
    named = manifest.select("file", "sha256", "records").join(files, "file", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for i in range(len(batch)):
                name, digest, records, raw = (batch.column(k)[i].as_py() for k in range(4))
                if raw is None:
                    raise ValueError(f"{name} of the manifest is missing")
                if hashlib.sha256(raw).hexdigest() != digest:
                    raise ValueError(f"{name} differs from its manifest")
                rows, n, held = [], 0, 0
                # a stream: records are unpacked one by one, whatever the file holds
                for r in parse(gzip.GzipFile(fileobj=io.BytesIO(raw))):
                    n, held = n + 1, held + len(r["payload"] or b"") * payload
                    rows.append(r if payload else r | {"payload": None})
                    if len(rows) >= 1000 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if n != records:
                    raise ValueError(f"{name} has {n} records instead of {records}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return named.select("file", "sha256", "records", "content").mapInArrow(run, READ)
