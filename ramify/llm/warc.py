"""WARC archives: a deterministic sharded writer, and a reader of what its manifests list.

Layout under the target folder: shard-SSSSS-NNNNN.warc.gz, one gzip member a record; shard-SSSSS.json, the manifest of a shard,
which comes after its files; and MANIFEST.json, which comes last. Everything is written under a temporary name with the attempt
in it and then renamed; a repeated attempt writes the same bytes, so whichever rename comes last, the files are the same. A
folder without MANIFEST.json, or with other shards, files or records than it says, is not read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, fresh, id_in, id_out, partitions, range_of, table

WRITTEN = "shard int, files int, records long, bytes long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

#: The total manifest.
MANIFEST = "MANIFEST.json"

#: A fixed value: archives of the same pages have the same bytes.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(row: dict) -> bytes:
    """One record with headers and digests made anew from the row, as a gzip member without a time."""
    page, payload, digest, first = row["page_id"], row["payload"], row["digest"], row["first"]
    revisit = first != page
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = lambda p: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{p}/{digest}')}>"
    url = "".join(c for c in row["url"] or "" if c not in "\r\n")
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Page-Id", page), ("X-Payload-Length", len(payload))]
    if revisit:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(first)), ("X-Refers-To-Page", first)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(raw):
                raise ValueError("a truncated archive")
            piece = view[at : at + (1 << 16)]
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """A record's row. The digests of block and payload are computed again and must be those in its headers."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(head["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}" or kind == "response" and digest != hashlib.sha1(payload).hexdigest():
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return {"page_id": int(head["X-Page-Id"]), "url": head["WARC-Target-URI"], "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": int(head["X-Refers-To-Page"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


class _Shard:
    """Writes the records of one shard in turn, in files of about roll_bytes."""

    def __init__(self, target: str, number: int, roll_bytes: int) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(target)
        self.number, self.roll, self.attempt = number, roll_bytes, uuid.uuid4().hex
        self.files: list[dict] = []
        self.held: list[bytes] = []
        self.size = 0

    def commit(self, name: str, raw: bytes) -> None:
        at = f"{self.path}/_temporary-{self.attempt}-{name}"
        with self.fs.open_output_stream(at, compression=None) as out:
            out.write(raw)
        self.fs.move(at, f"{self.path}/{name}")

    def add(self, row: dict) -> None:
        one = record(row)
        if self.held and self.size + len(one) > self.roll:
            self.flush()
        self.held.append(one)
        self.size += len(one)

    def flush(self) -> None:
        if self.held:
            raw, name = b"".join(self.held), f"shard-{self.number:05d}-{len(self.files):05d}.warc.gz"
            self.commit(name, raw)
            self.files.append({"name": name, "records": len(self.held), "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()})
            self.held, self.size = [], 0

    def close(self) -> dict:
        self.flush()
        self.commit(f"shard-{self.number:05d}.json", json.dumps({"shard": self.number, "files": self.files}, sort_keys=True).encode())
        return {"shard": self.number, "files": len(self.files), "records": sum(f["records"] for f in self.files), "bytes": sum(f["bytes"] for f in self.files)}


#: What a record has besides its payload, about.
HEAD_BYTES = 700
#: Bytes that a task writes, in one shard or in several in turn.
TASK_BYTES = 128 << 20


def cut_ids(slim: DataFrame, low: int, high: int, shards: int, most: int) -> tuple[list[int], dict[int, int]]:
    """Bounds of ranges of ids (column page_id) with some `most` bytes (column n) each, and ids that alone have more, with the
    number of ranges that they need.

    A histogram over the leading bits of ids, exact, so that the same pages give the same ranges; cells with too many bytes are
    divided by six more bits, all at once, until they are single ids. The driver holds some 16 numbers a range.
    """
    shift = 0
    while (high >> shift) - (low >> shift) >= 16 * shards:
        shift += 1

    def cells(rows: DataFrame, s: int) -> list[tuple[int, int, int]]:
        return [(int(r.c), s, int(r.b)) for r in rows.groupBy(F.shiftright("page_id", s).alias("c")).agg(F.sum("n").alias("b")).collect()]

    done: list[tuple[int, int, int]] = []
    todo = cells(slim, shift)
    while todo:
        done += [x for x in todo if x[2] <= most or x[1] == 0]
        heavy = [x[0] for x in todo if x[2] > most and x[1] > 0]
        if not heavy:
            break
        s, before = max(0, todo[0][1] - 6), todo[0][1]
        own = slim.sparkSession.createDataFrame([(c,) for c in heavy], "c long")
        todo = cells(slim.join(F.broadcast(own), F.shiftright("page_id", before) == F.col("c"), "left_semi"), s)
    bounds, hot, size = [], {}, 0
    for c, s, b in sorted(done, key=lambda x: x[0] << x[1]):
        if s == 0 and b > most:
            hot[c] = -(-b // most)
            size = 0
            continue
        if size and size + b > most:
            bounds.append(c << s)
            size = 0
        size += b
    return bounds, hot


def write(pages: DataFrame, target: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20) -> int:
    """Writes a record for each row and gives the number of shards.

    Of rows with equal payloads of at least min_bytes bytes the one with the largest id is a response, others revisit it;
    smaller ones are all responses. Null html: an empty payload; null url: an empty one; a null id sorts before all others;
    rows alike in all are written one by one, and with the largest id they are all responses. Shards are ranges of ids of about
    shard_bytes of payload; an id that has more rows than that is divided by the digest. Payloads of any length are one record;
    a task holds one file and one payload. Other columns are not read. An empty table gives no shard.
    """
    spark = pages.sparkSession
    raw = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(id_in(key).alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    slim = table(rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n")), "pages")
    seen = slim.agg(F.count("*").alias("n"), F.sum(F.col("n") + HEAD_BYTES).alias("b"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    if not seen.n:
        return 0
    weighed = slim.select("page_id", (F.col("n") + HEAD_BYTES).alias("n"))
    bounds, hot = cut_ids(weighed, seen.low, seen.high, seen.b // shard_bytes + 1, shard_bytes)
    first = slim.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("many")).where("many > 1")
    later = slim.join(table(first, "copies"), ["digest", "n"]).where("page_id <> first").select("page_id", "digest", "first").distinct()
    spread = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(2**31 - 1).cast("long"))
    shard = range_of(F.col("page_id"), spread, bounds, hot).cast("int")
    # a mark sorts right before the rows that it makes revisits, so payloads are exchanged once
    marks = later.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first")
    own = rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.lit(None).cast("long").alias("first"))
    ready = own.union(marks).withColumn("shard", shard)
    schema = arrow_schema(WRITTEN)
    home, path = pafs.FileSystem.from_uri(target)
    home.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done, mark = None, [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if row["payload"] is None:
                    mark = row
                    continue
                row["first"] = mark["first"] if (row["page_id"], row["digest"]) == (mark.get("page_id"), mark.get("digest")) else row["page_id"]
                if open_ is None or open_.number != row["shard"]:
                    if open_:
                        done.append(open_.close())
                    open_ = _Shard(target, row["shard"], roll_bytes)
                open_.add(row)
        if open_:
            done.append(open_.close())
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    tasks = max(partitions(spark), min(seen.b // TASK_BYTES, len(bounds) + sum(hot.values())) + 1)
    spread = ready.repartition(tasks, "shard").sortWithinPartitions("shard", "page_id", "digest", F.col("payload").isNotNull(), "url")
    total = spread.mapInArrow(run, WRITTEN).agg(F.sum("records").alias("n"), F.count("*").alias("shards"), F.sum("files").alias("files")).first()
    if total.n != seen.n:
        raise RuntimeError(f"{total.n} records written for {seen.n} pages")
    with home.open_output_stream(f"{path}/_temporary-manifest", compression=None) as out:
        out.write(json.dumps({"shards": total.shards, "files": total.files, "records": total.n}).encode())
    home.move(f"{path}/_temporary-manifest", f"{path}/{MANIFEST}")
    return total.shards


def read(spark: SparkSession, target: str) -> DataFrame:
    """The records of the files that the manifests list: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits).

    Raises at once if MANIFEST.json is missing or doesn't agree with the manifests of shards, or if a file is missing; and when
    rows are asked for if a file differs from its manifest in digest or number of records.
    """
    schema = arrow_schema(READ)
    try:
        whole = spark.read.schema("shards long, files long, records long").option("wholetext", True).json(f"{target}/{MANIFEST}").first()
    except AnalysisException as e:
        raise FileNotFoundError(f"no {MANIFEST} in {target}: the write has not ended") from e
    listed = spark.read.schema("shard int, files array<struct<name: string, records: long, sha256: string>>").option("wholetext", True).json(f"{target}/shard-*.json")
    names = listed.select(F.explode("files").alias("f")).select(F.col("f.name").alias("name"), F.col("f.records").alias("records"), F.col("f.sha256").alias("sha"))
    found = listed.agg(F.countDistinct("shard").alias("shards"), F.sum(F.size("files")).alias("files"), F.sum(F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["records"])).alias("records")).first()
    if found != whole:
        raise ValueError(f"the manifests of shards have {found}, {MANIFEST} {whole}")
    files = spark.read.format("binaryFile").load(f"{target}/shard-*.warc.gz").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    gone = names.join(files.select("name"), "name", "left_anti").limit(3).collect()  # reads names, not files
    if gone:
        raise FileNotFoundError(f"in a manifest, but not there: {', '.join(r.name for r in gone)}")
    files = files.join(names, "name").select("content", "sha", "records", "name")  # inner, so that contents need not move

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, sha, records, name = (batch.column(j)[i].as_py() for j in range(4))
                if hashlib.sha256(raw).hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest")
                rows, seen = [], 0
                for one in members(raw):
                    rows.append(parse(one))
                    seen += 1
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, its manifest {records}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to a folder of their own in the shared folder and reads them back: one row per row of pages.

    page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to; see write() for nulls, ties and repeats.
    """
    spark = pages.sparkSession
    target = fresh(spark, "warc")
    if not write(pages, target):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    out = read(spark, target)
    return out.select(id_out("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_out("refers_to").alias("refers_to"))
