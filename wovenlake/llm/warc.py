"""Deterministic sharded WARC writer and reader.

Pages are range-sorted by (id, payload digest) into shards of about equal payload. The cuts come from running sums
over the sorted narrow keys, so the layout depends on the data alone, and neither a far-off id nor an id (or null)
that many pages share makes a large shard. Payloads are shuffled once, to the task of their shard. Within a shard
records are written in key and url order and files roll when their compressed size passes a limit. Headers, record
ids and digests are made again from the record. A file is written under a temporary name of its task attempt and
renamed when complete; since its content is fixed by its name, a repeated or speculative attempt replaces it by the
same bytes. Names, sizes and checksums of all files go to a manifest, and the manifest's own rename commits the
archive: readers take files from the manifest only.

Equal payloads: the record with the largest page id is the response, the others are revisits that refer to it. That id
is found by an aggregate over digests with partial sums; narrow rows (id, digest, response) travel to the shards of
their records and precede them there, so a payload that a third of all pages share never meets in one task.

Defined results: null html is an empty payload. A null id sorts first, never wins over an id, and refers_to is null if
the response has no id. Rows with equal id and equal payload that are the largest are all responses. Rows equal in id
and payload that outweigh two shards are dealt to several; how many each gets follows the order of the input. An empty
table gives an archive with an empty manifest.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, base_columns, new_folder, remove

#: Files roll after so many compressed bytes.
ROLL_BYTES = 64_000_000
#: A shard holds about so many payload bytes.
SHARD_BYTES = 24_000_000
#: Weight of a record beside its payload.
RECORD_BYTES = 600
#: Shards grow beyond SHARD_BYTES where the archive would have more than so many.
MOST_SHARDS = 65_536
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record (uncompressed): a response with its HTTP headers and payload, or a revisit with headers only."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%!*()~-._')}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """pyarrow's file system for the shared folder (file, hdfs, s3, gs ... by the scheme) and the path in it."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class ShardWriter:
    """Writes one shard: rolls files by compressed size, renames each when it is complete."""

    def __init__(self, folder: str, shard: int, roll: int, attempt: str):
        self.fs, self.base = _filesystem(folder)
        self.shard, self.roll, self.attempt, self.part = shard, roll, attempt, 0
        self.out = None

    def add(self, data: bytes) -> Iterator[dict]:
        member = gzip.compress(data, 6, mtime=0)
        if self.out is not None and self.size + len(member) > self.roll:
            yield self.close()
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.temporary = f"{self.base}/_temporary-{self.attempt}-{self.name}"
            self.out, self.size, self.n, self.crc = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, 0
        self.out.write(member)
        self.size, self.n, self.crc = self.size + len(member), self.n + 1, zlib.crc32(member, self.crc)

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        done = {"file": self.name, "shard": self.shard, "records": self.n, "bytes": self.size, "crc32": self.crc}
        self.out, self.part = None, self.part + 1
        return done


MANIFEST = "file string, shard int, records bigint, bytes bigint, crc32 bigint"


def shard_bounds(weights: DataFrame, shard_bytes: int, most_shards: int, scratch: Scratch) -> tuple[int, list[tuple]]:
    """(number of shards, [(page_id, sha, first shard, shards of this key)]): keys (page_id, sha) in order, cut where the
    running sum of their weight (long, one row a key) passes a multiple of the shard size.

    The sum over all keys comes from sums of the range-sorted partitions, so the cuts depend on the data alone. At most
    most_shards + 1 cuts come to the driver; a key heavier than two shards is dealt to several.
    """
    parts = max(1, int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = scratch.keep(weights.repartitionByRange(parts, "page_id", "sha").withColumn("part", F.spark_partition_id()), "ranged")
    sums = {r["part"]: r["w"] for r in ranged.groupBy("part").agg(F.sum("weight").alias("w")).collect()}  # one row a partition
    total = sum(sums.values())
    size = max(shard_bytes, -(-total // most_shards))
    before, at = {}, 0
    for k in sorted(sums):
        before[k], at = at, at + sums[k]
    if not sums:
        return 1, []
    w = Window.partitionBy("part").orderBy("page_id", "sha")
    start = F.element_at(F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)]), F.col("part")) + F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    cut = ranged.withColumn("shard", (start / size).cast("long"))
    cut = cut.withColumns({"previous": F.lag("shard").over(w), "pieces": F.greatest(F.lit(1), (F.col("weight") / size).cast("long"))})
    rows = cut.filter("previous is null or previous <> shard or pieces > 1").select("page_id", "sha", "shard", "pieces").collect()
    found = sorted(((r["page_id"], bytes(r["sha"]), r["shard"], r["pieces"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return -(-total // size) or 1, found


def shards_of(bounds: list[tuple]):
    """A function from arrays of (page_id, sha) to the shards of each key: the last cut at or before it decides."""
    keys = [(r[0] is not None, r[0] or 0, r[1]) for r in bounds]

    def find(page_id: int | None, sha: bytes) -> list[int]:
        key = (page_id is not None, page_id or 0, sha)
        i = bisect.bisect_right(keys, key) - 1
        if i < 0:
            return [0]
        if bounds[i][3] > 1:  # a heavy key has its shards for itself; what follows it up to the next cut joins the last
            own = list(range(bounds[i][2], bounds[i][2] + bounds[i][3]))
            return own if keys[i] == key else own[-1:]
        return [bounds[i][2]]

    return find


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> None:
    """Write pages as an archive below folder (a URI that all executors reach) and commit its manifest."""
    spark = pages.sparkSession
    p = base_columns(pages, page_id=id_col, url=url_col, html=html_col).withColumns({"html": F.encode(F.coalesce("html", F.lit("")), "UTF-8"), "page_id": F.col("page_id").cast("long")})
    p = p.withColumn("sha", F.unhex(F.sha1("html")))
    with Scratch(spark) as scratch:
        narrow = p.select("page_id", "sha", F.octet_length("html").cast("long").alias("bytes"))
        keys = scratch.keep(narrow.groupBy("page_id", "sha").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes")), "keys")
        n_shards, bounds = shard_bounds(keys.select("page_id", "sha", (F.col("n") * (F.col("bytes") + RECORD_BYTES)).alias("weight")), shard_bytes, MOST_SHARDS, scratch)
        shared = spark.sparkContext.broadcast(bounds)  # at most MOST_SHARDS + 1 cuts and the heavy keys among them

        @F.pandas_udf("array<int>")
        def shards(page_id: pd.Series, sha: pd.Series) -> pd.Series:
            find = shards_of(shared.value)
            return pd.Series([find(None if pd.isna(i) else int(i), bytes(h)) for i, h in zip(page_id, sha, strict=True)], dtype=object)

        # the response of each repeated payload; narrow rows, one a key, whose response is another record
        last = keys.filter(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("largest"), F.sum("n").alias("copies")).filter("copies > 1")
        others = keys.select("page_id", "sha").join(last.select("sha", "largest"), "sha").filter("largest is not null and not page_id <=> largest")
        id_text = F.col("page_id").cast("string")  # a long column with nulls would reach Python as doubles
        mark = others.withColumn("shard", F.explode(shards(id_text, "sha"))).select("shard", "page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), F.col("largest").alias("refers_to"))
        of = shards(id_text, F.col("sha"))
        spread = p.withColumn("shards", of).withColumn("shard", F.element_at("shards", (F.pmod(F.monotonically_increasing_id(), F.size("shards")) + 1).cast("int")))
        record_rows = spread.select("shard", "page_id", "sha", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
        # the one shuffle of payloads: a task for each shard, and in it the mark of a key before its records
        ready = mark.unionByName(record_rows).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "sha", "kind", "url")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            attempt, writer, done, marked, refers_to = str(TaskContext.get().taskAttemptId()), None, [], None, None
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    for r in batch.slice(at, 200).to_pylist():
                        if r["kind"] == 0:
                            marked, refers_to = (r["page_id"], r["sha"]), r["refers_to"]
                            continue
                        if writer is None or writer.shard != r["shard"]:
                            done += [writer.close()] if writer else []
                            writer = ShardWriter(folder, r["shard"], roll_bytes, attempt)
                        to = refers_to if marked == (r["page_id"], r["sha"]) else None
                        done += writer.add(record(r["page_id"], r["url"], r["html"], to, to is not None))
            done += [writer.close()] if writer else []
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())]))

        fs, base = _filesystem(folder)
        fs.create_dir(base)
        ready.mapInArrow(write, MANIFEST).write.json(f"{folder}/_manifest-temporary")
        fs.move(f"{base}/_manifest-temporary", f"{base}/manifest")


def parse(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream; digests are verified."""
    while line := data.readline():
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip()] = v.strip()
        block = data.read(int(head["Content-Length"]))
        if head["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
        yield head, block


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) from the manifest's files.

    html is the payload of a response and null for a revisit.
    """
    files = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    n = files.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for f in batch.to_pylist():
                rows, held, n = [], 0, 0
                with fs.open_input_stream(f"{base}/{f['file']}", compression=None) as raw, gzip.open(io.BufferedReader(raw), "rb") as data:
                    for head, block in parse(data):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))[15:])
                        revisit = head["WARC-Type"] == "revisit"
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != size or digest != base32_sha1(payload)):
                            raise ValueError(f"payload of {head['WARC-Record-ID']}")
                        page, refers, url = head.get("X-Page-ID"), head.get("X-Refers-To-Page"), head.get("WARC-Target-URI")
                        rows.append({"page_id": int(page) if page else None, "url": unquote(url) if url else None, "html": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(refers) if refers else None})
                        held, n = held + len(payload), n + 1
                        if held > 8_000_000 or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if n != f["records"]:
                    raise ValueError(f"{f['file']} has {n} records, not {f['records']}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    columns = "page_id bigint, url string, html binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.repartition(max(1, n), "file").mapInArrow(read, columns)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to the shared folder and read the archive back, without the payloads; the archive is deleted."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archive(pages, folder, least_bytes=least_bytes)
    with Scratch(spark) as scratch:
        found = read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        found = scratch.release(scratch.keep(found, "records"))
    remove(spark, folder)
    return found


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || x[i * 5 + 1 : i * 5 + 5])::BIGINT) AS v, max(page_id) OVER (PARTITION BY x) AS largest FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda y: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((y >> s::BIGINT) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM g
"""
