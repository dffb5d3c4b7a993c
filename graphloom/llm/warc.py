"""WARC archives of pages, and their index merged into globally ordered capture histories.

Writing: pages with equal payloads are found by digest; the one with the smallest id is a response
record, the others are revisit records that refer to it. Each task writes compressed archives of
bounded size to the shared folder; a written manifest names those of the attempts that succeeded.
Reading: each archive gives a run of captures, sorted by URL key and timestamp. Runs are dealt by
ranges of the key and each range is merged by a loser tree, so that partitions in turn hold the
histories of all URLs in order.

Defined results: a null page has an empty payload; payloads of any length are written whole; rows
that repeat the smallest id of their payload are all responses; a null id is never the smallest
unless all are null; a null url has an empty key; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, materialize, prepare, scratch_path, table, with_row_id
from .merging import merge_runs

#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
#: Captures that one merging task has on average.
MERGED_TOGETHER = 50_000
#: Pages have no capture time of their own: page n counts as captured n seconds after this.
FIRST_CAPTURE = 1_704_067_200

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "urlkey string, timestamp string, id string, archive string, position long, length long, payload_bytes long, payload_digest string, record_type string, refers_to string"
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]


def url_key(url: str) -> str:
    """Host with its parts reversed, then path and query: ``com,example,www)/a?b``."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return url
    name = ",".join(reversed((parts.hostname or "").split(".")))
    return f"{name}){parts.path or '/'}" + f"?{parts.query}" * bool(parts.query)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(ident: str | None, row: str) -> str:
    """Of a page and the row that it stands in, as page ids may repeat."""
    return f"<urn:page:{row}:null>" if ident is None else f"<urn:page:{row}:id:{quote(ident, safe='')}>"


def _ident(record_id: str) -> str | None:
    kind, *ident = record_id[len("<urn:page:") : -1].split(":", 2)[1:]
    return None if kind == "null" else unquote(ident[0])


def record(ident: str | None, row: str, url: str | None, seconds: int, payload: bytes, first: str | None, first_row: str | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own; a revisit has the response's headers without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(ident, row)}",
        f"WARC-Date: {datetime.fromtimestamp(seconds, UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(first, first_row)}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def read_records(stream: pa.NativeFile) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Position, compressed length, headers and block of each record of an archive, one in memory at a time."""
    start, used, pending = 0, 0, b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not pending and not (pending := stream.read(1 << 20)):
                if out or used:
                    raise ValueError("archive ends within a record")
                return
            out.append(unpack.decompress(pending))
            rest = unpack.unused_data if unpack.eof else b""
            used += len(pending) - len(rest)
            pending = rest
        head, _, body = b"".join(out).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield start, used, fields, body[: int(fields["Content-Length"])]
        start, used = start + used, 0


def capture(archive: str, position: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    """Index row of a record, its payload's digest checked."""
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and digest(payload) != said:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} doesn't match its payload")
    size = int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
    when = "".join(c for c in fields["WARC-Date"] if c.isdigit())
    refers_to = _ident(fields["WARC-Refers-To"]) if revisit else None
    target = fields.get("WARC-Target-URI")
    return (url_key(target) if target is not None else "", when, _ident(fields["WARC-Record-ID"]), archive, position, length, size, said, fields["WARC-Type"], refers_to)


def _bytes(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit("").cast("binary"))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", seconds: Column | None = None) -> DataFrame:
    """Write a record for each page; archive, records and bytes of each archive."""
    spark = pages.sparkSession
    prepare(spark)
    folder = scratch_path(spark, "warc")
    when = F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod(F.col(page_id).try_cast("long"), F.lit(1_000_000_000)), F.lit(0)) if seconds is None else seconds
    plain = with_row_id(pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"), _bytes(F.col(f"`{html}`")).alias("payload"), when.cast("long").alias("seconds")), "row_file", "row_index")
    rows = plain.withColumn("row", F.concat_ws("-", F.lower(F.hex("row_file")), "row_index"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    equal = rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("sha1").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row"))).alias("first"), F.count("*").alias("n"))
    # broadcast only if the written table of repeated payloads is small enough for Spark; beyond, a join whose skewed payloads Spark splits
    firsts = materialize(equal.where("n > 1").select("sha1", "first.id", "first.row").toDF("sha1", "first", "first_row"), "firsts")
    rows = rows.join(firsts, "sha1", "left").withColumn("revisit", F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))

    def write(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, number, count, attempt = None, "", 0, 0, TaskContext.get().taskAttemptId()
        done = []
        for batch in batches(batched):
            for ident, row, address, payload, second, first, first_row, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path = f"{root}/part-{TaskContext.get().partitionId():06d}-{attempt}-{number}.warc.gz"
                    out, count = store.open_output_stream(path, compression=None), 0
                out.write(record(ident, row, address, second, payload, first, first_row, revisit))
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    done.append((path, count, out.tell()))
                    out.close()
                    out, number = None, number + 1
        if out is not None:
            done.append((path, count, out.tell()))
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), [pa.string(), pa.int64(), pa.int64()])], ["archive", "records", "bytes"])

    text_ids = rows.select(F.col("id").cast("string"), "row", "url", "payload", "seconds", F.col("first").cast("string"), "first_row", "revisit")
    manifest = text_ids.mapInArrow(write, "archive string, records long, bytes long")
    return materialize(manifest.withColumn("folder", F.lit(folder)), "manifest")


def capture_runs(manifest: DataFrame) -> DataFrame:
    """Captures of all archives of a manifest, written; those of an archive are sorted."""
    prepare(manifest.sparkSession)

    def read(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batched):
            for archive, folder in zip(*(c.to_pylist() for c in batch.columns)):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_stream(archive, compression=None, buffer_size=1 << 20) as stream:
                    run = [capture(archive, *found) for found in read_records(stream)]
                run.sort(key=lambda x: (x[0], x[1], x[2] or "", x[4]))
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, x)) for x in run], schema=_arrow())

    spread = manifest.select("archive", "folder").repartition(max(1, manifest.count()))
    return materialize(spread.mapInArrow(read, _CAPTURE), "captures")


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _CAPTURE.split(", "))])


def capture_histories(runs: DataFrame, merged_together: int = MERGED_TOGETHER) -> DataFrame:
    """Captures of all runs by URL key, timestamp and id: ordered in each partition, and partitions in turn."""
    parts = max(1, -(-runs.count() // merged_together))

    def merge(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches(batched):
                for x in zip(*(c.to_pylist() for c in batch.columns)):
                    yield (x[0], x[1], x[2] or "", *x[3:5]), x

        some = []
        for _, row in merge_runs(rows()):
            some.append(row)
            if len(some) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), _arrow())], _NAMES)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), _arrow())], _NAMES)

    key = ["urlkey", "timestamp", F.coalesce("id", F.lit("")), "archive", "position"]
    return runs.repartitionByRange(parts, *key).mapInArrow(merge, _CAPTURE)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = capture_histories(capture_runs(write_archives(pages)))
    return found.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT hex, string_agg(part, '' ORDER BY i) AS digest FROM (
  SELECT hex, i, substr({_LETTERS}, (v // 32768 + 1)::BIGINT, 1) || substr({_LETTERS}, (v // 1024 % 32 + 1)::BIGINT, 1)
    || substr({_LETTERS}, (v // 32 % 32 + 1)::BIGINT, 1) || substr({_LETTERS}, (v % 32 + 1)::BIGINT, 1) AS part
  FROM (SELECT hex, i, ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT AS v FROM (SELECT DISTINCT hex FROM p), range(8) r(i)))
  GROUP BY hex),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN first END AS refers_to
FROM f JOIN k USING (hex)
"""
