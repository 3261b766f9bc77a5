"""WARC archives: an index of byte ranges first, then coalesced reads of the selected records."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playerday.llm.common import scratch, table

#: Smaller payloads are always stored whole.
LEAST_REVISIT = 1000
ROLL = 256 << 20
#: Bytes of archive that one task reads at least and at most, by which its number of tasks is set.
LEAST_STRETCH, LARGEST_STRETCH = 1 << 20, 64 << 20
INDEX = "archive string, offset bigint, length bigint, page_id bigint, url string, payload_digest string"


def _record(page_id, url, kind: str, digest: str, size: int, target, payload: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    safe = "".join(c if c > " " else "%20" for c in url or "")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {safe}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{target}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + squeeze.flush()


def parse(raw: bytes) -> dict:
    """The record in one gzip member: its header fields, payload, and the size that its HTTP head states."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    return {"fields": fields, "payload": payload, "stated": stated}


def decide(pages: DataFrame) -> DataFrame:
    """pages with payload, size, digest and the page_id that the record refers to (null: a response).

    Of equal payloads of LEAST_REVISIT bytes or more the largest page_id is the
    response. Groups are counted before the shuffle; the join spreads the rows
    of a large group over salted copies of its one row. The list of such
    groups, at least a thousandth of all rows each, has at most 1,000 rows and
    is broadcast.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.octet_length(html).cast("bigint").alias("size"), F.sha1(html.cast("binary")).alias("digest"))
    groups = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("copies")).where("copies > 1")
    total = pages.count()
    salts = F.least(F.lit(256), F.ceil(F.col("copies") * 256 / max(total, 1))).cast("int")
    big = groups.where(F.col("copies") * 1000 >= total).select("digest", salts.alias("salts"))
    rows = rows.join(F.broadcast(big), "digest", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1)).cast("bigint")))
    spread = F.when(F.col("copies") * 1000 >= total, salts).otherwise(1)
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), spread - 1).cast("array<bigint>"))).select("digest", "salt", "target")
    rows = rows.join(groups, ["digest", "salt"], "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target")) & (F.col("size") >= LEAST_REVISIT)
    return rows.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "digest", F.when(revisit, F.col("target")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str | None = None) -> tuple[str, DataFrame]:
    """Write a record per page under path; gives the path and the index, itself written as a table there.

    Each task writes archives of its own, with names that no other attempt
    takes; an index row appears only with the task that succeeded, so a lost
    executor or a second attempt leaves an archive that nobody reads. Nothing
    but bytes up to ROLL is appended to one archive. path may be on any file
    system that pyarrow knows. Null html is an empty payload, null url an empty
    URL; repeated and null page_ids and repeated rows are records like any
    others. A very long page is one record, held whole by its task. Columns of
    pages beside page_id, url and html are left out, whatever their names; an
    empty table gives an empty index.
    """
    path = path or scratch(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, size, digest, target in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(f"{root}/archives", recursive=True)
                        out = store.open_output_stream(f"{root}/archives/{name}", compression=None)
                    raw = _record(page_id, url, "response" if target is None else "revisit", digest, size, target, b"" if target is not None else html.encode("utf-8", "replace"))
                    out.write(raw)
                    index.append((name, at, len(raw), page_id, url, digest))
                    at += len(raw)
                yield _batch(index, INDEX)
        finally:
            if out is not None:
                out.close()

    decide(pages).mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return path, pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, whole boolean, payload binary"
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of the schema's own types, so that a null beside an id never makes it a float."""
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def read_records(path: str, selected: DataFrame, payload: bool = True, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records of the selected index rows, read from the archives under path.

    Rows are dealt to tasks by stretches of their archives, so that each task
    reads about as many archive bytes, however small the index is; there they
    are sorted by archive and offset, and ranges that lie within `gap` bytes
    of each other are read at once, up to `most` bytes (a longer record alone).
    `whole` says whether a response's payload has the size and digest that its
    record states; a revisit has no payload of its own, only those two.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            names, offsets, lengths = (c.to_pylist() for c in batch.columns)
            at, n = 0, len(names)
            while at < n:
                end = at + 1
                while end < n and names[end] == names[at] and 0 <= offsets[end] - offsets[end - 1] - lengths[end - 1] <= gap and offsets[end] + lengths[end] - offsets[at] <= most:
                    end += 1
                with store.open_input_file(f"{root}/archives/{names[at]}") as f:
                    block = f.read_at(offsets[end - 1] + lengths[end - 1] - offsets[at], offsets[at])
                rows = []
                for k in range(at, end):
                    start = offsets[k] - offsets[at]
                    rows.append(_row(parse(block[start : start + lengths[k]]), payload))
                yield _batch(rows, RECORD)
                at = end

    total = selected.agg(F.sum("length")).first()[0] or 0
    stretch = min(LARGEST_STRETCH, max(LEAST_STRETCH, total // (4 * selected.sparkSession.sparkContext.defaultParallelism)))
    parts = selected.withColumn("stretch", F.floor(F.col("offset") / stretch)).repartition(total // stretch + 1, "archive", "stretch")
    return parts.sortWithinPartitions("archive", "offset").select("archive", "offset", "length").mapInArrow(read, RECORD)


def _row(record: dict, payload: bool) -> tuple:
    fields, body = record["fields"], record["payload"]
    urn = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    whole = kind == "revisit" or (len(body) == record["stated"] and hashlib.sha1(body).hexdigest() == digest)
    return urn("WARC-Record-ID"), fields["WARC-Target-URI"], kind, urn("WARC-Refers-To"), digest, record["stated"], whole, body if payload else None


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back by the index."""
    path, index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(path, index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")


#: The SQL side counts payloads and digests from the table; the query reads them back from the archives.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS target FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN target IS NOT NULL AND target IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN target IS DISTINCT FROM page_id THEN target END AS refers_to, true AS whole
FROM m
"""
