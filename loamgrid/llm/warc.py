"""WARC archives with an index first: per-record gzip members, byte-range reads.

Each task writes the records of its rows to archive files of its own (a new name for every attempt)
and returns an index row per record: file, offset, length, URL and digest. The index is written as a
table; archives of attempts that failed are in no index. Reading takes index rows, sorts them by file
and offset, joins neighbouring ranges into reads of bounded size and parses the selected records.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, the one with the largest page_id is
a response and the others are revisits that name it. Defined results: null html is an empty payload;
a null or empty url becomes ``about:blank``; a null page_id is written and returned as null and refers to the
largest id of its group (it is the response where the group has no id); rows that repeat an id with
one payload are all responses; an empty table gives an empty result; extra columns are ignored.
Record ids are derived from page_id, url and digest, so a task that runs again writes the same
records, and rows that repeat all three are one record written several times.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.plans.session import Scratch

MIN_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES, GAP_BYTES = 1 << 20, 64 << 10
TASK_BYTES = 64 << 20  # read by one task
DATE = "1970-01-01T00:00:00Z"  # the pages have no time of capture
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(parts))}>"


def _target(url: str | None) -> str:
    return quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds one record."""
    fields = [*fields, ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def info_bytes(name: str) -> bytes:
    """The record that begins an archive and names it."""
    block = b"software: loamgrid\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("info", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, refers_url: str | None = None) -> bytes:
    """One gzip member that holds a response, or a revisit of the response of page ``refers_to``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id("revisit" if revisit else "response", page_id, _target(url), digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _target(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _record_id("response", refers_to, _target(refers_url), digest)),
            ("WARC-Refers-To-Target-URI", _target(refers_url)),
            ("WARC-Refers-To-Date", DATE),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    return _member(fields, head if revisit else head + payload)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and the payload of one member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = lambda b: dict(x.split(": ", 1) for x in b.decode().split("\r\n")[1:])
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(root)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(name, compression=None)  # members are compressed one by one
                    info = info_bytes(name.removeprefix(base + "/"))
                    out.write(info)
                    at = len(info)
                revisit = x["record_type"] == "revisit"
                member = record_bytes(x["page_id"], x["url"], x["html"], x["digest"], x["refers_to"], revisit, x["refers_url"])
                out.write(member)
                rows.append({k: x[k] for k in ("page_id", "url", "digest", "record_type", "refers_to")} | {"file": name.removeprefix(base + "/"), "offset": at, "length": len(member)})
                at += len(member)
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_INDEX))
        if out is not None:
            out.close()

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def write_archives(pages: DataFrame, s: Scratch, root: str) -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)``; returns the index as a table."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("_n", F.octet_length("html"))
    keys = s.keep(rows.select("page_id", "url", "digest", "_n").filter(F.col("_n") >= MIN_REVISIT), "digests")
    groups = keys.groupBy("digest", "_n").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("c"))
    groups = groups.select("digest", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url"), "c").filter("c > 1 and refers_to is not null").drop("c")
    roles = keys.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to", "refers_url").distinct()
    planned = rows.join(roles.hint("merge"), rows["page_id"].eqNullSafe(roles["_p"]) & (rows["digest"] == roles["_d"]), "left")
    planned = planned.withColumn("record_type", F.when(F.col("_d").isNull(), "response").otherwise("revisit"))
    return s.keep(planned.select("page_id", "url", "html", "digest", "refers_to", "refers_url", "record_type").mapInArrow(_write(root), _INDEX), "index")


def read_ranges(index: DataFrame) -> DataFrame:
    """Sorted, coalesced byte ranges of index rows: file, start, stop, records.

    A file is no larger than about ``ARCHIVE_BYTES``, so a window over one file is bounded.
    """
    by = Window.partitionBy("file").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by) > GAP_BYTES
    cut = gap | (F.floor(F.col("offset") / RANGE_BYTES) != F.lag(F.floor(F.col("offset") / RANGE_BYTES)).over(by))
    runs = index.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("range", F.sum("cut").over(by))
    return runs.groupBy("file", "range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


def read_records(index: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """Records of the index rows, read from the archives; a payload that differs from its digest raises."""
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(root)
        for batch in batches:
            for x in batch.to_pylist():
                with store.open_input_file(f"{base}/{x['file']}") as f:
                    data = f.read_at(x["stop"] - x["start"], x["start"])
                rows = []
                for r in x["records"]:
                    at = r["offset"] - x["start"]
                    warc, http, payload = parse_record(data[at : at + r["length"]])
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if warc["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload and digest differ in {x['file']} at {r['offset']}")
                    number = lambda k: int(warc[k]) if k in warc else None  # noqa: E731, B023
                    rows.append(
                        {"page_id": number("X-Page-Id"), "url": warc["WARC-Target-URI"], "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": warc["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if with_payload else None}
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ranges = read_ranges(index)
    # Dealt by the bytes to read: to as many tasks as these fill, and to all cores where they are few.
    size = ranges.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return ranges.repartition(tasks).mapInArrow(run, ddl)


def op2_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark, "warc")
    root = s.path("archives")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), s, root)
    return s.finish(read_records(index, root, with_payload=False).drop("payload", "url"))


ORACLE = {
    "op2_indexed_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)"""
}
