"""WARC archives with an index first: records are found by offset and read back in coalesced ranges.

Every task appends its records, each compressed by itself, to one archive and returns a row
of the index per record: archive, offset, length, url and digest. The index is what counts:
an archive that a lost or repeated attempt leaves behind is in no index row. To read,
the rows wanted are dealt out by stretches of an archive, sorted by offset, and ranges that
lie close together are fetched in one read.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import row_batches, tasks_for, written
from vecspark.llm.register import query
from vecspark.session import run_folder

RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of their own
TASK_BYTES = 64 << 20  # payload a writing task should hold; stretch of an archive a reading task takes
GAP = 64 << 10  # ranges closer than this are read together
READ = 8 << 20  # one read fetches about so much at most, or one record
INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Where the shared folder lies: file, hdfs, s3 and gs addresses, or a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def target_uri(url: str) -> str:
    """The url with what would break a header line (blanks, line ends, control characters) percent-encoded."""
    return quote(url, safe="".join(chr(i) for i in range(33, 127)))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One compressed record. A revisit has an empty block and names the response by page."""
    name = "null" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}:{kind}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {target_uri(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == REVISIT:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{RESPONSE}>"]
        block = b""
    else:
        block = payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record begins here: {first[:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"a record of {len(rest)} bytes says it has {n}")
    return headers, rest[:n]


def first_of_equal(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, response_id): response_id is the largest id with an equal payload, null for a page that has it or is alone.

    Ids are counted per digest in each task first. Pages then meet the digests that more than
    one row has; Spark splits a digest that very many rows have (adaptive skew join).
    """
    body = F.coalesce(F.col(html), F.lit(""))
    digest = F.concat(F.sha1(body.cast("binary")), F.lit("-"), F.octet_length(body).cast("string"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), digest.alias("digest"))
    ids = pages.select(F.col(page_id).cast("long").alias("page_id"), digest.alias("digest"))
    many = ids.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND response_id IS NOT NULL")
    joined = rows.join(many.drop("n"), "digest", "left")
    return joined.withColumn("response_id", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per page into archives under the folder and return the index, a row per record.

    Of pages with equal payloads, empty ones too, that of the largest id is the response; all
    others become revisits of it. Rows that share this largest id are each a response, as are
    pages of an equal payload that all lack an id; a page without id revisits one that has
    one. NULL html is an empty payload; a NULL url leaves out the header.
    """
    spark = pages.sparkSession
    rows = first_of_equal(pages, page_id, url, html).select("page_id", "url", "html", "response_id")
    archives = f"{folder}/archives"
    fs, path = filesystem(archives)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(archives)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in row_batches(batches, 2):
                index = []
                for p, u, h, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                    payload, kind = h.encode(), RESPONSE if r is None else REVISIT
                    digest = b32_sha1(payload)
                    data = record(p, u, payload, digest, kind, r)
                    out.write(data)
                    index.append((p, name, at, len(data), u, digest, len(payload), kind, r))
                    at += len(data)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    # Index rows are committed by Spark as tasks end, so they only name archives that are complete.
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Reads (start, end, records) that cover sorted (offset, length) pairs, close ones together."""
    held: list[tuple[int, int]] = []
    for at, n in places:
        if held and (at - sum(held[-1]) > GAP or at + n - held[0][0] > READ):
            yield held[0][0], max(map(sum, held)), held
            held = []
        held.append((at, n))
    if held:
        yield held[0][0], max(map(sum, held)), held


def read_archives(selected: DataFrame, folder: str) -> DataFrame:
    """Fetch the records of the index rows: page_id, url, payload digest and length, type, refers_to, block.

    A response's digest and length are worked out again from the bytes read and must agree
    with its headers; a revisit has both, of the full payload, in its headers.
    """
    archives = f"{folder}/archives"
    n = tasks_for(selected.sparkSession, selected.agg(F.sum("length")).first()[0] or 0, TASK_BYTES)
    places = selected.select("archive", F.floor(F.col("offset") / TASK_BYTES).alias("stretch"), "offset", "length")
    places = places.repartition(n, "archive", "stretch").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(archives)
        for b in batches:
            by_archive: dict[str, list[tuple[int, int]]] = {}
            for a, at, length in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                by_archive.setdefault(a, []).append((at, length))
            for a, wanted in by_archive.items():
                with fs.open_input_file(f"{path}/{a}") as f:
                    for start, end, parts in ranges(wanted):
                        data = f.read_at(end - start, start)
                        out = []
                        for at, length in parts:
                            h, block = parse(data[at - start : at - start + length])
                            kind, digest, size = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                            if kind == RESPONSE and (size != len(block) or digest != b32_sha1(block)):
                                raise ValueError(f"{a} at {at}: the payload is not that of its digest")
                            name, to = h["warc-record-id"].split(":")[2], None
                            page = None if name == "null" else int(name)
                            if kind == REVISIT:
                                to = int(h["warc-refers-to"].split(":")[2])
                            out.append((page, h.get("warc-target-uri"), size, digest, kind, to, block))
                        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "block"]
                        )

    return places.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary")


@query("op6_warc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
