"""WARC archives, index first.

Writing: each task streams its rows into gzip-per-record WARC 1.1 files in a folder that all machines
see, and emits an index row (file, offset, length, url, digest) per record. The index is written as
Parquet, whose commit takes the rows of one attempt of each task; files of lost attempts are never named
in it. Reading: the selected index rows are dealt by file and stretch of offsets, sorted, and near
neighbours are read as one byte range of at most ``MAX_RANGE`` bytes.

Records whose payload has at least ``min_bytes`` bytes and equals an earlier one are revisits: the one
with the smallest page id is the response. Null payloads are empty. Rows with the same smallest id and
payload are all responses; a row without an id revisits the smallest id of its payload, and where no row
of a payload has an id all are responses. Only the id, url and payload columns are read, so further
columns can't clash.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.llm.common import heavy_keys, materialise, salted_join, shared_dir

MIN_BYTES = 100
ROLL_BYTES = 256 << 20
MAX_RANGE = 8 << 20
MAX_GAP = 256 << 10

INDEX = "url string, digest string, record_type string, file string, offset long, length long"
STRETCH = 2 << 20  # bytes of archives that one key of the reading exchange stands for
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Add payload_bytes, payload_digest and refers_to (null for responses) to (page_id, url, html).

    Copies are found by digest: partial minima per digest, then a join in which digests with over
    1/500 of the rows are salted. Only digests seen more than once take part in the join.
    """
    t = F.coalesce(F.col("html"), F.lit(""))
    own = pages.withColumn("payload_digest", F.sha2(t, 256)).withColumn("payload_bytes", F.octet_length(t).cast("long"))
    first = materialise(
        own.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"),
        "copies",
    )
    many = heavy_keys(first, "payload_digest", "copies")
    out = salted_join(own, first.select("payload_digest", "first_id"), "payload_digest", many)
    other = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(other, F.col("first_id")).alias("refers_to"))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _name(page_id: int | str | None) -> str:
    return "<urn:quire:none>" if page_id is None else f"<urn:quire:page:{quote(str(page_id), safe='-')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record; control and non-ASCII characters of the url are escaped."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


_ID = re.compile(r"<urn:quire:(?:page:([^>]*)|none)>")


def parse(raw: bytes, id_of: type = int) -> dict:
    """The record in uncompressed bytes: its type, ids, payload length and digest, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda v: None if v is None else id_of(unquote(v))
    refers = _ID.fullmatch(fields["WARC-Refers-To"])[1] if "WARC-Refers-To" in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return {"page_id": number(_ID.fullmatch(fields["WARC-Record-ID"])[1]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(refers), "payload": None if fields["WARC-Type"] == "revisit" else payload}


def _whole(c: str, rows: DataFrame):
    """An id as it is if text, else as a long."""
    return F.col(c) if isinstance(rows.schema[c].dataType, StringType) else F.col(c).cast("long").alias(c)


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``roles`` as archives under ``folder``; return the committed index."""

    slim = rows.select(_whole("page_id", rows), "url", F.col("html").cast("binary").alias("html"), "payload_bytes", "payload_digest", _whole("refers_to", rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                ids, urls, texts, _, digests, refers = (batch.column(i) for i in range(6))
                for page_id, url, html, digest, other in zip(ids, urls, texts, digests, refers):
                    if out is None or at >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    page_id, url, digest, other = page_id.as_py(), url.as_py(), digest.as_py(), other.as_py()
                    data = gzip.compress(record(page_id, url, html.as_py() or b"", digest, other), 5, mtime=0)
                    out.write(data)
                    found.append((page_id, url, digest, "response" if other is None else "revisit", name, at, len(data)))
                    at += len(data)
                cols = list(zip(*found)) or [()] * 7
                kinds = [batch.column(0).type, *[pa.string()] * 4, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "url", "digest", "record_type", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return materialise(slim.mapInArrow(run, f"page_id {slim.schema['page_id'].dataType.simpleString()}, {INDEX}"), "index")


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Parse the records that ``index`` names, each byte range read once."""
    named = isinstance(index.schema["page_id"].dataType, StringType)
    id_of, kind, word = (str, pa.string(), "string") if named else (int, pa.int64(), "long")
    kinds = [("page_id", kind), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", kind)]
    if payloads:
        kinds.append(("payload", pa.binary()))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        file, run = None, []
        for batch in batches:
            for f, a, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                end = run[-1][0] + run[-1][1] if run else 0
                if f != file or a - end > MAX_GAP or a + n - run[0][0] > MAX_RANGE:
                    if run:
                        yield file, run
                    file, run = f, []
                run.append((a, n))
        if run:
            yield file, run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        opened = (None, None)
        for file, parts in ranges(batches):
            if opened[0] != file:
                if opened[1] is not None:
                    opened[1].close()
                opened = (file, store.open_input_file(f"{root}/{file}"))
            first, last = parts[0][0], parts[-1][0] + parts[-1][1]
            data = opened[1].read_at(last - first, first)
            rows = [parse(gzip.decompress(data[a - first : a - first + n]), id_of) for a, n in parts]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], [k for k, _ in kinds])
        if opened[1] is not None:
            opened[1].close()

    schema = f"page_id {word}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {word}" + ", payload binary" * payloads
    slim = index.select("file", "offset", "length")
    # partitions by the bytes that will be read, not by those of the index: an explicit number isn't merged
    stretches = -(-(slim.agg(F.sum("length")).first()[0] or 0) // STRETCH)
    n = int(min(20_000, max(1, stretches)))
    dealt = slim.repartition(n, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read every record back through the index."""
    folder = folder or shared_dir(spark, "warc")
    index = write(roles(pages.select("page_id", "url", "html")), folder)
    return read_records(index, folder)
