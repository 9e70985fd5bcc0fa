"""WARC archives as a chunked record table.

A payload is handled as chunk rows (record, chunk number) of bounded size, each of which carries
the SHA-1 of the payload up to its end, so that neither writer nor reader builds a record in one
piece.  In an archive each chunk is a WARC record: the first a ``response`` (or a ``revisit``,
which has no payload), the following ones ``continuation`` records with their segment number.
Archives are text part files (gzip) whose line separator is the end mark of a WARC record; they
are read back as binary files, decompressed and parsed as a stream.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketsig.llm.common import stored
from marketsig.session import scratch_path

END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENTS = ("record string, page_id long, url string, record_type string, refers_to long, segment int, last boolean, "
            "payload_bytes long, payload_digest string, digest_so_far string, intact boolean, data binary")


@dataclass(frozen=True)
class Settings:
    """Characters of a chunk and chunks of an archive file, at most: a file is read as one value, so together
    they bound it to 32 M characters before compression; least bytes of a payload that a later record may revisit."""

    chunk_chars: int = 1 << 15
    file_rows: int = 1 << 10
    min_bytes: int = 0


def base32(digest: bytes) -> str:
    return b32encode(digest).decode()


def chunks(html: str, size: int) -> Iterator[tuple[int, bytes, int, str, bool]]:
    """(number, bytes, payload bytes so far, digest so far, whether it is the last) of each chunk."""
    sha, total = hashlib.sha1(), 0
    for k, at in enumerate(range(0, max(1, len(html)), size)):
        raw = html[at: at + size].encode()
        sha.update(raw)
        total += len(raw)
        yield k, raw, total, base32(sha.copy().digest()), at + size >= len(html)


def payload_digest(html: str, size: int) -> tuple[int, str]:
    """(bytes, digest) of a payload, one chunk held at a time."""
    for _, _, total, digest, _ in chunks(html, size):
        pass
    return total, digest


def digests(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, payload_bytes, payload_digest) of every page row; a null html is an empty payload."""
    s = settings

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for html in batch.column("html"):
                total, digest = payload_digest(html.as_py() or "", s.chunk_chars)
                sizes.append(total)
                found.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.string())],
                                             names=["page_id", "payload_bytes", "payload_digest"])

    return (pages.select(F.col("page_id").cast("long"), "html")
            .mapInArrow(task, "page_id long, payload_bytes long, payload_digest string"))


def record_types(whole: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``digests`` plus ``refers_to``: the largest page_id with an equal payload of at least
    ``min_bytes``, null for that record itself, for smaller payloads and without a page_id."""
    groups = (whole.filter((F.col("payload_bytes") >= settings.min_bytes) & F.col("page_id").isNotNull())
              .groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
              .filter("n > 1").drop("n"))
    # one digest may be a third of all rows: with both sides read from tables, adaptive execution
    # can split its partition
    joined = whole.join(stored(groups, "payload-groups"), "payload_digest", "left")
    return joined.select("page_id", "payload_bytes", "payload_digest",
                         F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"))


def _record(kind: str, name: str, segment: int, page: int | None, url: str | None, block: bytes, **more) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{name}:{segment}>", "WARC-Date": DATE,
            "Content-Type": "text/html", "X-Page-ID": page,
            "WARC-Target-URI": url and url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if url is not None else None,
            "WARC-Block-Digest": f"sha1:{base32(hashlib.sha1(block).digest())}", **more, "Content-Length": len(block)}
    lines = "\r\n".join(f"{k}: {v}" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n\r\n{block.decode()}"


def write(pages: DataFrame, path: str, settings: Settings = Settings()) -> None:
    """Write archives of ``pages`` (page_id, url, html) under ``path``.

    Nulls: html is an empty payload, url is left out, a row without page_id is always a response.
    Repeated rows are records of their own.  Other columns are ignored.  No pages: no records.
    """
    s = settings
    whole = stored(digests(pages, s), "digests")
    types = record_types(whole, s).distinct()  # repeated rows have equal ones

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [payload_digest(h.as_py() or "", s.chunk_chars)[1] for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "payload_digest"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row in range(batch.num_rows):
                page, url, html, refers, full, size = (batch.column(c)[row].as_py() for c in
                                                       ("page_id", "url", "html", "refers_to", "payload_digest", "payload_bytes"))
                name, n = f"{page}:{task}-{n}", n + 1
                if refers is not None:
                    out = [_record("revisit", name, 1, page, url, b"", **{
                        "WARC-Payload-Digest": f"sha1:{full}", "WARC-Profile": PROFILE,
                        "WARC-Refers-To": f"<urn:page:{refers}>", "X-Payload-Length": size})]
                    yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
                    continue
                for k, block, total, digest, last in chunks(html or "", s.chunk_chars):
                    split = k or not last
                    out = [_record("continuation" if k else "response", name, k + 1, page, None if k else url, block, **{
                        "WARC-Payload-Digest": None if k else f"sha1:{full}", "X-Digest-So-Far": f"sha1:{digest}",
                        "WARC-Segment-Number": k + 1 if split else None,
                        "WARC-Segment-Origin-ID": f"<urn:page:{name}:1>" if k else None,
                        "WARC-Segment-Total-Length": total if k and last else None})]
                    yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    table = (rows.mapInArrow(with_digest, "page_id long, url string, html string, payload_digest string")
             .withColumnsRenamed({"page_id": "id", "payload_digest": "digest"})
             .join(types, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest"))))
    (table.select("page_id", "url", "html", "refers_to", "payload_digest", "payload_bytes")
     .mapInArrow(records, "value string").write
     .option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", s.file_rows).text(path))


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, from the pieces of an archive in order."""
    have = b""
    stream = iter(stream)
    while True:
        while (at := have.find(b"\r\n\r\n")) < 0:
            part = next(stream, None)
            if part is None:
                return
            have += part
        lines = have[:at].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        need = at + 4 + int(head["Content-Length"]) + 4
        while len(have) < need:
            part = next(stream, None)
            if part is None:
                raise ValueError(f"archive ends inside {head.get('WARC-Record-ID')}")
            have += part
        yield head, have[at + 4: need - 4]
        have = have[need:]


def _inflate(content: bytes) -> Iterator[bytes]:
    decoder = zlib.decompressobj(wbits=47)
    view = memoryview(content)
    for at in range(0, len(view), 1 << 16):
        if part := decoder.decompress(view[at: at + (1 << 16)]):
            yield part


def read(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives under ``path``: one row per WARC record, continuations included.

    ``record`` names the page's record, ``segment`` counts its chunks from 1, ``intact`` says that the
    block has its digest, ``digest_so_far`` is the payload's digest up to this chunk.  ``data``
    is null with ``with_data`` false.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(),
                 pa.string(), pa.string(), pa.bool_(), pa.binary())
        names = [c.split()[0] for c in SEGMENTS.split(", ")]

        def rows(content: bytes) -> Iterator[tuple]:
            for head, block in parse(_inflate(content)):
                name, segment = head["WARC-Record-ID"][len("<urn:page:"):-1].rsplit(":", 1)
                page, refers, url = head.get("X-Page-ID"), head.get("WARC-Refers-To"), head.get("WARC-Target-URI")
                yield (name, page and int(page), url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else None,
                       head["WARC-Type"], refers and int(refers[len("<urn:page:"):-1]), int(segment),
                       head["WARC-Type"] == "revisit" or "WARC-Segment-Number" not in head or "WARC-Segment-Total-Length" in head,
                       int(head.get("X-Payload-Length", len(block))),
                       head.get("WARC-Payload-Digest", "sha1:")[5:] or None, head.get("X-Digest-So-Far", "sha1:")[5:] or None,
                       head["WARC-Block-Digest"] == f"sha1:{base32(hashlib.sha1(block).digest())}", block if with_data else None)

        for batch in batches:
            for content in batch.column("content"):
                held: list[tuple] = []
                size = 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(task, SEGMENTS)


def records(segments: DataFrame) -> DataFrame:
    """One row per page record, from ``read``: sizes summed over its chunks, the digest of its last
    chunk, which must be the one its first chunk promised, and whether every block was intact."""
    first = F.col("segment") == 1
    ends = F.max(F.when(F.col("last"), F.coalesce("digest_so_far", "payload_digest")))
    return (segments.groupBy("record", "page_id")
            .agg(F.sum("payload_bytes").alias("payload_bytes"), ends.alias("payload_digest"),
                 F.max(F.when(first, F.col("record_type"))).alias("record_type"), F.max("refers_to").alias("refers_to"),
                 F.max("url").alias("url"), F.count("*").alias("segments"),
                 (F.every("intact") & (ends == F.max("payload_digest"))).alias("intact")))


def op6(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Write the archives to the shared folder, read them back: one row per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, settings)
    return records(read(spark, path, with_data=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "segments", "intact")
