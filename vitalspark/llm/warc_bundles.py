"""WARC archives as seekable Zstandard bundles.

``write_archive`` deals pages out by a hash of their id; each task packs its
records into bundles of about ``BUNDLE_BYTES``.  A bundle is a row of
independent Zstandard frames, each a group of whole WARC records, followed by a
seek table (a skippable frame with the compressed and plain size of every
frame and a footer), as the public seekable format has it.  The index maps
(page id) to bundle, frame, offset in the plain frame and length, so one record
is read by decompressing one frame.

Files are written with pyarrow's file systems below the shared checkpoint
folder, under a name of their own per attempt, first as ``.part`` and then
moved: a retried or speculative task never touches another attempt's file.
The index is written once with Spark; it names the bundles that count.

Defined results: null html is an empty payload; payloads shorter than
``MIN_REVISIT_BYTES`` are always responses; of equal longer payloads every row
with the largest page_id is the response and all others (null ids too) are
revisits; with null ids only, all are responses.  Null urls are written as
empty.  Repeated rows give repeated records.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, shared_path, utf8

MIN_REVISIT_BYTES = 1000
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 32 << 20
ZSTD_LEVEL = 3
# Seekable format (fixed values): skippable frame magic, footer magic, entry and footer layout.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<II"), struct.Struct("<IBI")

INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()),
                   ("frame_offset", pa.int64()), ("record_bytes", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])
INDEX_DDL = "page_id bigint, bundle string, frame int, frame_offset bigint, record_bytes bigint"
RECORDS_DDL = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages with payload, digest, record_type and refers_to.

    Only (id, digest) pairs are grouped and joined; groups are pre-aggregated
    and the join back is salted, so a payload that a third of all pages share
    is no hot key.  The html itself moves once, keyed by its own row."""
    rows = pages.select(F.col("page_id").cast("bigint"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        utf8("html").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("rid", F.xxhash64("page_id", "digest"))
    long = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest", "rid")
    # Partial aggregation: one row per digest and task is shuffled.
    groups = (long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
              .where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n"))
    revisits = (salted_join(long.distinct(), groups, ["digest"], F.col("rid"))
                .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
                .select("rid", "digest", "refers_to"))
    return (rows.join(revisits, ["rid", "digest"], "left")
            .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
            .select("page_id", "url", "payload", "digest", "record_type", "refers_to"))


def urn(page_id) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def warc_record(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    url = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{urn(page_id)}>", f"WARC-Target-URI: {url}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    body = payload
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{urn(refers_to)}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict, bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not hold")
    return fields, rest[:n]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(ENTRY.pack(*s) for s in sizes) + FOOTER.pack(len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int]]:
    """(start, compressed size) of every frame, from the end of the file."""
    f.seek(size - FOOTER.size)
    n, flags, magic = FOOTER.unpack(f.read(FOOTER.size))
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table without checksums at the end of the bundle")
    f.seek(size - FOOTER.size - n * ENTRY.size)
    at, out = 0, []
    for packed, _ in ENTRY.iter_unpack(f.read(n * ENTRY.size)):
        out.append((at, packed))
        at += packed
    return out


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        out, name, sizes, at, frame, index = None, "", [], 0, [], []

        def end_frame():
            nonlocal at, frame
            if frame:
                plain = b"".join(frame)
                packed = packer.compress(plain)
                out.write(packed)
                sizes.append((len(packed), len(plain)))
                at, frame = at + len(packed), []

        def end_bundle():
            nonlocal out, sizes, at, index
            end_frame()
            out.write(seek_table(sizes))
            out.close()
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), INDEX)], schema=INDEX)
            out, sizes, at, index = None, [], 0, []
            return rows

        held = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (
                    "page_id", "url", "payload", "digest", "record_type", "refers_to"))):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    out, held = store.open_output_stream(f"{base}/{name}.part", compression=None), 0
                record = warc_record(*row)
                if frame and held + len(record) > frame_bytes:
                    end_frame()
                    held = 0
                    if at >= bundle_bytes:
                        yield end_bundle()
                        name = f"pages-{uuid.uuid4().hex}.warc.zst"
                        out = store.open_output_stream(f"{base}/{name}.part", compression=None)
                index.append((row[0], name, len(sizes), held, len(record)))
                frame.append(record)
                held += len(record)
        if out is not None:
            yield end_bundle()
    return run


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES,
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                  level: int = ZSTD_LEVEL) -> tuple[str, DataFrame]:
    """Write bundles and their index below ``folder``; returns (folder, index)."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    store, base = open_store(folder)
    store.create_dir(f"{base}/bundles", recursive=True)
    typed = record_types(pages, min_bytes)
    index = typed.mapInArrow(_writer(f"{folder}/bundles", frame_bytes, bundle_bytes, level), INDEX_DDL)
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return folder, spark.read.parquet(f"{folder}/index")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        unpacker = zstandard.ZstdDecompressor()
        f, name, frames, at, plain = None, None, [], -1, b""
        number = lambda x: None if (v := x[1:-1].rpartition(":")[2]) == "null" else int(v)
        for b in batches:
            done = []
            for bundle, frame, offset, n in zip(*(b.column(c).to_pylist() for c in (
                    "bundle", "frame", "frame_offset", "record_bytes"))):
                if bundle != name:
                    if f:
                        f.close()
                    f, name, at = store.open_input_file(f"{base}/{bundle}"), bundle, -1
                    frames = read_seek_table(f, f.size())
                if frame != at:
                    f.seek(frames[frame][0])
                    plain, at = unpacker.decompress(f.read(frames[frame][1])), frame
                head, payload = parse_record(plain[offset:offset + n])
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(head["X-Payload-Length"])
                if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                done.append((number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"],
                             number(head["WARC-Refers-To"]) if revisit else None))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), RECORDS)],
                                                 schema=RECORDS)
        if f:
            f.close()
    return run


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the index, read back frame by frame.  Any subset of the
    index (one page id, say) reads only the frames that hold it."""
    return (index.select("bundle", "frame", "frame_offset", "record_bytes")
            .repartition("bundle", F.floor(F.col("frame") / 16)).sortWithinPartitions("bundle", "frame", "frame_offset")
            .mapInArrow(_reader(f"{folder}/bundles"), RECORDS_DDL))
