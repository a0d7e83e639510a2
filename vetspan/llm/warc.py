"""WARC records in seekable Zstandard bundles: independent frames, a seek table at the end, and an index of records."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, skewed_join, small_batches, written

#: Raw bytes after which a frame or a bundle is closed.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
#: Payloads under this size are always written whole.
LEAST_REVISIT = 100
BROADCAST_KEYS = 200_000

#: Fixed values of the seekable Zstandard format: the skippable frame's mark and the footer's mark.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

INDEX = "record_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD = "record_id long, url string, record_type string, refers_to long, header_digest string, payload_bytes long, payload binary"


def _urn(record_id: int | None) -> str:
    return f"<urn:vetspan:page:{'none' if record_id is None else record_id}>"


def _number(urn: str | None) -> int | None:
    found = re.search(r":(-?\d+)>$", urn or "")
    return int(found[1]) if found else None


def record_bytes(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    block = HTTP if revisit else HTTP + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(record_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at `at`, and where the next one starts."""
    head_end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:head_end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    start = head_end + 4
    end = start + int(fields["Content-Length"])
    block = data[start:end]
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has another length than it says")
    kind = fields["WARC-Type"]
    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
    return {"record_id": _number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": _number(fields.get("WARC-Refers-To")), "header_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": int(fields["WARC-Payload-Length"]), "payload": payload}, end + 4


class BundleWriter:
    """One bundle; frames are closed after FRAME_BYTES and end with the seek table."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.place = pafs.FileSystem.from_uri(path)
        self.out = self.fs.open_output_stream(self.place, compression=None)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.held, self.held_bytes, self.raw, self.start = [], 0, 0, 0
        self.pending: list[tuple] = []
        self.done: list[tuple] = []

    def add(self, record_id: int | None, data: bytes) -> None:
        self.pending.append((record_id, self.held_bytes, len(data)))
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if not self.held:
            return
        packed = self.packer.compress(b"".join(self.held))
        self.out.write(packed)
        self.done += [(i, self.path, len(self.frames), self.start, len(packed), o, n) for i, o, n in self.pending]
        self.frames.append((len(packed), self.held_bytes))
        self.raw += self.held_bytes
        self.start += len(packed)
        self.held, self.held_bytes, self.pending = [], 0, []

    def close(self) -> list[tuple]:
        """Rows of INDEX for the bundle's records."""
        self.close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.done


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(start, packed bytes, raw bytes) of each frame, from the end of a bundle."""
    size = file.size()
    file.seek(size - 9)
    count, _, mark = struct.unpack("<IBI", file.read(9))
    if mark != SEEKABLE:
        raise ValueError("the bundle has no seek table")
    file.seek(size - 9 - 8 * count)
    out, at = [], 0
    for packed, raw in struct.iter_unpack("<II", file.read(8 * count)):
        out.append((at, packed, raw))
        at += packed
    return out


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """vs_id, vs_url, vs_html, vs_digest, vs_first: for a row that repeats a payload of at least LEAST_REVISIT bytes, the smallest id that has it.

    Ids and digests alone find the repeats. Bodies are joined with those by digest and id, so a page that
    was copied a million times isn't one task's; rows that repeat both are not revisits of themselves.
    """
    plain = pages.select(F.col(id_col).alias("vs_id"), F.col(url_col).alias("vs_url"), F.coalesce(F.col(html_col), F.lit("")).alias("vs_html"))
    keyed = plain.withColumn("vs_digest", F.sha2("vs_html", 256))
    large = written(keyed.filter(F.octet_length("vs_html") >= LEAST_REVISIT).select("vs_id", "vs_digest"), "warc-digests")
    firsts = written(large.groupBy("vs_digest").agg(F.min("vs_id").alias("vs_first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-firsts")
    repeats = skewed_join(large, firsts, ["vs_digest"], "n").filter("NOT vs_id <=> vs_first AND vs_first IS NOT NULL")
    repeats = written(repeats.select(F.col("vs_id").alias("again"), F.col("vs_digest").alias("same"), "vs_first").distinct(), "warc-repeats")
    few = repeats.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    right = F.broadcast(repeats) if few else repeats
    return keyed.join(right, (keyed["vs_digest"] == right["same"]) & keyed["vs_id"].eqNullSafe(right["again"]), "left").drop("again", "same")


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a WARC record for each row into bundles in `folder` (a URI; by default in the shared folder); gives the index.

    Of rows with equal payloads of at least 100 bytes that with the smallest id is a response, the others
    are revisits of it; null html is an empty payload. A row of the index says in which bundle and frame,
    and where in the unpacked frame, a record stands. The index is written before it is used, so that it
    names the files of the attempts that counted; files of failed attempts are in no index. Repeated rows
    get a record each; rows that repeat id and payload are all responses. Ids are integers or null.
    """
    spark = pages.sparkSession
    folder = (folder or fresh_path(spark, "warc")).rstrip("/")
    marked = mark_revisits(pages, id_col, url_col, html_col).select(F.col("vs_id").cast("long").alias("id"), "vs_url", F.encode("vs_html", "UTF-8").alias("body"), "vs_digest", F.col("vs_first").cast("long").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pafs.FileSystem.from_uri(folder)
        fs.create_dir(place, recursive=True)
        context = TaskContext.get()
        stem, count, writer = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}", 0, None
        schema = pa.schema([("record_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema.names)

        for batch in batches:
            for i in range(batch.num_rows):
                id_, url, body, digest, first = (c[i].as_py() for c in batch.columns)
                if writer is None:
                    writer, count = BundleWriter(f"{stem}-{count:05d}.warc.zst"), count + 1
                writer.add(id_, record_bytes(id_, url, body, digest, first, first is not None and first != id_))
                if writer.raw >= BUNDLE_BYTES:
                    yield rows(writer.close())
                    writer = None
        if writer is not None:
            yield rows(writer.close())

    return written(small_batches(marked).mapInArrow(run, INDEX), "warc-index")


def _record_rows(records: list[dict]) -> pa.RecordBatch:
    kinds = [("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("header_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], k) for n, k in kinds], [n for n, _ in kinds])


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles that an index names, frame by frame from their seek tables; payload is null for revisits; no rows of an empty index."""
    bundles = index.select("bundle").distinct()
    tasks = min(max(bundles.count(), 1), 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as file:
                    for start, packed, raw in seek_table(file):
                        file.seek(start)
                        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=raw)
                        records, at = [], 0
                        while at < len(data):
                            record, at = parse_record(data, at)
                            records.append(record)
                        yield _record_rows(records)

    return small_batches(bundles.repartition(tasks)).mapInArrow(run, RECORD)


def read_records(index: DataFrame) -> DataFrame:
    """The records of the rows of an index (filtered as wanted): each needed frame is read and unpacked by itself; no rows of an empty index."""
    wanted = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, data = None, b""
        for batch in batches:
            records = []
            for row in batch.to_pylist():
                frame = (row["bundle"], row["frame"])
                if frame != held:
                    fs, place = pafs.FileSystem.from_uri(row["bundle"])
                    with fs.open_input_file(place) as file:
                        file.seek(row["frame_start"])
                        data = zstandard.ZstdDecompressor().decompress(file.read(row["frame_bytes"]))
                    held = frame
                records.append(parse_record(data, row["offset"])[0])
            yield _record_rows(records)

    return small_batches(wanted).mapInArrow(run, RECORD)
