"""WARC archives compressed with Zstandard: a dictionary frame first, then one frame per record."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.llm.common import folder_uri, stage_path, staged

#: Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

#: Payloads below this length are always written in full.
SHORTEST_REVISITED = 100
ARCHIVE_BYTES = 64 << 20
#: The dictionary is fitted on the first records of an archive, up to these bounds.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 20, 32 << 10
READ_BYTES = 1 << 20


class WarcError(ValueError):
    """An archive that breaks the format: wrong frame, header, length or digest."""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One record.  A revisit has the response's HTTP head, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    """Control characters and blanks as percent escapes, so that a header stays one line."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def parse(raw: bytes) -> dict:
    """Fields of one record; raises where version, headers, lengths or digests don't hold."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise WarcError("no WARC record head")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b": ")
        if not colon:
            raise WarcError(f"header line without a name: {line[:80]!r}")
        fields[name.decode().lower()] = value.decode()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise WarcError(f"headers missing: {sorted(missing)}")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise WarcError("the block's length is not that of its header")
    if fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("the block's digest is not that of its header")
    http, mark, payload = block.partition(b"\r\n\r\n")
    sizes = [line[16:] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: ")]
    if not mark or len(sizes) != 1:
        raise WarcError("no HTTP head")
    size, digest = int(sizes[0]), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise WarcError("the payload is not that of its headers")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError("a revisit holds no payload and refers to a response")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


class ArchiveWriter:
    """Streams records into one archive; the dictionary is fitted on the first ones."""

    def __init__(self, out):
        self.out, self.held, self.bytes = out, [], 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, raw: bytes) -> None:
        if self.compressor is None:
            self.held.append(raw)
            self.bytes += len(raw)
            if len(self.held) >= SAMPLE_RECORDS or self.bytes >= SAMPLE_BYTES:
                self._start()
        else:
            self._put(self.compressor.compress(raw))

    def close(self) -> None:
        if self.compressor is None:
            self._start()

    def _start(self) -> None:
        dictionary = self._fit([r[: 64 << 10] for r in self.held])
        raw = dictionary.as_bytes()
        self.bytes = 0
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
        for raw in self.held:
            self._put(self.compressor.compress(raw))
        self.held = []

    @staticmethod
    def _fit(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
        except zstandard.ZstdError:  # too few or too short samples for training: they are the dictionary themselves
            plain = b"".join(samples)[-DICTIONARY_BYTES:] or VERSION * 2
            return zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)


def read_archive(source) -> Iterator[bytes]:
    """Records of an archive stream, one frame at a time."""
    head = source.read(8)
    if len(head) != 8 or struct.unpack("<II", head)[0] != DICTIONARY_FRAME:
        raise WarcError("no dictionary frame at the start")
    size = struct.unpack("<II", head)[1]
    raw = source.read(size)
    if len(raw) != size:
        raise WarcError("the dictionary frame ends early")
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == DICTIONARY_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=kind)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    pending = b""
    while True:
        while len(pending) < 18:
            more = source.read(READ_BYTES)
            if not more:
                break
            pending += more
        if not pending:
            return
        try:
            frame = zstandard.get_frame_parameters(pending[:18])
        except zstandard.ZstdError as error:
            raise WarcError(f"no frame where a record should start: {error}") from error
        if frame.dict_id not in (0, dictionary.dict_id()):
            raise WarcError("a frame names another dictionary")
        one = decompressor.decompressobj()
        parts = [one.decompress(pending)]
        while not one.eof:
            more = source.read(READ_BYTES)
            if not more:
                raise WarcError("a frame ends early")
            parts.append(one.decompress(more))
        pending = one.unused_data
        found = b"".join(parts)
        if frame.content_size != len(found):
            raise WarcError("a frame's length is not that of its header")
        yield found


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Decide per page whether it is a response or revisits one: ``page_id``, ``url``, ``payload``, ``digest``, ``refers_to``.

    Of equal payloads of at least 100 bytes the page with the smallest id is the response.  Only digests are
    grouped (with partial minima, so many copies of one page are few rows), and the pages are joined on their own
    id.  A null payload is empty.  Rows that repeat an id with the same payload get the same type; a null
    id is never the smallest unless all are null, and then all stay responses.  Other columns are dropped.
    """
    full = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    narrow = full.where(F.length("payload") >= SHORTEST_REVISITED).select("page_id", "digest")
    owner = narrow.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    again = (
        narrow.join(owner.where("n > 1 AND owner IS NOT NULL"), "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("owner")))
        .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("owner").alias("refers_to"))
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    return full.join(again, same, "left").drop("r_id", "r_digest")


def write_archives(planned: DataFrame, path: str, *, date: str = "2026-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records below ``path``; returns the manifest (``path``, ``records``, ``bytes``).

    Each task streams its rows into archives of about ``archive_bytes``.  A task that is run again writes
    new files; only those of the manifest count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name, out, writer, count = "", None, None, 0

        def finished() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": [count], "bytes": [writer.bytes]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[row].as_py() for c in columns)
                if writer is None:
                    name, count = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{folder}/{name}")
                    writer = ArchiveWriter(out)
                kind = "response" if refers_to is None else "revisit"
                writer.add(record(kind, page_id, url, payload, digest, len(payload), refers_to, date))
                count += 1
                if writer.bytes >= archive_bytes:
                    yield finished()
                    writer = None
        if writer is not None:
            yield finished()

    return planned.mapInArrow(run, "path string, records long, bytes long")


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """All records of the manifest's archives, validated: ``page_id``, ``url``, ``record_type``, ``refers_to``,
    ``payload_digest`` and ``payload_bytes`` (from the headers), ``payload`` (null in revisits)."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    arrow = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
         ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(f"{folder}/{name}") as source:
                    for raw in read_archive(source):
                        rows.append(parse(raw))
                        held += len(raw)
                        seen += 1
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if seen != records:
                    raise WarcError(f"{name} holds {seen} records instead of {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    files = max(1, manifest.count())
    return manifest.repartition(min(files, 4096), "path").mapInArrow(run, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write pages as archives (below the shared folder unless ``path`` names a folder) and read them back."""
    target = folder_uri(spark, path) if path else stage_path(spark, "warc")
    manifest = staged(write_archives(plan_records(pages, **columns), target), "warc-manifest")
    return read_archives(manifest, target)
