"""Token ids in word-aligned binary files (Simple-8b), written in document order and read back."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostpulse.llm.common import folder_uri, pieces, spans_to_index, splits, stage_path, staged, text_bytes
from hostpulse.llm.words import Splitter, WordIds, library_encoder

#: Fixed values: (values per word, bits per value) of selectors 1 to 15.  Selector 0 is the escape: the
#: next 64-bit word holds one value as it is.
SELECTORS = [(1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1), (120, 0)]
BLOCK = 256
MAGIC = b"S8B1"
#: Text bytes per range of documents; each range becomes one file.
FILE_TEXT_BYTES = 32 << 20


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; looked up where all are short, as token ids are."""
    if len(values) and values.max() < len(_SHORT):
        return _SHORT[values]
    return _wide_widths(values)


def _wide_widths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint8)
    rest = values.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        big = high != 0
        out[big] += step
        rest = np.where(big, high, rest)
    return out + (rest != 0).astype(np.uint8)


_SHORT = _wide_widths(np.arange(1 << 16))


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of the values and each block's first word; blocks have ``block`` values, the last what is left.

    Greedy: each word takes the selector with most values that fit.  Values past a block's end count as
    zeros.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = values.astype(np.uint64, copy=False)
    blocks = splits(n, block)
    first = np.arange(blocks) * block
    ends = np.minimum(first + block, n)
    selector = _selectors(_widths(values), block)
    # values by block, with as many zeros behind each block as a word may reach past it
    stride = block + max(c for c, b in SELECTORS if b)
    padded = np.zeros((blocks, stride), np.uint64)
    padded[: n // block, :block] = values[: n // block * block].reshape(-1, block)
    padded[n // block :, : n % block] = values[n // block * block :]
    padded = padded.reshape(-1)
    count = np.array([1, *(c for c, _ in SELECTORS)], np.int64)
    # walk all blocks in step: which values start a word
    head = np.zeros(n, bool)
    head[first] = True
    at, stop = first, ends
    while len(at):
        at = at + count[selector[at]]
        live = at < stop
        at, stop = at[live], stop[live]
        head[at] = True
    heads = np.flatnonzero(head)
    chosen = selector[heads]
    length = 1 + (chosen == 0)
    place = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    source = heads // block * stride + heads % block
    for k, (c, b) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(chosen == k)
        if not len(rows):
            continue
        word = np.full(len(rows), np.uint64(k) << np.uint64(60), np.uint64)
        start = source[rows]
        for j in range(c if b else 0):
            word |= padded[start + j] << np.uint64(j * b)
        words[place[rows]] = word
    escaped = np.flatnonzero(chosen == 0)
    words[place[escaped] + 1] = values[heads[escaped]]
    return words, place[np.searchsorted(heads, first)]


def _selectors(width: np.ndarray, block: int) -> np.ndarray:
    """The selector with most values for a word that starts at each position, 0 where only the escape fits."""
    n, blocks = len(width), splits(len(width), block)
    widest = np.zeros((blocks, block), np.uint8)  # of as many values as a selector takes; none count past a block's end
    widest.reshape(-1)[:n] = width
    best = np.zeros((blocks, block), np.uint8)
    have = 1
    for c, b in SELECTORS:
        while have < c:
            step = min(have, c - have)
            if step < block:
                widest[:, :-step] = np.maximum(widest[:, :-step], widest[:, step:])
            have += step
        best += widest <= b  # what fits a selector fits all before it, which take fewer and longer values
    return best.reshape(-1)[:n]


def unpack(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values of packed words; ``starts`` are the blocks' first words."""
    if n == 0:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = _raw_words(selector, starts)
    heads = ~raw
    table = np.array([1, *(c for c, _ in SELECTORS)], np.int64)
    counts = np.where(heads, table[selector], 0)
    owner = np.searchsorted(starts, np.arange(len(words)), side="right") - 1
    before = np.cumsum(counts) - counts
    place = owner * block + before - before[starts[owner]]
    room = splits(n, block) * block + 128
    out = np.zeros(room, np.uint64)
    for k, (c, b) in enumerate(SELECTORS, 1):
        rows = np.flatnonzero(heads & (selector == k))
        if not len(rows) or b == 0:
            continue
        mask = np.uint64((1 << b) - 1)
        for j in range(c):
            value = words[rows] >> np.uint64(j * b) & mask
            # zeros past a block's end must not overwrite the next block
            inside = place[rows] + j < (owner[rows] + 1) * block
            out[(place[rows] + j)[inside]] = value[inside]
    escapes = np.flatnonzero(heads & (selector == 0))
    out[place[escapes]] = words[escapes + 1]
    return out[:n]


def _raw_words(selector: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which words are escaped values: those after an escape, which itself isn't one."""
    zero = selector == 0
    raw = np.zeros(len(selector), bool)
    if not zero.any():
        return raw
    is_start = np.zeros(len(selector), bool)
    is_start[starts] = True
    after = False
    for i in np.flatnonzero(zero | np.append(False, zero[:-1])).tolist():
        after = not is_start[i] and i > 0 and bool(zero[i - 1]) and not raw[i - 1]
        raw[i] = after
    return raw


def write_file(out, groups: Iterator[tuple[list[tuple[int | None, int]], np.ndarray]]) -> tuple[int, int]:
    """Write (documents with their counts, ids) groups; returns documents and ids.

    Layout: magic; per group a header of 64-bit numbers (documents, ids, words of the counts, words of the ids,
    blocks), document ids with a null flag each, packed counts, block offsets, packed ids; a header of
    zeros ends the file.
    """
    out.write(MAGIC)
    documents = total = 0
    for docs, ids in groups:
        numbers = np.array([0 if d is None else d for d, _ in docs], "<i8")
        nulls = np.array([d is None for d, _ in docs], np.uint8)
        counts = np.array([c for _, c in docs], np.uint64)
        packed_counts, count_starts = pack(counts)
        packed, starts = pack(ids)
        out.write(struct.pack("<6q", len(docs), len(ids), len(packed_counts), len(packed), len(starts), len(count_starts)))
        for part in (numbers, nulls, count_starts.astype("<i8"), packed_counts.astype("<u8"), starts.astype("<i8"), packed.astype("<u8")):
            out.write(part.tobytes())
        documents += len(docs)
        total += len(ids)
    out.write(struct.pack("<6q", *[0] * 6))
    return documents, total


def read_file(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Groups of a file: document ids, their counts, and all ids."""

    def take(kind: str, n: int) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        raw = source.read(size)
        if len(raw) != size:
            raise ValueError("token file ends early")
        return np.frombuffer(raw, kind)

    if source.read(4) != MAGIC:
        raise ValueError("not a token file")
    while True:
        documents, ids, count_words, id_words, blocks, count_blocks = take("<i8", 6).tolist()
        if documents == 0:
            return
        numbers, nulls = take("<i8", documents), take("u1", documents)
        count_starts, packed_counts = take("<i8", count_blocks), take("<u8", count_words)
        starts, packed = take("<i8", blocks), take("<u8", id_words)
        counts = unpack(packed_counts, count_starts, documents).astype(np.int64)
        yield [None if z else d for d, z in zip(numbers.tolist(), nulls.tolist())], counts, unpack(packed, starts, ids)


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    *,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_TEXT_BYTES,
) -> DataFrame:
    """Encode documents in ascending id order into files below ``path``; returns the manifest.

    The documents are range-partitioned by id (rows that share an id also by their text, so a repeated id
    does not fill one task); one task streams one range into one file.  Null ids come first, null texts are
    empty, every document gets ``end_id`` appended.  A task that is run again writes a new file, and only the
    files of the manifest (``path``, ``first_id``, ``first_tie``, ``documents``, ``ids``) count.  Other columns are dropped.
    """
    rows, size = text_bytes(docs, text_col)
    tie = F.xxhash64(text_col)
    ranges = splits(size + 64 * rows, file_bytes)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), tie.alias("tie"), F.col(text_col).alias("text"))
    dealt = narrow.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: list = []

        def groups():
            split = Splitter(tokenizer)
            encode = WordIds(library_encoder(split.library))
            for batch in batches:
                for piece in pieces(batch, "text"):
                    if not first:
                        first.extend((piece.column("doc_id")[0].as_py(), piece.column("tie")[0].as_py()))
                    ids, counts = encode(split(piece.column("text")), piece.num_rows)
                    places = np.cumsum(counts)
                    yield list(zip(piece.column("doc_id").to_pylist(), (counts + 1).tolist())), np.insert(ids, places, end_id)

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}.s8b"
        with store.open_output_stream(name) as out:
            documents, ids = write_file(out, groups())
        if documents:
            yield pa.RecordBatch.from_pydict(
                {"path": [name.rsplit("/", 1)[1]], "first_id": pa.array([first[0]], pa.int64()), "first_tie": [first[1]], "documents": [documents], "ids": [ids]}
            )

    return dealt.mapInArrow(run, "path string, first_id long, first_tie long, documents long, ids long")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """Documents of the manifest's files: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and
    ``ids`` (binary, unsigned 32-bit little-endian).  The running sum is over files, not documents."""
    spark = manifest.sparkSession
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_tie").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("path", "base")
    many = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base"))):
                with store.open_input_stream(f"{folder}/{name}") as source:
                    for numbers, counts, ids in read_file(source):
                        ends = np.cumsum(counts)
                        raw = ids.astype("<u4")
                        offsets = np.append(0, ends * 4).astype(np.int64)
                        blob = pa.Array.from_buffers(pa.large_binary(), len(numbers), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(numbers, pa.int64()), pa.array(base + ends - counts), pa.array(counts), blob.cast(pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        base += int(ends[-1])

    return files.repartition(min(many, 4096), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, *, end_id: int, path: str | None = None) -> DataFrame:
    """Write the documents' token files (below the shared folder unless ``path`` names a folder) and read them back."""
    target = folder_uri(spark, path) if path else stage_path(spark, "tokens")
    manifest = staged(write_token_files(docs, tokenizer, target, end_id=end_id), "token-manifest")
    return read_token_files(manifest, target)


def pack_bytes(values: np.ndarray) -> bytes:
    """One array as a token file of one document, for single uses and tests."""
    out = io.BytesIO()
    write_file(out, iter([([(0, len(values))], values)]))
    return out.getvalue()
