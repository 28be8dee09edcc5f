"""Removal of long repeated substrings: suffixes ranged by leading bytes, sorted per bucket, compared with neighbours.

Only suffixes that start at content-chosen places are looked at.  Of the places at which a window of ``length`` bytes
may start a gram, the one with the smallest gram hash is the window's anchor, so equal windows have equal anchors at
equal offsets, wherever they stand.  An anchor's context is the bytes of all windows that it anchors.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from hostpulse.llm.common import SpanHash, flat, mix, pieces, spans_to_index, splits, stage_path, staged

LENGTH = 50
GRAM = 20
#: Text bytes in a chunk file (a longer document is a chunk of its own), and of the text whose suffixes a bucket gets.
CHUNK_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: Anchors are found in slices of whole documents of about this many bytes, which stay in a processor's cache.
SLICE_BYTES = 128 << 10
MOST_BUCKETS = 1 << 16
#: Grams per chunk from which splitters are taken, and how many splitter samples the driver takes at most.
SAMPLE_PER_CHUNK, MOST_SAMPLES = 400, 1 << 20
#: Contexts (counted once per chunk) from which a gram is crowded, how many of them its estimate is taken from, and the
#: contexts whose windows are hashed at once.
MOST_CONTEXTS, SAMPLED_CONTEXTS, WINDOWED_CONTEXTS = 1 << 16, 1 << 8, 1 << 13
#: Contexts whose leading bytes are copied at once.
AT_ONCE = 1 << 16
#: Chunks whose verdicts (and masks) are kept in one file of their stage.
CHUNKS_PER_FILE = 64
#: Segments up to here are finished by one sort.
SMALL_SEGMENT = 1 << 12
NO_ID = np.iinfo(np.int64).max
_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(5))


@dataclass
class Anchors:
    """Anchors of a buffer of documents: place, first and last window start, gram and context hashes, document.

    Places and numbers take 32 bits: a chunk's text is one Arrow array of strings, which holds less than 2^31 bytes.
    """

    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    document: np.ndarray


def _slide(values: np.ndarray, width: int, smallest: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    pick = np.minimum if smallest else np.maximum
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def anchors(body: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Anchors:
    """Anchors of all windows of ``length`` bytes that lie within a document."""
    n, width = len(body), length - gram + 1
    none = np.zeros(0, np.int32)
    if n < length:
        return Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    hasher = SpanHash(_BYTES[body])
    hashes = hasher.fixed(gram)
    least = _slide(hashes, width, True)
    reach = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    place = np.flatnonzero(_slide(reach, width, False) == hashes)
    # which windows: from where the anchor enters or the one before leaves, to where the next takes over
    enters = place - (width - 1)
    leaves = np.append(np.int64(-(1 << 60)), place[:-1] + 1)
    smaller = np.append(True, hashes[place[1:]] < hashes[place[:-1]])
    first = np.where(smaller, np.minimum(enters, np.where(leaves < 0, enters, leaves)), leaves)
    first = np.minimum.accumulate(first[::-1])[::-1]
    last = np.append(first[1:] - 1, len(least) - 1)
    last = np.minimum(last, place)
    document = np.searchsorted(offsets, place, side="right") - 1
    first = np.maximum(first, offsets[document])
    last = np.minimum(last, offsets[document + 1] - length)
    keep = (first <= last) & (place + gram <= offsets[document + 1])
    place, first, last, document = place[keep], first[keep], last[keep], document[keep]
    context = mix(hasher(first, last + length) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    narrow = (x.astype(np.int32) for x in (place, first, last))
    return Anchors(*narrow, hashes[place], context, document.astype(np.int32))


def _merged(parts: list[Anchors], shifts: list[tuple[int, int]]) -> Anchors:
    fields = []
    for name in ("place", "first", "last", "gram", "context", "document"):
        add = {"gram": None, "context": None, "document": 1}.get(name, 0)
        fields.append(np.concatenate([getattr(p, name) if add is None else getattr(p, name) + s[add] for p, s in zip(parts, shifts)]))
    return Anchors(*fields)


class Chunk:
    """Documents of a chunk file and their anchors, found slice by slice."""

    def __init__(self, store: fs.FileSystem, path: str, length: int, gram: int):
        with store.open_input_stream(path) as source:
            batch = pa.ipc.open_stream(pa.py_buffer(zstandard.ZstdDecompressor().decompress(source.read()))).read_next_batch()
        self.ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
        self.null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        self.body, self.offsets = flat(batch.column("text"))
        parts, shifts, seen = [], [], 0
        for piece in pieces(batch, "text", SLICE_BYTES):
            body, offsets = flat(piece.column("text"))
            parts.append(anchors(body, offsets, length, gram))
            shifts.append((int(self.offsets[seen]), seen))
            seen += piece.num_rows
        self.found = _merged(parts, shifts)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts: a representative anchor, the smallest document id, and each anchor's context number.

        Contexts are in the order of (gram, context), which every reading of the chunk repeats.
        """
        f = self.found
        ids = self.ids[f.document]
        order = np.lexsort((ids, f.context, f.gram))
        gram, context = f.gram[order], f.context[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])) if len(order) else np.zeros(0, bool)
        number = np.zeros(len(order), np.int32)
        number[order] = np.cumsum(new) - 1
        head = order[new]
        return head, ids[head], number


def _grams(body: np.ndarray, places: np.ndarray, gram: int) -> np.ndarray:
    """Leading bytes of suffixes, comparable as they sort."""
    wide = np.lib.stride_tricks.sliding_window_view(body, gram)[places] if len(places) else np.zeros((0, gram), np.uint8)
    return np.ascontiguousarray(wide).view(f"S{gram}").reshape(-1)


def write_chunks(docs: DataFrame, path: str, *, id_col: str, text_col: str, chunk_bytes: int, length: int, gram: int) -> DataFrame:
    """Write the documents as chunk files; rows: ``chunk`` (file), ``documents``, ``bytes`` and sampled grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as out:
                out.write_batch(whole)
            name = f"{uuid.uuid4().hex}.chunk"
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))
            body, offsets = flat(whole.column("text"))
            # anchors of a few evenly spread slices stand for all
            samples = []
            for at in np.linspace(0, max(0, len(body) - 8192), 16).astype(np.int64).tolist():
                part = body[at : at + 8192]
                found = anchors(part, np.array([0, len(part)]), length, gram)
                samples.append(_grams(part, found.place[:: max(1, len(found.place) * 16 // SAMPLE_PER_CHUNK)], gram))
            grams = [bytes(g).ljust(gram, b"\0") for s in samples for g in s.tolist()]
            return pa.RecordBatch.from_pydict(
                {"chunk": [name], "documents": [whole.num_rows], "bytes": [len(body)], "grams": pa.array([grams], pa.list_(pa.binary()))}
            )

        for batch in batches:
            for piece in pieces(batch, "text", chunk_bytes // 8):
                own = len(flat(piece.column("text"))[0])
                if held and size + own > chunk_bytes:
                    yield flush()
                    held, size = [], 0
                held.append(piece)
                size += own
        if held:
            yield flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "chunk string, documents long, bytes long, grams array<binary>")


def splitters(manifest: DataFrame, buckets: int, gram: int) -> np.ndarray:
    """Bucket boundaries from the sampled grams; the driver takes a bounded number of them."""
    grams = manifest.select(F.explode("grams").alias("g"))
    count = grams.count()
    if count > MOST_SAMPLES:
        grams = grams.where(F.pmod(F.xxhash64("g", F.monotonically_increasing_id()), F.lit(splits(count, MOST_SAMPLES))) == 0)
    taken = np.sort(np.array([bytes(r["g"]) for r in grams.collect()], f"S{gram}"))
    if not len(taken) or buckets < 2:
        return np.zeros(0, f"S{gram}")
    return np.unique(taken[(np.arange(1, buckets) * len(taken)) // buckets])


def _pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        out.write(np.int64(a.nbytes).tobytes())
        out.write(np.ascontiguousarray(a).tobytes())
    return out.getvalue()


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _chunk_rows(path: str, length: int, gram: int, rows: pa.RecordBatch) -> Iterator[tuple[str, Chunk]]:
    store, folder = fs.FileSystem.from_uri(path)
    for name in rows.column("chunk").to_pylist():
        yield name, Chunk(store, f"{folder}/{name}", length, gram)


def crowded_grams(manifest: DataFrame, path: str, most_contexts: int, length: int, gram: int) -> np.ndarray:
    """Hashes of the grams with ``most_contexts`` contexts or more, each counted once per chunk.

    The counts are estimated from every n-th context (all, where few are enough).  What a gram is taken for decides where
    its contexts are compared, not the result.  There are at most as many as all contexts by ``most_contexts``.
    """
    one_in = max(1, most_contexts // SAMPLED_CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chunk in _chunk_rows(path, length, gram, batch):
                head, _, _ = chunk.contexts()
                f = chunk.found
                draw = mix(f.context[head] + np.uint64(zlib.crc32(name.encode())))
                grams, counts = np.unique(f.gram[head[draw % np.uint64(one_in) == 0]].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts.astype(np.int64))], names=["gram", "n"])

    counts = manifest.select("chunk").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") * one_in >= most_contexts).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


def _buckets(chunk: Chunk, head: np.ndarray, bounds: np.ndarray, gram: int, crowded: np.ndarray) -> np.ndarray:
    """The bucket of each context; those of crowded grams get a number behind the last one and are sent to none."""
    bucket = np.zeros(len(head), np.int32)
    for i in range(0, len(head), AT_ONCE):
        some = slice(i, i + AT_ONCE)
        bucket[some] = np.searchsorted(bounds, _grams(chunk.body, chunk.found.place[head[some]], gram), side="right")
    bucket[np.isin(chunk.found.gram[head], crowded)] = len(bounds) + 1
    return bucket


def _windows(chunk: Chunk, head: np.ndarray, crowded: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of the contexts of crowded grams, some contexts at a time: context number, bytes before the gram, and a
    key of two hashes (of the window, and of its gram with those bytes' number)."""
    f = chunk.found
    which = np.flatnonzero(np.isin(f.gram[head], crowded))
    for i in range(0, len(which), WINDOWED_CONTEXTS):
        some = which[i : i + WINDOWED_CONTEXTS]
        at = head[some]
        count = f.last[at] - f.first[at] + 1
        size = count + length - 1
        start = np.cumsum(size) - size
        hashes = SpanHash(_BYTES[chunk.body[spans_to_index(f.first[at], size)]]).fixed(length)
        window = spans_to_index(start, count)
        before = np.repeat(start + f.place[at] - f.first[at], count) - window
        grams = (np.repeat(f.gram[at], count) << np.uint64(5)) | before.astype(np.uint64)
        yield np.repeat(some, count), before, np.column_stack([hashes[window], grams])


def crowded_windows(manifest: DataFrame, path: str, crowded: np.ndarray, length: int, gram: int) -> DataFrame:
    """Per chunk the windows of crowded grams' contexts with the smallest and the largest document (by contexts' smallest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chunk in _chunk_rows(path, length, gram, batch):
                head, ids, _ = chunk.contexts()
                for context, _, keys in _windows(chunk, head, crowded, length):
                    document = ids[context]
                    order = np.lexsort((document, keys[:, 1], keys[:, 0]))
                    keys, document = keys[order], document[order]
                    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
                    raw = pa.py_buffer(np.ascontiguousarray(keys[first]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(first)),
                            pa.Array.from_buffers(pa.binary(16), len(first), [None, raw]).cast(pa.binary()),
                            pa.array(document[first]),
                            pa.array(document[np.append(first[1:], len(document)) - 1]),
                        ],
                        names=["chunk", "window", "least", "most"],
                    )

    return manifest.select("chunk").mapInArrow(run, "chunk string, window binary, least long, most long")


def census(manifest: DataFrame, path: str, bounds: np.ndarray, crowded: np.ndarray, length: int, gram: int) -> DataFrame:
    """Per chunk and bucket the chunk's distinct contexts there, packed: gram (40 bits), context (64 bits) and, by
    document, how many contexts have it as their smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chunk in _chunk_rows(path, length, gram, batch):
                head, ids, _ = chunk.contexts()
                f = chunk.found
                bucket = _buckets(chunk, head, bounds, gram, crowded)
                order = np.lexsort((ids, bucket))
                edges = np.searchsorted(bucket[order], np.arange(len(bounds) + 2))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    mine = order[edges[b] : edges[b + 1]]
                    g = np.ascontiguousarray(f.gram[head[mine]].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
                    documents, counts = np.unique(ids[mine], return_counts=True)
                    packed = _pack(g, f.context[head[mine]], documents, counts.astype(np.uint32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([name]), pa.array([packed], pa.binary())], names=["bucket", "chunk", "contexts"]
                    )

    return manifest.select("chunk").mapInArrow(run, "bucket int, chunk string, contexts binary")


#: What a bucket says of a chunk's context.
NOTHING, COVERED, COMPARE = 0, 1, 2


def _judge(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's contexts of one bucket: covered by a smaller document, to be compared, or neither."""
    grams, contexts, ids, sizes = [], [], [], []
    for raw in rows["contexts"]:
        g, c, documents, counts = _unpack(raw, "u1", "<u8", "<i8", "<u4")
        wide = np.zeros((len(c), 8), np.uint8)
        wide[:, :5] = g.reshape(-1, 5)
        grams.append(wide.view("<u8").reshape(-1))
        contexts.append(c)
        ids.append(np.repeat(documents, counts))
        sizes.append(len(c))
    gram, context, document = np.concatenate(grams), np.concatenate(contexts), np.concatenate(ids)
    order = np.lexsort((document, context, gram))
    g, c, d = gram[order], context[order], document[order]
    new_gram = np.append(True, g[1:] != g[:-1])
    new = new_gram | np.append(True, c[1:] != c[:-1])
    first = np.flatnonzero(new)
    smallest = np.repeat(d[first], np.diff(np.append(first, len(d))))
    variants = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_gram))
    several = np.repeat(variants > 1, np.diff(np.append(np.flatnonzero(new_gram), len(d))))
    verdict = np.where(d > smallest, COVERED, np.where(several, COMPARE, NOTHING)).astype(np.uint8)
    out = np.zeros(len(verdict), np.uint8)
    out[order] = verdict
    edges = np.cumsum([0, *sizes])
    keep = [i for i in range(len(sizes)) if out[edges[i] : edges[i + 1]].any()]
    press = zstandard.ZstdCompressor(level=1)
    return pd.DataFrame(
        {
            "bucket": rows["bucket"].iloc[keep].to_numpy(),
            "chunk": rows["chunk"].iloc[keep].to_numpy(),
            "verdicts": [press.compress(out[edges[i] : edges[i + 1]].tobytes()) for i in keep],
        }
    )


def _verdicts(
    chunk: Chunk, bounds: np.ndarray, gram: int, crowded: np.ndarray, rows: list[tuple[int, bytes]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's contexts with their verdicts, in the same order in which the census packed them."""
    head, ids, number = chunk.contexts()
    bucket = _buckets(chunk, head, bounds, gram, crowded)
    order = np.lexsort((ids, bucket))
    edges = np.searchsorted(bucket[order], np.arange(len(bounds) + 2))
    verdict = np.zeros(len(head), np.uint8)
    open_ = zstandard.ZstdDecompressor()
    for b, raw in rows:
        verdict[order[edges[b] : edges[b + 1]]] = np.frombuffer(open_.decompress(raw), np.uint8)
    return head, ids, number, bucket, verdict


def multikey_sort(texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of byte strings (rows padded with zeros) by three-way multikey quicksort on 8-byte tokens.

    A segment whose first ``depth`` tokens agree is split by a pivot token into smaller, equal and larger;
    only the equal part moves on to the next token.  Small segments are finished by one sort.
    """
    n, width = texts.shape
    tokens = -(-width // 8)
    wide = np.zeros((n, tokens * 8), np.uint8)
    wide[:, :width] = texts
    keys = wide.view(">u8").astype(np.uint64)
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        start, stop, depth = stack.pop()
        if stop - start < 2:
            continue
        mine = order[start:stop]
        if depth == tokens:
            order[start:stop] = mine[np.argsort(lengths[mine], kind="stable")]
            continue
        if stop - start <= SMALL_SEGMENT:
            columns = [lengths[mine], *(keys[mine, t] for t in range(tokens - 1, depth - 1, -1))]
            order[start:stop] = mine[np.lexsort(columns)]
            continue
        token = keys[mine, depth]
        tried = np.sort(token[:: max(1, len(token) // 9)])
        pivot = tried[len(tried) // 2]
        low, high = token < pivot, token > pivot
        same = ~(low | high)
        order[start:stop] = np.concatenate([mine[low], mine[same], mine[high]])
        a, b = start + int(low.sum()), stop - int(high.sum())
        stack += [(start, a, depth), (a, b, depth + 1), (b, stop, depth)]
    return order


def _shared(texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before it."""
    n = len(texts)
    if n < 2:
        return np.zeros(n, np.int64)
    differ = texts[1:] != texts[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), texts.shape[1])
    return np.append(0, np.minimum(first, np.minimum(lengths[1:], lengths[:-1])))


def _compare_of(length: int, gram: int):
    """Windows of a bucket's contexts that also start in a smaller document, as a bit mask per context."""
    left_width, right_width = length - gram, length

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        body = np.frombuffer(b"".join(rows["body"]), np.uint8)
        parts = [_unpack(raw, "<i4", "<u1", "<u1", "<i8") for raw in rows["where"]]
        number = np.concatenate([p[0] for p in parts])
        before, size = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2))
        document = np.concatenate([p[3] for p in parts])
        owner = np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts])
        start = np.cumsum(size) - size
        # suffixes from the anchor on, and the bytes before it, nearest first
        right_size = size - before
        right = np.zeros((len(size), right_width), np.uint8)
        row = np.repeat(np.arange(len(size)), right_size)
        right[row, spans_to_index(np.zeros(len(size), np.int64), right_size)] = body[spans_to_index(start + before, right_size)]
        order = multikey_sort(right, right_size)
        shared = _shared(right[order], right_size[order])
        del right, row
        left = np.zeros((len(size), left_width), np.uint64)
        for o in range(left_width):
            has = before > o
            previous = left[:, o - 1] if o else np.zeros(len(size), np.uint64)
            value = np.zeros(len(size), np.uint64)
            value[has] = body[start[has] + before[has] - 1 - o]
            left[:, o] = mix(previous * np.uint64(0x9E3779B97F4A7C15) + value + np.uint64(1))
        mask = np.zeros(len(size), np.uint32)
        last_before = length - right_size  # the fewest bytes before the anchor of any of its windows
        for o in range(left_width + 1):
            at = order[(before[order] >= o) & (last_before[order] <= o)]
            if len(at) < 2:
                continue
            run_of = np.cumsum(shared < length - o)[(before[order] >= o) & (last_before[order] <= o)]
            key = left[at, o - 1] if o else np.zeros(len(at), np.uint64)
            by = np.lexsort((document[at], key, run_of))
            r, k, d = run_of[by], key[by], document[at][by]
            new = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))
            first = np.flatnonzero(new)
            least = np.repeat(d[first], np.diff(np.append(first, len(d))))
            mask[at[by[d > least]]] |= np.uint32(1 << o)
        hit = np.flatnonzero(mask)
        groups = np.searchsorted(owner[hit], np.arange(len(rows) + 1))
        keep = [i for i in range(len(rows)) if groups[i] < groups[i + 1]]
        return pd.DataFrame(
            {
                "chunk": rows["chunk"].iloc[keep].to_numpy(),
                "masks": [_pack(number[hit[groups[i] : groups[i + 1]]], mask[hit[groups[i] : groups[i + 1]]]) for i in keep],
            }
        )

    return run


def _spans(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs from the starts and ends of covered spans, each inside a document: document, start, end."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    reach = np.maximum.accumulate(ends)
    document = np.searchsorted(chunk.offsets, starts, side="right") - 1
    # runs that touch are one, but not across a border of documents
    new = np.append(True, (starts[1:] > reach[:-1]) | (document[1:] != document[:-1])) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return document[first], starts[first].astype(np.int64), reach[np.append(first[1:], len(starts))[: len(first)] - 1].astype(np.int64)


def _removed(chunk: Chunk, whole: np.ndarray, bits: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs of a chunk: all windows of the anchors in ``whole``, and those in the others' bit masks."""
    f = chunk.found
    some = np.flatnonzero(whole)
    # an anchor's windows start one after the other: together they cover one span
    begin, end = [f.first[some]], [f.last[some] + length]
    part = np.flatnonzero(~whole & (bits != 0))
    for o in range(length - gram + 1):
        at = part[(bits[part] >> np.uint32(o)) & np.uint32(1) == 1]
        begin.append(f.place[at] - o)
        end.append(f.place[at] - o + length)
    return _spans(chunk, np.concatenate(begin), np.concatenate(end))


def _outside(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks of the bytes that lie in none of the spans, which do not overlap."""
    inside = np.zeros(size + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    return np.cumsum(inside[:-1], dtype=np.int8) == 0


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    most_contexts: int = MOST_CONTEXTS,
) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Returns ``doc_id``, ``n_bytes``, ``kept`` (the remaining bytes) and ``spans`` (maximal removed runs, as [start, end) pairs), one
    row per input row.  Strings are judged on the input.  Null and empty texts lose nothing; rows that share an
    id do not count as smaller than each other; a null id counts as larger than any id.  Other columns are dropped.

    1. The documents are written once as chunk files.  2. Each chunk sends the hashes of its distinct contexts to the bucket
    of their gram; buckets are ranges of the suffixes' leading bytes between sampled splitters, and all suffixes that share a
    gram share a bucket, so none has to be compared across a boundary.  A context that stands in a smaller document elsewhere
    is covered whole.  3. Contexts that share a gram with others, and only from the chunk that has them first, are sent as
    bytes; their bucket sorts the suffixes and compares neighbours.  4. Each chunk removes what it was told.
    However many documents share a passage, a chunk sends it once.  A gram with ``most_contexts`` contexts or more would
    fill one bucket: its contexts go to none, but hashes of their windows are grouped, with the smallest document of each.
    """
    if not 0 < length - gram < 32:
        raise ValueError("a window must be longer than a gram, by less than 32 bytes")
    path = stage_path(docs.sparkSession, "chunks")
    written = write_chunks(docs, path, id_col=id_col, text_col=text_col, chunk_bytes=chunk_bytes, length=length, gram=gram)
    manifest = staged(written, "chunk-manifest")
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    chunks = max(1, total[1])
    bounds = splitters(manifest, min(MOST_BUCKETS, splits(total[0], bucket_bytes)), gram)
    spread = manifest.select("chunk").repartition(min(chunks, 1 << 16), "chunk")
    crowded = crowded_grams(spread, path, most_contexts, length, gram)
    packed = census(spread, path, bounds, crowded, length, gram)
    # what chunks are told is small: few files hold it, whatever the number of tasks that make it
    files = max(docs.sparkSession.sparkContext.defaultParallelism, splits(chunks, CHUNKS_PER_FILE))
    verdicts = staged(packed.groupBy("bucket").applyInPandas(_judge, "bucket int, chunk string, verdicts binary").repartition(files), "verdicts")

    def told(chunk: pa.Table) -> list[tuple[int, bytes]]:
        return list(zip(chunk.column("bucket").to_pylist(), chunk.column("verdicts").to_pylist()))

    many = min(chunks, 1 << 16)

    def by_chunk(df: DataFrame) -> GroupedData:
        return df.repartition(many, "chunk").groupBy("chunk")  # the work follows the chunks, not the bytes of what they are told

    names = by_chunk(manifest.select("chunk"))

    def send(key: tuple, chunk_rows: pa.Table, verdict_rows: pa.Table) -> pa.Table:
        out = {"bucket": [], "chunk": [], "where": [], "body": []}
        for name, chunk in _chunk_rows(path, length, gram, chunk_rows):
            head, ids, _, bucket, verdict = _verdicts(chunk, bounds, gram, crowded, told(verdict_rows))
            mine = np.flatnonzero(verdict == COMPARE)
            mine = mine[np.argsort(bucket[mine], kind="stable")]
            edges = np.searchsorted(bucket[mine], np.arange(len(bounds) + 2))
            f = chunk.found
            for b in np.flatnonzero(np.diff(edges)).tolist():
                some = mine[edges[b] : edges[b + 1]]
                first, last, place = f.first[head[some]], f.last[head[some]], f.place[head[some]]
                size = last + length - first
                out["bucket"].append(b)
                out["chunk"].append(name)
                out["where"].append(_pack(some.astype(np.int32), (place - first).astype(np.uint8), size.astype(np.uint8), ids[some]))
                out["body"].append(chunk.body[spans_to_index(first, size)].tobytes())
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("where", pa.binary()), ("body", pa.binary())]))

    sent = names.cogroup(by_chunk(verdicts)).applyInArrow(send, "bucket int, chunk string, where binary, body binary")
    masks = staged(sent.groupBy("bucket").applyInPandas(_compare_of(length, gram), "chunk string, masks binary").repartition(files), "masks")
    answers = verdicts.unionByName(masks, allowMissingColumns=True)
    if len(crowded):
        windows = staged(crowded_windows(spread, path, crowded, length, gram), "crowded-windows")
        spans = windows.groupBy("window").agg(F.min("least").alias("smallest"), F.max("most").alias("largest"))
        smallest = staged(spans.where("smallest < largest").select("window", "smallest"), "smallest-documents")
        found = windows.join(smallest, "window").where("smallest < most").select("chunk", "window", "smallest")
        answers = answers.unionByName(found, allowMissingColumns=True)

    def cut(key: tuple, chunk_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))])
        tables = [pa.table({c: [] for c in schema.names}, schema=schema)]
        for _, chunk in _chunk_rows(path, length, gram, chunk_rows):
            said = [(b, v) for b, v in told(answer_rows) if v is not None]
            head, ids, number, _, verdict = _verdicts(chunk, bounds, gram, crowded, said)
            bits = np.zeros(len(head), np.uint32)
            for raw in answer_rows.column("masks").to_pylist():
                if raw is not None:
                    which, mask = _unpack(raw, "<i4", "<u4")
                    bits[which] |= mask
            f = chunk.found
            if len(crowded):
                windows = answer_rows.select(["window", "smallest"]).drop_null()
                known, at = np.unique(np.array(windows.column("window").to_pylist(), "S16"), return_index=True)
                smallest = windows.column("smallest").to_numpy()[at]
                for context, before, keys in _windows(chunk, head, crowded, length) if len(known) else ():
                    key = np.ascontiguousarray(keys).view("S16").reshape(-1)
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hit = (known[at] == key) & (smallest[at] < ids[context])
                    np.bitwise_or.at(bits, context[hit], np.uint32(1) << before[hit].astype(np.uint32))
            whole = (verdict[number] == COVERED) | (chunk.ids[f.document] > ids[number])
            document, starts, ends = _removed(chunk, whole, bits[number], length, gram)
            left = chunk.body[_outside(len(chunk.body), starts, ends)]
            sizes = np.diff(chunk.offsets)
            lost = np.bincount(document, weights=ends - starts, minlength=len(sizes)).astype(np.int64)
            kept_at = np.append(0, np.cumsum(sizes - lost))
            base = chunk.offsets[document]
            spans = np.column_stack([starts - base, ends - base]).reshape(-1)
            runs = np.append(0, np.cumsum(2 * np.bincount(document, minlength=len(sizes))))
            tables.append(
                pa.table(
                    {
                        "doc_id": pa.array(chunk.ids, mask=chunk.null),
                        "n_bytes": sizes,
                        "kept": pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(left)]).cast(pa.binary()),
                        "spans": pa.ListArray.from_arrays(runs.astype(np.int32), spans),
                    },
                    schema=schema,
                )
            )
        return pa.concat_tables(tables)

    return names.cogroup(by_chunk(answers)).applyInArrow(cut, "doc_id long, n_bytes long, kept binary, spans array<long>")

