"""Memory and work of array code that runs in workers, measured on small inputs of its own."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyarrow import fs

from hostpulse.llm import postings, simple8b, substrings


def peak_of(work):
    """What the work returns, and the most bytes that it held at once."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        out = work()
        return out, tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def chunk_file(tmp_path_factory):
    """A chunk of 400 random documents, empty ones among them."""
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(0, 10_000, 400) * (np.arange(400) % 7 > 0)]
    batch = pa.RecordBatch.from_pydict({"doc_id": np.arange(400), "text": texts})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    path = tmp_path_factory.mktemp("chunks") / "a.chunk"
    path.write_bytes(zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes()))
    return str(path), texts


def test_a_chunk_is_read_and_ranged_in_few_bytes_per_byte(chunk_file):
    path, texts = chunk_file

    def work():
        chunk = substrings.Chunk(fs.LocalFileSystem(), path, 50, 20)
        head, _, _ = chunk.contexts()
        return chunk, substrings._buckets(chunk, head, np.array([b"g" * 20, b"n" * 20]), 20, np.zeros(0, np.uint64))

    (chunk, bucket), peak = peak_of(work)
    assert set(bucket.tolist()) == {0, 1, 2}
    assert peak < 14 * sum(map(len, texts))


@pytest.mark.parametrize("share", [0, 0.02, 0.5, 1])
def test_removed_runs(chunk_file, share):
    path, texts = chunk_file
    chunk = substrings.Chunk(fs.LocalFileSystem(), path, 50, 20)
    f = chunk.found
    rng = np.random.default_rng(5)
    whole = rng.random(len(f.place)) < share
    # some windows of other anchors, by the bytes before the gram
    bits = np.zeros(len(f.place), np.uint32)
    windows = []
    for i in rng.integers(0, len(f.place), 200 if share else 0).tolist():
        start = int(rng.integers(f.first[i], f.last[i] + 1))
        bits[i] |= np.uint32(1 << (int(f.place[i]) - start))
        windows.append(start)
    (document, starts, ends), peak = peak_of(lambda: substrings._removed(chunk, whole, bits, 50, 20))
    left, more = peak_of(lambda: substrings._outside(len(chunk.body), starts, ends))
    assert max(peak, more) < 14 * sum(map(len, texts))
    gone = np.zeros(len(chunk.body), bool)
    for i in np.flatnonzero(whole).tolist():
        gone[f.first[i] : f.last[i] + 50] = True
    for start in windows:
        gone[start : start + 50] = True
    assert (left == ~gone).all()
    runs = []
    for d in range(len(texts)):
        mine = np.flatnonzero(np.diff(np.concatenate([[0], gone[chunk.offsets[d] : chunk.offsets[d + 1]], [0]])))
        runs += [(d, a + int(chunk.offsets[d]), b + int(chunk.offsets[d])) for a, b in zip(mine[::2].tolist(), mine[1::2].tolist())]
    assert list(zip(document.tolist(), starts.tolist(), ends.tolist())) == runs


def greedy(values, block):
    """Words of the packed values, one by one."""
    words, starts = [], []
    for at in range(0, len(values), block):
        rest = [int(v) for v in values[at : at + block]]
        starts.append(len(words))
        while rest:
            fits = [k for k, (c, b) in enumerate(simple8b.SELECTORS, 1) if all(v < 1 << b for v in rest[:c])]
            if not fits:
                words += [0, rest.pop(0)]
                continue
            c, b = simple8b.SELECTORS[fits[-1] - 1]
            words.append((fits[-1] << 60) | sum(v << (j * b) for j, v in enumerate(rest[:c])))
            del rest[:c]
    return words, starts


@pytest.mark.parametrize("block", [1, 7, 256])
def test_packing_is_greedy(block):
    rng = np.random.default_rng(block)
    for n in (1, 255, 256, 257, 900):
        bits = rng.integers(0, 65, n) if n % 2 else rng.integers(0, 17, n) * (rng.random(n) < 0.2)
        values = np.array([int(rng.integers(0, 1 << 62)) * 5 % (1 << int(b)) for b in bits], np.uint64)
        words, starts = simple8b.pack(values, block)
        assert (words.tolist(), starts.tolist()) == greedy(values, block)


def test_packing_token_ids_costs_less_than_sorting_them():
    ids = (49_000 * np.random.default_rng(3).random(94_000) ** 6).astype(np.uint64)

    def least(work):
        took = []
        for _ in range(15):
            began = time.thread_time()
            work()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: simple8b.pack(ids)) < least(lambda: np.argsort(ids, kind="stable"))


def unit(rng, rows, columns):
    points = rng.normal(size=(rows, columns))
    return points / np.linalg.norm(points, axis=1)[:, None]


def test_a_walk_that_sees_all_centroids_holds_few_bytes():
    rng = np.random.default_rng(12)
    centroids, n = unit(rng, 3000, 64), 512
    links = np.hstack([rng.integers(0, 3000, (3000, 20)), ((np.arange(3000) + 1) % 3000)[:, None]])
    index = postings.Index(centroids, links, np.arange(8), 1.0, 1.35, 1.0)
    points = unit(rng, n, 64)
    reads, held = peak_of(lambda: index.search(points, np.full(3000, 300), 63))
    assert held < 160 << 20  # more than 1 GB as gaps of all pairs at once
    far = postings._distances(points, centroids)
    want = far <= index.bound(far.min(axis=1))[:, None]
    assert 0.3 < want.mean() < 0.9 and (reads == want).mean() > 0.999
    few = index.search(points[:2], np.full(3000, 1), 2500)
    assert few.sum(axis=1).min() >= 2500


def test_fitting_an_index_of_many_lists_holds_few_bytes():
    sample = unit(np.random.default_rng(13), 8000, 16)
    index, held = peak_of(lambda: postings.fit_index(sample, 2000 * 256, longest=1.0, neighbours=20))
    assert index.centroids.shape == (2000, 17) and 1 < index.ratio < 3
    assert held < 120 << 20  # a matrix of all points and lists alone has 122 MB


def test_lists_of_points_are_the_nearest_in_order():
    rng = np.random.default_rng(14)
    far = rng.integers(0, 9, (300, 40)).astype(float)
    assert (postings._smallest(far, 3) == np.argsort(far, axis=1, kind="stable")[:, :3]).all()
    far[3] = np.inf
    assert (postings._smallest(far, 3) == np.argsort(far, axis=1, kind="stable")[:, :3]).all()
    assert postings._smallest(far[:, :2], 3).shape == (300, 2)


@pytest.mark.parametrize("scale", ["even", "uneven", "beyond single precision", "steps"])
def test_compared_blocks_are_the_exact_nearest(scale):
    rng = np.random.default_rng(15)
    queries, vectors = unit(rng, 70, 12), unit(rng, 900, 12)
    if scale == "uneven":
        queries, vectors = queries * 10.0 ** rng.integers(-20, 20, (70, 1)), vectors * 10.0 ** rng.integers(-9, 3, (900, 1))
    elif scale == "beyond single precision":
        queries, vectors = queries * 1e-120, vectors * 1e110
    elif scale == "steps":  # many equal products
        queries, vectors = rng.integers(-1, 2, (70, 12)) + 0.0, rng.integers(-1, 2, (900, 12)) + 0.0
        queries[:, 0], vectors[:, 0] = 1, 1
    lows, nums = rng.permutation(900), np.arange(900) + 5
    nearest = postings.Nearest(queries, 6)
    for _ in range(2):  # vectors are in several lists
        for i in range(0, 900, 60):
            readers = np.flatnonzero((np.arange(70) + i // 60) % 5 > 0)
            nearest.look(readers, vectors[i : i + 60], lows[i : i + 60], nums[i : i + 60])
            if i % 180 == 0:
                nearest.sort()
    nearest.sort()
    for q in range(70):
        read = np.flatnonzero((q + np.arange(900) // 60) % 5 > 0)
        score = (queries[q][None, :] * vectors[read]).sum(axis=1)
        best = np.lexsort((lows[read], -score))[:6]
        assert nearest.nums[q].tolist() == nums[read[best]].tolist()
        assert nearest.scores[q].tolist() == score[best].tolist()


def test_many_queries_and_a_large_block_hold_few_bytes():
    rng = np.random.default_rng(16)
    nearest, vectors = postings.Nearest(unit(rng, 20_000, 16), 21), unit(rng, 2048, 16)
    _, held = peak_of(lambda: (nearest.look(np.arange(20_000), vectors, np.arange(2048), np.arange(2048)), nearest.sort()))
    assert held < 200 << 20  # the products alone have 328 MB
    product = nearest.queries[:50] @ vectors.T
    assert (nearest.nums[:50] == np.argsort(-product, axis=1)[:, :21]).all()


def test_readers_of_a_list_are_told_as_bits():
    reads = np.random.default_rng(17).random((1300, 5)) < 0.01
    reads[:, 3] = False
    subs, starts, bits = postings._told(reads, 1024)
    for sub in set(subs.tolist()):
        mine = [i for i, x in enumerate(subs.tolist()) if x == sub]
        assert (postings._readers(np.array([starts[i] for i in mine]), [bits[i] for i in mine]) == np.flatnonzero(reads[:, sub]) + 1024).all()
    assert set(subs.tolist()) == set(np.flatnonzero(reads.any(axis=0)).tolist())
