"""Corpus operators against plain Python on small tables, with ties, long texts and adversarial words."""

from __future__ import annotations

import collections
import heapq
import itertools
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hostpulse.llm import bpe, dartminhash, decontaminate, postings, quality, secrets, sharding, shingles, substrings
from hostpulse.llm.common import SpanHash, mix, pieces
from hostpulse.llm.queries import TOKENIZER, training_row
from hostpulse.llm.words import Splitter, WordIds, library_encoder

RNG = random.Random(31)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


# --- hashes

PARITY = "".join("ab"[i.bit_count() & 1] for i in range(1024))
TWIN = PARITY.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("letters", ["ab", "!?"])
def test_words_of_equal_form_are_told_apart(letters):
    table = str.maketrans("ab", letters)
    texts = [PARITY.translate(table), TWIN.translate(table), f"x {(PARITY * 4).translate(table)} y {(TWIN * 4).translate(table)}"]
    library, split = Tokenizer.from_file(TOKENIZER), Splitter(TOKENIZER)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for encode in (WordIds(bpe.Merges(split.config)), WordIds(library_encoder(library))):
        ids, counts = encode(split(batch.column("t")), 3)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_words_that_share_a_hash_are_told_apart():
    split, library = Splitter(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    texts = ["one two three two", "four one two five"]
    words = split(pa.array(texts))
    words.hashes = np.zeros_like(words.hashes)
    ids, counts = WordIds(library_encoder(library))(words, 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_words_share_a_hash():
    """A word with the hash of one remembered from an earlier batch is another word, and memory may be forgotten between."""
    split, library = Splitter(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    known = WordIds(library_encoder(library))
    for text in ("alpha beta", "beta beta gamma", "", "gammas alpha 7", "delta"):
        words = split(pa.array([text, None, text]))
        words.hashes = words.hashes % np.uint64(2)
        ids, counts = known(words, 3)
        want = library.encode(text, add_special_tokens=False).ids
        assert counts.tolist() == [len(want), 0, len(want)] and ids.tolist() == want * 2
    assert known.size <= 2


def test_workers_load_no_more_than_they_need():
    """Plain texts are cut without the library's tables, and ids are spelled from the file alone."""
    library, split = Tokenizer.from_file(TOKENIZER), Splitter(TOKENIZER)
    split(pa.array(["plain words, 12 of them"]))
    assert "library" not in vars(split)
    assert bpe.id_strings(TOKENIZER) == {i: s for s, i in library.get_vocab(with_added_tokens=True).items()}


def test_span_hashes_depend_on_the_span_alone():
    values = mix(np.tile(np.arange(50, dtype=np.uint64) % 7, 400))
    whole = SpanHash(values)
    a, b = np.array([0, 70, 700, 35]), np.array([20, 90, 720, 55])
    assert len(set(whole(a, b).tolist())) == len({tuple(values[i:j]) for i, j in zip(a, b)})
    assert whole(np.array([1400]), np.array([9000]))[0] == SpanHash(values[1400:9000])(np.array([0]), np.array([7600]))[0]


def test_texts_of_equal_form_are_no_copies(spark):
    rows = [(1, f"{PARITY} {TWIN} one two three", "en", "s"), (2, f"{TWIN} {PARITY} one two three", "en", "s")]
    assert len({r["class_id"] for r in dartminhash.near_duplicates(docs(spark, rows)).collect()}) == 2
    cut = substrings.remove_repeats(docs(spark, [(1, PARITY, "en", "s"), (2, TWIN, "en", "s")]))
    left = {r["doc_id"]: len(r["kept"]) for r in cut.collect()}
    starts = {PARITY[i : i + 50] for i in range(1024 - 49)}
    gone = {j for i in range(1024 - 49) if TWIN[i : i + 50] in starts for j in range(i, i + 50)}
    assert left == {1: 1024, 2: 1024 - len(gone)}


# --- near duplicates of texts without spaces


def test_ideographs_and_kana_are_words(spark):
    signs = [chr(0x4E00 + RNG.randrange(3000)) for _ in range(400)] + list("ひらがなカタカナ")
    text = "".join(signs) + "。「終」"
    other = text[:200] + "異" + text[201:]
    words = shingles.Shingler().words(pa.array(["漢字、かな！ abc １２", "😀a"]))
    assert np.bincount(words[1]).tolist() == [6, 1]
    got = dartminhash.near_duplicates(docs(spark, [(1, text, "zh", "s"), (2, other, "zh", "s"), (3, text[::-1], "zh", "s")]))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def plain_similarity(a, b):
    def bag(t):
        words = re.findall(r"\w+", t.lower())
        return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def test_full_buckets_lose_no_link(spark, monkeypatch):
    """Many texts around one template: links found equal all pairs, also where buckets are full."""
    monkeypatch.setattr(dartminhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(dartminhash, "CENSUS_BYTES", 4000)
    vocabulary = [f"w{i}" for i in range(900)]
    template = [RNG.choice(vocabulary) for _ in range(80)]
    texts = []
    for _ in range(90):
        words = list(template)
        for _ in range(RNG.choice([1, 2, 3, 4, 9])):
            words[RNG.randrange(80)] = RNG.choice(vocabulary)
        texts.append(" ".join(words))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if plain_similarity(texts[i], texts[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    got = dartminhash.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {i: root(i) for i in range(len(texts))}


# --- decontamination


def plain_overlap(text, item):
    d, q = (re.findall(r"[^\W_]+", t.lower()) for t in (text or "", item or ""))
    n = len(q)
    if not n:
        return False
    if n < decontaminate.SHORTEST:
        return d == q
    width = min(n, decontaminate.WINDOW)
    allowed = 2 if n >= 13 else 1 if n >= decontaminate.ONE_SUBSTITUTION else 0
    for shift in range(-n + width, len(d) - width + 1):
        agree = [0 <= j + shift < len(d) and d[j + shift] == q[j] for j in range(n)]
        if any(sum(agree[i : i + width]) >= width - allowed for i in range(n - width + 1)):
            return True
    return False


def test_all_windows_of_items(spark):
    vocabulary = [f"t{i}" for i in range(60)]
    words = lambda n: [RNG.choice(vocabulary) for _ in range(n)]
    items = [words(n) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 20, 40) for _ in range(3)]
    rows = []
    for i in range(150):
        item = RNG.choice(items)
        part = list(item)
        for _ in range(RNG.choice([0, 0, 1, 1, 2, 3])):
            part[RNG.randrange(len(part))] = "zzz"
        start = RNG.randrange(max(1, len(part) - 12))
        part = part[start:] if RNG.random() < 0.5 else part
        around = [words(RNG.randint(0, 15)), words(RNG.randint(0, 15))] if RNG.random() < 0.7 else [[], []]
        rows.append((i, " ".join(around[0] + part + around[1]), "en", "s"))
    rows += [(1000, " ".join(words(20_000) + items[-1]), "en", "s"), (1001, None, "en", "s"), (1002, "", "en", "s")]
    bench = [(f"q{k}", " ".join(q)) for k, q in enumerate(items)] + [("null", None), ("empty", " . ")]
    got = decontaminate.overlaps(docs(spark, rows), spark.createDataFrame(bench, "item_id string, text string"))
    want = {(i, name) for i, t, _, _ in rows for name, q in bench if plain_overlap(t, q)}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 60


# --- shards


def plain_differencing(sizes, shards):
    heap = [(-s, n, [0] * (shards - 1) + [s]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = itertools.count(len(sizes))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted(x + y for x, y in zip(a, reversed(b)))
        heapq.heappush(heap, (both[0] - both[-1], next(serial), both))
    return heap[0][2]


@pytest.mark.parametrize("ties", [False, True])
def test_shards_equal_plain_differencing(spark, ties):
    sizes = RNG.sample(range(1, 10_000), 200) if not ties else [7] * 100 + [9] * 50 + [100] * 3
    groups = spark.createDataFrame([(f"{i:04d}", s) for i, s in enumerate(sizes)], "part string, bytes long")
    sums = collections.Counter()
    for r in sharding.balanced_groups(groups, 6).collect():
        sums[r["shard"]] += r["bytes"]
    assert sorted(sums.values()) == plain_differencing(sizes, 6)


# --- classifier


def plain_features(features, text):
    m = lambda c: int(mix(np.array([ord(c) + 11], np.uint64))[0])
    f = [int(x) for x in features.factors]
    mask = (1 << 64) - 1

    def bucket(x):
        x &= mask
        x = (x ^ (x >> 29)) * f[7] & mask
        return x >> int(features.shift)

    words, out = [w for w in re.split(f"[{re.escape(''.join(map(chr, quality._WHITE.tolist())))}]+", text) if w], []
    for w in words:
        for size in quality.GRAMS:
            for i in range(len(w) - size + 1):
                value = sum(m(w[i + j]) * f[j] for j in range(size)) + (f[5] if i == 0 else 0) + (f[6] if i + size == len(w) else 0)
                out.append(bucket(value))
    hashed = [int(SpanHash(mix(np.array([ord(c) for c in w], np.uint64) + np.uint64(11)))(np.array([0]), np.array([len(w)]))[0]) for w in words]
    out += [bucket(h) for h in hashed]
    out += [bucket(a * f[1] + b * f[2]) for a, b in zip(hashed, hashed[1:])]
    return out


def test_scores_equal_plain_scores(spark):
    rows = [(i, " ".join(RNG.choice(["good", "fine", "text", "é𝒜x", "bad"]) for _ in range(20)), "en", "s") for i in range(30)] + [(30, "a", "en", "s"), (31, None, "en", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = quality.fit_quality(docs(spark, rows), labels)
    margin, base = model.margins()
    features = quality.Features()
    for r in quality.score_quality(docs(spark, rows), model).collect():
        found = plain_features(features, r["text"] or "")
        odds = base + (sum(margin[b] for b in found) / len(found) if found else 0)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)


def test_held_out_rows_of_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(table, labels, usable=training_row())
    held = quality.score_quality(table.select("doc_id", "text"), model).join(labels.where(~training_row()), "doc_id")
    right, total = held.agg(F.sum(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int")), F.count("*")).first()
    assert total > 50 and right >= 0.85 * total


def test_a_repeated_id_is_learned_once(spark):
    rows = [(1, f"good {i}", "en", "s") for i in range(50)] + [(2, "bad", "en", "s")]
    model = quality.fit_quality(docs(spark, rows), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert np.isfinite(model.vectors).all()


def test_bags_come_back_from_the_shelf_and_give_the_same_model():
    texts = [" ".join(RNG.choice(["good", "fine", "text", "bad"]) for _ in range(RNG.randrange(30))) for _ in range(40)] + ["", None]
    rows, shelf = list(quality.bags(quality.Features(), pa.array(texts, pa.string()))), quality.Shelf()
    for bag in rows:
        shelf.add(*bag)
    assert len(shelf) == len(rows) == len(texts)
    assert all((a == c).all() and (b == d).all() and c.dtype == a.dtype and d.dtype == b.dtype for (a, b), (c, d) in zip(rows, shelf))
    labels = np.array([i % 2 for i in range(len(texts))], np.int64)
    assert quality.train(rows, labels).dumps() == quality.train(shelf, labels).dumps()


def test_fitting_does_not_hold_the_bags_of_all_texts():
    def batches(n):
        for i in range(n):
            text = " ".join(f"{RNG.getrandbits(40):x}" for _ in range(4000))
            yield pa.RecordBatch.from_pydict({"text": [text], "label": [i % 2]})

    peaks = []
    for n in (4, 80):  # a bag of these texts has about 1 MB
        tracemalloc.start()
        assert len(list(quality._learned(batches(n)))) == 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + (10 << 20)


# --- secrets


def plain_spans(text):
    kinds = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    ]
    base = []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        base += [(m.start(), rank, kind, m.end(), m[group]) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    more = [
        (m.start(), 3, "mixed", m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9_+/-]{24,}", text)
        if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")) and not any(b[0] < m.end() and m.start() < b[3] for b in base)
    ]
    return sorted(base), more


def token(n, letters):
    return "".join(RNG.choice(letters) for _ in range(n))


def test_ownership_and_masking(spark):
    letters = "abcdefABCDEF0123456789_+"
    shared = [token(30, letters) + "aA1" for _ in range(6)] + ["AKIA" + token(16, "ABC123"), token(20, "abc123"), 'password = "' + token(14, letters) + '"']
    rows = []
    for i in range(60):
        parts = [RNG.choice(["é", "x = ", "token:", "😀 ", "\n", "AKIA"]) + RNG.choice([*shared, token(25, letters) + "aA1", token(17, "0123abc"), "short"]) for _ in range(RNG.randint(0, 12))]
        rows.append((i if i % 20 else None, " ".join(parts), "en", RNG.choice(["a", "b", None])))
    rows += [(7, None, "en", "a"), (8, "", "en", "a"), *[rows[3]] * 2]
    owners, repositories = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, lang, source in rows:
        for s in itertools.chain(*plain_spans(text or "")):
            owners[s[4]].add(source)
            repositories[s[4]].add((source, lang))
    live = {v for v in owners if len(owners[v]) <= 1 and len(repositories[v]) <= 3}
    got = collections.Counter()
    for r in secrets.scan_secrets(docs(spark, rows)).collect():
        spans = lambda c: tuple((s["start"], s["rank"], s["kind"], s["stop"], s["value"]) for s in r[c])
        got[r["doc_id"], spans("base"), spans("added"), spans("live")] += 1
    want, masks = collections.Counter(), collections.Counter()
    for i, text, _, _ in rows:
        base, more = plain_spans(text or "")
        added = [m for m in more if m[4] in live]
        want[i, tuple(base), tuple(added), tuple(sorted([b for b in base if b[4] in live] + added))] += 1
        out, at = "", 0
        for start, _, _, stop, _ in sorted(base + added):
            if start >= at:
                out += (text or "")[at:start] + "[secret]"
            at = max(at, stop)
        masks[i, None if text is None else out + text[at:]] += 1
    assert got == want and any(k[2] for k in want)
    assert collections.Counter((r["doc_id"], r["text"]) for r in secrets.mask_secrets(docs(spark, rows)).collect()) == masks


def test_work_grows_with_the_matches_of_a_text(spark):
    text = " ".join("é" + token(16, "0123456789abcdef") for _ in range(100_000))
    table = docs(spark, [(1, text, "en", "s")])
    began = time.time()
    found = secrets.scan_secrets(table).select(F.size("base").alias("n"), F.element_at("base", -1)["stop"].alias("end")).first()
    masked = secrets.mask_secrets(table).first()["text"]
    assert tuple(found) == (100_000, len(text)) and masked == re.sub("[0-9a-f]{16}", "[secret]", text)
    assert time.time() - began < 120


# --- nearest vectors


def test_ties_go_to_the_smallest_ids(spark):
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, math.cos(i), math.sin(i)]) for i in range(1, 400)]
    table = spark.createDataFrame([(i, v) for i, v in RNG.sample(rows, len(rows))], "vec_id long, embedding array<double>")
    got = postings.nearest_vectors(table, k=20, is_query=F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(i, i, 1.0) for i in range(1, 21)]


def test_each_length_is_searched(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(10)] + [(200, [5.0]), (201, []), (202, [float("nan"), 1.0]), (203, [0.0, 0.0])]
    got = postings.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    plain = {i: v for i, v in rows if v and all(map(math.isfinite, v)) and any(v)}
    for i, v in plain.items():
        other = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in plain.items() if j != i and len(w) == len(v))[:3]
        assert found[i] == [(j, -s) for s, j in other]
    assert set(found) <= set(plain)


def test_full_lists_are_cut_again(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    data = centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = postings.nearest_vectors(table, k=10, is_query=F.col("vec_id") % 20 == 0, list_vectors=32, most_lists=5).collect()
    product = data[::20] @ data.T
    product[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-product, axis=1)[:, :10]
    found = collections.defaultdict(set)
    for r in got:
        found[r["query_id"]].add(r["vec_id"])
    assert all(len(found[q * 20]) == 10 for q in range(150))
    assert np.mean([len(found[q * 20] & set(b.tolist())) / 10 for q, b in enumerate(best)]) >= 0.9


def test_the_smallest_digests_are_chosen(spark):
    rows = [(f"{hash((i, 1)) & (1 << 64) - 1:016x}" + "0" * 48, [float(i), 1.0]) for i in range(300)]
    table = spark.createDataFrame(rows, "entry string, v array<double>")
    want = [v for _, v in sorted(rows)[:20]]
    for total in (300, 10, 10**9):  # the last one's bound leaves none
        assert postings._first_by_digest(table, total, 20).tolist() == want


def test_runs_of_queries_find_what_one_run_finds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(1500, 8)).astype(np.float32)
    data[700:720] = data[700]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    single = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    double = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = []
    for table, size in ((single, postings.QUERY_BYTES), (double, 10_000)):
        monkeypatch.setattr(postings, "QUERY_BYTES", size)
        got = postings.nearest_vectors(table, k=4, is_query=F.col("vec_id") % 20 == 0, list_vectors=32, most_lists=5).collect()
        found.append(sorted(tuple(r) for r in got))
    assert len(found[0]) == 75 * 4 and found[0] == found[1]
    for q, _, i, score in found[0]:
        assert score == (data[q].astype(float) * data[i].astype(float)).sum()
