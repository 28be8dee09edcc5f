"""Ranked search against plain scoring of every document, and the bounds against the scores."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hostpulse.llm import lexical

SCHEMA = "doc_id long, text string, item_id string, rank int, score long, h long, g long, n long, item int"


def plain_terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_search(rows, items, k):
    counted = [(i, collections.Counter(plain_terms(t))) for i, t in rows]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in set(items):
        scored = []
        for (i, c), size in zip(counted, sizes):
            score = 0
            for t in set(plain_terms(text)) & set(c):
                m = 100 - 90 + (90 * size * n) // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            out.add((item, rank, i, -score))
    return out


def tables(spark, rows, items):
    return (
        spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA),
        spark.createDataFrame([(i, t, 7, 8) for i, t in items], "item_id string, text string, doc_id long, score long"),
    )


RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(60)] + ["É1", "é1", "漢字", "X", "x"]


def prose(n):
    return RNG.choice([" ", "-", ". "]).join(RNG.choice(VOCABULARY[: RNG.randint(1, 65)]) for _ in range(n))


COPY = prose(12)
ROWS = [(i, prose(RNG.randint(0, 40))) for i in range(150)]
ROWS += [(1000 + i, COPY) for i in range(30)] + [(2000 + i, COPY + " " + "zz " * i) for i in range(20)]
ROWS += [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (None, COPY), (6, None), (7, ""), (8, " !"), (9, "w3 " * 50_000 + "rare"), (10, "a" * 300_000)]
ITEMS = [("a", COPY), ("b", "w1 w2 w3 absent"), ("c", None), ("d", ""), ("e", "rare"), ("e", "w9 W10"), ("f", "é1 É1 漢字 x X"), ("g", "a" * 300_000), ("g", "a" * 300_000)]
ITEMS += [(f"i{i}", prose(10)) for i in range(20)] + [(None, "w4")]


@pytest.mark.parametrize(("rounds", "block", "bits"), [((32, 256), 5000, 13), ((10, 13), 20, 3)])
def test_search_equals_plain_scoring(spark, rounds, block, bits):
    got = lexical.search(*tables(spark, ROWS, ITEMS), k=10, rounds=rounds, items_per_block=block, bits=bits).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == plain_search(ROWS, ITEMS, 10)


def test_empty_tables(spark):
    for rows, items in (([], ITEMS), (ROWS[:5], []), (ROWS[:5], [("a", None)]), ([(1, None)], ITEMS)):
        out = lexical.search(*tables(spark, rows, items))
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_terms_equal_plain_terms():
    texts = ["Aé-b_C9", None, "", "x", "y" * 5, "[q]{r}@s`t~\x7fu\x80v", "漢 字Z"]
    hashes, owner = lexical.terms(pa.array(texts))
    want = [(i, t) for i, text in enumerate(texts) for t in plain_terms(text)]
    assert owner.tolist() == [i for i, _ in want]
    assert len(set(hashes.tolist())) == len({t for _, t in want})
    assert lexical.terms(pa.array(["Zé"]))[0] == lexical.terms(pa.array(["--zé"]))[0]


def test_bounds_are_not_below_the_scores():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 2**63, 50).astype(np.uint64) * np.uint64(2))
    asked = lexical.Asked(["a", "b"], hashes, [np.arange(30), np.arange(20, 50)])
    stats = lexical.Statistics(100, 5000, rng.integers(0, 9000, 50))
    places, most = np.zeros(1 << lexical.COORDINATE_BITS, np.uint32), rng.integers(1, 9, 50)
    np.maximum.at(places, (hashes >> np.uint64(64 - lexical.COORDINATE_BITS)).astype(int), most.astype(np.uint32))
    used = np.flatnonzero(places)
    batch = pa.RecordBatch.from_pydict({"n": [77], "places": [used.astype("<u2").tobytes()], "most": [places[used].astype("<u4").tobytes()]})
    bound = lexical.Bounds(asked, stats)(batch)[0]
    value = lexical.impacts(most.astype(np.int64), stats.m(np.array([77]))) * stats.weights
    assert bound[0] >= value[:30].sum() and bound[1] >= value[20:].sum()
