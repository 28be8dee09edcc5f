"""The filter audit against plain simulation of every order, row by row."""

from __future__ import annotations

import math
import re
from itertools import permutations

import pytest

from hostpulse.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, part string, mask int, n int, id long, digest string, quality int"
LABELS = "doc_id long, quality int, toxic int, text string"
LONG = " ".join(f"w{i}" for i in range(60))


def fails(text, smaller):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    out = {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", t) else set()
    return out | ({"E"} if smaller else set())


def simulated(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failing = []
    for i, t, s in rows:
        smaller = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        failing.append((i, s or "", fails(t, smaller)))
    out = {}
    for part in {p for _, p, _ in failing}:
        own = [(i, f) for i, p, f in failing if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                kept = [(i, f) for i, f in left if c not in f]
                redundant = sum(c in f for _, f in own) - len(gone)
                unique = sum(f == {c} for _, f in own)
                lost = [sum(i in which for i, _ in gone) for which in (good, toxic)]
                out[part, "".join(order), step] = [len(kept), len(gone), redundant, unique, *lost]
                shapley[c] += len(gone)
                left = kept
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (4, None, "b"), (5, "", None), (6, "x " * 80, "a"), (7, LONG.upper(), "a"),
    (8, LONG + " 5%", ""), (9, LONG.upper() + " $", "a"), (None, LONG, "a"), (None, None, None), (10, "A É\x1f B", "b"), (10, "word", "b"),
    (0, LONG + " 5%", "a"), (11, "é" * 70000 + " " + LONG, "a"), (12, "\x0b\x0c\x0d", "b"),
]
MARKED = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, None), (7, None, 1), (9, 0, 1), (None, 1, 1), (99, 1, 1), (8, 1, 0)]


def result(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "x", 1, 2, 3, "d", 1) for i, t, s in rows], SCHEMA)
    marked = spark.createDataFrame([(*x, "t") for x in labels], LABELS)
    return filter_audit.audit_documents(docs, marked)


@pytest.mark.parametrize("labels", [MARKED, []])
def test_audit_equals_simulation(spark, labels):
    got = result(spark, ROWS, labels).collect()
    want = simulated(ROWS, labels)
    assert len(got) == len(want) == 3 * 120 * 5
    for r in got:
        assert list(r)[3:] == want[r["part"], r["filter_order"], r["step"]], r


def test_empty_table(spark):
    assert result(spark, [], MARKED).count() == 0


def test_path_counts():
    forward, backward = filter_audit.paths(4)
    assert forward == [math.factorial(s.bit_count()) for s in range(16)]
    assert backward == [math.factorial(4 - s.bit_count()) for s in range(16)]


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "ab")], "doc_id long, text string")
    failed = filter_audit.failures(
        docs, spark.createDataFrame([], LABELS), {"x": docs.text.contains("a"), "y": docs.text.contains("b")}, part=docs.doc_id % 1
    )
    rows = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in filter_audit.audit(failed, "xy").collect()}
    assert rows == {("xy", 1): (1, 2, 3), ("xy", 2): (0, 1, 3), ("yx", 1): (1, 2, 3), ("yx", 2): (0, 1, 3)}
