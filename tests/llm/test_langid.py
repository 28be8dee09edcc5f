"""Language spans against a plain Viterbi walk, word cutting against a plain loop, and edge cases."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hostpulse.llm import langid

WORDS = {
    "en": "the quick brown house with which they thought about nothing weather though should would".split(),
    "de": "der schnelle braune Haus mit welchem sie über nichts Wetter obwohl sollte würde ich zwölf".split(),
    "ru": "быстрый коричневый дом который они думали ничего погода хотя должен бы".split(),
    "uk": "швидкий коричневий будинок який вони думали нічого погода хоча їжак ґанок".split(),
    "el": "γρήγορο καφέ σπίτι που σκέφτηκαν τίποτα καιρός".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, lang_pred string, id long, h int, nth int"


def prose(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, k, "s", "x", 1, 2, 3) for i, t, k in rows], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = [(n * 10 + k, prose(lang, 40, rng), lang) for k, lang in enumerate(WORDS) for n in range(30)]
    rows += [(n * 10, prose("en", 40, rng), "en") for n in range(3)] + [(None, "kkk", "xx"), (5000, None, "yy"), (5001, "12 !", "zz"), (5002, "abc", None)]
    return langid.fit_languages(table(spark, rows))


def plain_viterbi(scores, price):
    """The best value of a path, by trying every change word by word."""
    value = [int(x) for x in scores[0]]
    for row in scores[1:]:
        value = [max(v if j == k else v - price for j, v in enumerate(value)) + int(x) for k, x in enumerate(row)]
    return max(value)


def worth(scores, states, price):
    return sum(int(s[k]) for s, k in zip(scores, states)) - price * int((np.diff(states) != 0).sum())


@pytest.mark.parametrize("k", [1, 2, 5])
def test_viterbi_equals_plain_walk(k):
    rng = np.random.default_rng(k)
    words = np.array([0, 1, langid.CHUNK, langid.CHUNK + 1, 3 * langid.CHUNK - 1, 0, 700, 2, 64 * 5, 0])
    scores = -rng.integers(0, 9, (int(words.sum()), k)).astype(np.int32)
    for price in (0, 3, 12):
        states = langid.viterbi(scores, words, price)
        at = 0
        for n in words.tolist():
            if n:
                assert worth(scores[at : at + n], states[at : at + n], price) == plain_viterbi(scores[at : at + n], price)
            at += n
    assert len(langid.viterbi(np.zeros((0, k), np.int32), np.zeros(2, np.int64), 3)) == 0


def plain_words(text):
    found, script, start = [], None, 0
    for i, c in enumerate(text + " "):
        kind = unicodedata.category(c)[0]
        now = unicodedata.name(c, "OTHER").split()[0].split("-")[0] if kind == "L" else script if kind == "M" else None
        if now != script or (script and i - start == langid.LONGEST_WORD):
            if script:
                found.append((start, i))
            script, start = now, i
    return found


def test_words_equal_plain_loop():
    rng = random.Random(5)
    letters = "abÉñя́жҔ́ 漢かナ1.́\n’한𐍈𝒜"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["x" * 200, "", None, "́", "a" + "́" * 90]
    words = langid.cut(pa.array(texts), langid.Scripts())
    for t, text in enumerate(texts):
        own = words.text == t
        got = list(zip((words.starts[own] - words.offsets[t]).tolist(), (words.ends[own] - words.offsets[t]).tolist()))
        assert got == plain_words(text or ""), text


def test_learned_languages(model):
    assert model.languages == sorted(WORDS)
    assert set(model.candidates) == {"LATIN", "CYRILLIC", "GREEK"}
    assert model.candidates["GREEK"].tolist() == [False, True, False, False, False]


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(9)
    parts = [(lang, prose(lang, 30, rng)) for lang in ("de", "en", "ru", "uk", "el", "de")]
    text = ". ".join(p for _, p in parts)
    row = langid.label_languages(table(spark, [(1, text, None)]), model).first()
    assert [s["lang"] for s in row["lang_spans"]] == [lang for lang, _ in parts]
    at = 0
    for span, (_, part) in zip(row["lang_spans"], parts):
        assert abs(span["start"] - at) <= 12 and abs(span["stop"] - at - len(part)) <= 12
        at += len(part) + 2


def test_edges(spark, model):
    rng = random.Random(8)
    long = prose("de", 60_000, rng) + " " + prose("en", 20_000, rng)
    rows = [(1, None, "en"), (2, "", "en"), (3, " 12 ?!\n", "en"), (4, "漢字", "en"), (5, long, "en"), (None, prose("en", 9, rng), None), (6, "the", "x"), (6, "the", "x")]
    out = langid.label_languages(table(spark, rows), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "id", "h", "nth", "lang_spans", "lang_pred", "lang_score"]
    got = [(r["doc_id"], r["lang_pred"], len(r["lang_spans"])) for r in out.collect()]
    assert got[:3] == [(1, "und", 0), (2, "und", 0), (3, "und", 0)]
    assert got[3] == (4, "de", 1)  # a script of no language: the first in order
    assert got[4] == (5, "de", 2) and got[5] == (None, "en", 1) and got[6] == got[7] == (6, "en", 1)
    assert all(0 <= r["lang_score"] <= 1 for r in out.collect())
    assert langid.label_languages(table(spark, []), model).count() == 0
    nothing = langid.fit_languages(table(spark, []))
    assert [r["lang_pred"] for r in langid.label_languages(table(spark, rows), nothing).collect()] == ["und"] * len(rows)


def test_only_training_rows_are_learned(spark):
    rows = [(1, "aaa", "x"), (2, "bbb", "y")]
    assert langid.fit_languages(table(spark, rows), usable=F.col("doc_id") == 2).languages == ["y"]


def test_held_out_documents(spark, sf_dir):
    from hostpulse.llm.queries import QUERIES

    got = QUERIES["op11_langid"](spark, sf_dir).where("held_out")
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    right, total = got.join(truth, "doc_id").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * total > 0
