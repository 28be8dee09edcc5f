"""Language spans: scripts narrow the candidates, then Viterbi over word scores with a penalty for switching."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostpulse.llm.common import SpanHash, bounded, code_points, mix, pieces, spans_to_index, staged

#: Labelled rows that a language is learned from, at most this many, chosen by a hash of the id.
ROWS_PER_LANGUAGE = 1000
#: Counters of n-grams per language: 2 to this power.
BUCKET_BITS = 16
GRAMS = (1, 2, 3, 4)
#: Words of one text beyond this many have no more weight in its language's counts than this many.
FULL_WEIGHT = 2000
#: A language is a candidate for a script that has at least this share of its letters.
CANDIDATE_SHARE = 0.01
#: The worst score of a word, the price of switching between two words, and units per natural logarithm.
WORST, SWITCH, UNITS = 8.0, 14.0, 256
#: Longer runs of letters are cut into words of this many.
LONGEST_WORD = 40
#: Distinct words that a task remembers.
MOST_WORDS = 500_000
#: Words that are followed one after the other; what is longer is put together from pieces of this length.
CHUNK = 64
UNKNOWN = "und"

_EDGE = np.uint64(0x2545F4914F6CDD1D)
_NONE, _UNSEEN, _MARK = 0, 1, 2
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("lang", T.StringType())]))


class Scripts:
    """Per code point: the number of its script, and its lower case.  A script is what the letter's name begins with.

    Numbers are given in the order in which scripts are met; ``names`` tells them.  Marks belong to the letter before.
    """

    def __init__(self) -> None:
        self.script = np.full(0x110000, _UNSEEN, np.int16)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.names: list[str] = ["", "", ""]
        self.numbers: dict[str, int] = {}

    def learn(self, points: np.ndarray) -> None:
        new = points[self.script[points] == _UNSEEN]
        for c in np.unique(new).tolist() if len(new) else ():
            kind, low = unicodedata.category(chr(c))[0], chr(c).lower()
            if len(low) == 1:
                self.lower[c] = ord(low)
            if kind == "L":
                name = unicodedata.name(chr(c), "OTHER").split()[0].split("-")[0]
                self.script[c] = self.numbers.setdefault(name, len(self.names))
                if self.numbers[name] == len(self.names):
                    self.names.append(name)
            else:
                self.script[c] = _MARK if kind == "M" else _NONE


@dataclass
class Cut:
    """Words in text order: start and end among all code points, text, script, and the code points in lower case."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    script: np.ndarray
    points: np.ndarray
    offsets: np.ndarray


def cut(texts: pa.Array, scripts: Scripts) -> Cut:
    """Runs of letters of one script, with their marks; very long runs in pieces."""
    points, offsets = code_points(texts)
    n = len(points)
    empty = np.zeros(0, np.int64)
    if n == 0:
        return Cut(empty, empty, empty, empty, points, offsets)
    scripts.learn(points)
    script = scripts.script[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    marks = script == _MARK
    if marks.any():
        # a mark takes the script of what stands before it in its text; alone it is no letter
        last = np.maximum.accumulate(np.where(marks & ~first[:n], 0, np.arange(n)))
        script = np.where(script[last] == _MARK, _NONE, script[last])
    inside = script != _NONE
    joint = np.zeros(n, bool)
    joint[1:] = inside[1:] & (script[1:] == script[:-1]) & ~first[1:n]
    begin = inside & ~joint
    place = np.arange(n)
    run = place - np.maximum.accumulate(np.where(begin, place, 0))
    begin |= inside & (run % LONGEST_WORD == 0)
    starts = np.flatnonzero(begin)
    stops = np.flatnonzero(begin | ~inside | first[:n])
    ends = np.append(stops, n)[np.searchsorted(stops, starts, side="right")]
    return Cut(starts, ends, np.searchsorted(offsets, starts, side="right") - 1, script[starts].astype(np.int64), scripts.lower[points], offsets)


def grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words (edges count as letters) and of the whole words, and the word of each."""
    lengths = ends - starts
    padded = lengths + 2
    at = np.cumsum(padded) - padded
    m = np.full(int(padded.sum()), _EDGE, np.uint64)
    m[spans_to_index(at + 1, lengths)] = mix(points[spans_to_index(starts, lengths)].astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(starts)), padded)
    shift = np.uint64(64 - BUCKET_BITS)
    buckets, owners = [mix(SpanHash(m)(at, at + padded)) >> shift], [np.arange(len(starts))]
    value = np.zeros(len(m), np.uint64)
    for size in range(1, max(GRAMS) + 1):
        if len(m) < size:
            break
        value = mix(value[: len(m) - size + 1] + m[size - 1 :] + np.uint64(size))
        if size in GRAMS:
            whole = owner[: len(value)] == owner[size - 1 :]
            if size == 1:
                whole &= m != _EDGE
            buckets.append(value[whole] >> shift)
            owners.append(owner[: len(value)][whole])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """Languages in order, the logarithms of their n-grams' shares, and which are candidates for a script."""

    languages: list[str]
    shares: np.ndarray
    candidates: dict[str, np.ndarray]

    def scores(self, words: Cut, chosen: np.ndarray, scripts: Scripts) -> np.ndarray:
        """Units per word and language: 0 for the best, at worst minus ``WORST``; languages of other scripts get the worst.

        A word in a script that no language was seen with says nothing.
        """
        bucket, owner = grams(words.points, words.starts[chosen], words.ends[chosen])
        found = np.stack([np.bincount(owner, weights=row[bucket], minlength=len(chosen)) for row in self.shares], axis=1) / 2
        flat = np.ones(len(self.languages), bool)
        known = [self.candidates.get(name, flat) for name in scripts.names]
        found[~np.array(known)[words.script[chosen]]] = -np.inf
        found = np.maximum(found - found.max(axis=1, keepdims=True), -WORST)
        found[np.array([name not in self.candidates for name in scripts.names])[words.script[chosen]]] = 0
        return np.rint(found * UNITS).astype(np.int32)


def viterbi(scores: np.ndarray, words: np.ndarray, price: int) -> np.ndarray:
    """Best state of each word (rows of ``scores``, text by text) when each change of state within a text costs ``price``.

    ``words`` counts the words of each text.  Texts are cut into chunks that are followed side by side: first from every
    state before a chunk to every state at its end, then along the chunks of each text, then inside all chunks again between the two
    states found.  Whole numbers keep this equal to following each text word by word.
    """
    total, k = scores.shape
    if total == 0:
        return np.zeros(0, np.int64)
    far = -(1 << 28)
    chunks = -(-words // CHUNK)
    first = np.cumsum(chunks) - chunks
    count = int(chunks.sum())
    text = np.repeat(np.arange(len(words)), words)
    place = np.arange(total) - np.repeat(np.cumsum(words) - words, words)
    row, col = first[text] + place // CHUNK, place % CHUNK
    grid = np.zeros((CHUNK, k, count), np.int32)
    grid[col, :, row] = scores
    way = np.full((k, k, count), far, np.int32)
    way[np.arange(k), np.arange(k)] = 0
    for step in grid:
        way = np.maximum(way, way.max(axis=1, keepdims=True) - price) + step
    # along the chunks of each text, the longest texts first
    order = np.argsort(-chunks, kind="stable")
    order = order[chunks[order] > 0]
    value = np.zeros((k, len(order)), np.int64)
    before = np.zeros((k, count), np.int64)
    for c in range(int(chunks.max())):
        active = int(np.searchsorted(-chunks[order], -c, side="left"))
        at = first[order[:active]] + c
        before[:, at] = value[:, :active]
        after = (value[:, None, :active] + way[:, :, at]).max(axis=0)
        value[:, :active] = after - after.max(axis=0)
    state = np.zeros(count, np.int64)
    enter = np.zeros(count, np.int64)
    ends = value.argmax(axis=0)
    for c in range(int(chunks.max()) - 1, -1, -1):
        active = int(np.searchsorted(-chunks[order], -c, side="left"))
        at = first[order[:active]] + c
        state[at] = ends[:active]
        ends[:active] = (before[:, at] + way[:, ends[:active], at]).argmax(axis=0)
        enter[at] = ends[:active]
    # inside the chunks; before a text's first word every state costs the same
    value = np.full((k, count), far, np.int32)
    value[enter, np.arange(count)] = 0
    changed = np.zeros((CHUNK, k, count), bool)
    source = np.zeros((CHUNK, count), np.int16)
    for t, step in enumerate(grid):
        source[t] = value.argmax(axis=0)
        top = value.max(axis=0) - price
        changed[t] = top > value
        value = np.maximum(value, top) + step
    out = np.zeros((CHUNK, count), np.int64)
    each = np.arange(count)
    for t in range(CHUNK - 1, -1, -1):
        out[t] = state
        state = np.where(changed[t, state, each], source[t], state)
    return out[col, row]


class Labeller:
    """Labels of whole texts; scores of the words met so far are kept."""

    def __init__(self, model: Model):
        self.model, self.scripts = model, Scripts()
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.int32)

    def word_scores(self, words: Cut) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self.forget()
        hashes = SpanHash(mix(words.points.astype(np.uint64) + np.uint64(1)))(words.starts, words.ends)
        codes, distinct = pd.factorize(hashes)
        where = np.fromiter((self.known.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(where < 0)
        if len(new):
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            where[new] = np.arange(len(self.table), len(self.table) + len(new))
            self.known.update(zip(distinct[new].tolist(), where[new].tolist()))
            self.table = np.concatenate([self.table, self.model.scores(words, first[new], self.scripts)])
        return self.table[where[codes]]

    def __call__(self, texts: pa.Array) -> tuple[Cut, np.ndarray]:
        """Words of the texts and the number of each word's language."""
        words = cut(texts, self.scripts)
        per_text = np.bincount(words.text, minlength=len(texts)).astype(np.int64)
        if not len(words.starts):
            return words, np.zeros(0, np.int64)
        return words, viterbi(self.word_scores(words), per_text, round(SWITCH * UNITS))


def fit_languages(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", usable: Column | None = None, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn every non-null language from the whole texts of at most ``rows_per_language`` rows for which ``usable`` holds.

    The rows are the first by a hash of their id, so each run takes the same; of rows that repeat an id one is taken, null ids and
    null texts are left out.  Only ids and languages are ordered; a language's texts meet in one task, which keeps counters alone.
    """
    ok = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    labelled = docs.where(ok & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    one = staged(ids.groupBy("lang", "id").agg(F.min("h").alias("h")), "labelled-ids")
    rank = F.xxhash64("id")
    # only ranks so low that about twice the rows wanted are below them come together
    low = (F.lit(2.0**64) * (2 * rows_per_language + 100) / F.col("n")) - F.lit(2.0**63)
    rows = one.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    first = one.join(bounded(staged(rows, "languages")), "lang").where(rank.cast("double") <= low)
    by_hash = Window.partitionBy("lang").orderBy(rank, "id")
    chosen = first.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= rows_per_language).select("lang", "id", "h")
    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # the chosen ids are bounded by the languages and the limit above
    picked = texts.join(F.broadcast(chosen), ["lang", "id", "h"]).select("lang", "id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scripts, seen, lang = Scripts(), set(), None
        total, letters = np.zeros(1 << BUCKET_BITS), np.zeros(0)
        for batch in batches:
            for piece in pieces(batch, "text"):
                lang = piece.column("lang")[0].as_py()
                fresh = [i for i, key in enumerate(piece.column("id").to_pylist()) if not (key in seen or seen.add(key))]
                words = cut(piece.column("text").take(pa.array(fresh, pa.int64())), scripts)
                if not len(words.starts):
                    continue
                bucket, owner = grams(words.points, words.starts, words.ends)
                per_text = np.bincount(words.text)
                weight = np.minimum(1.0, FULL_WEIGHT / np.maximum(per_text, 1))[words.text]
                total += np.bincount(bucket, weights=weight[owner], minlength=len(total))
                here = np.bincount(words.script, weights=weight * (words.ends - words.starts), minlength=len(scripts.names))
                letters = np.pad(letters, (0, len(here) - len(letters))) + here
        names = [n for n, x in zip(scripts.names, letters) if x > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([total.tobytes()], pa.binary()), pa.array([names], pa.list_(pa.string())), pa.array([letters[letters > 0].tolist()], pa.list_(pa.float64()))],
            names=["lang", "counts", "scripts", "letters"],
        )

    schema = "lang string, counts binary, scripts array<string>, letters array<double>"
    rows = sorted(picked.groupBy("lang").applyInArrow(count, schema).collect(), key=lambda r: r["lang"])
    rows = [r for r in rows if r["scripts"]]
    shares, candidates = [], {}
    for k, row in enumerate(rows):
        counts = np.frombuffer(row["counts"]) + 0.5
        shares.append(np.log(counts / counts.sum()))
        letters = np.array(row["letters"])
        for name, amount in zip(row["scripts"], letters / letters.sum()):
            if amount >= CANDIDATE_SHARE:
                candidates.setdefault(name, np.zeros(len(rows), bool))[k] = True
    return Model([r["lang"] for r in rows], np.array(shares, np.float32).reshape(len(rows), 1 << BUCKET_BITS), candidates)


def _per_text(words: Cut, state: np.ndarray, texts: int, model: Model) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Spans, main language and its share of the letters, per text."""
    n = len(words.starts)
    k = max(1, len(model.languages))
    letters = np.zeros((texts, k))
    np.add.at(letters, (words.text, state), words.ends - words.starts)
    total = letters.sum(axis=1)
    main = letters.argmax(axis=1)
    new = np.ones(n, bool)
    new[1:] = (words.text[1:] != words.text[:-1]) | (state[1:] != state[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1 if n else first
    base = words.offsets[words.text[first]]
    languages = pa.array([*model.languages, UNKNOWN], pa.string())
    items = pa.StructArray.from_arrays(
        [pa.array(words.starts[first] - base, pa.int32()), pa.array(words.ends[last] - base, pa.int32()), languages.take(pa.array(state[first], pa.int64()))],
        names=["start", "stop", "lang"],
    )
    per_text = np.bincount(words.text[first], minlength=texts)
    spans = pa.ListArray.from_arrays(np.append(0, np.cumsum(per_text)).astype(np.int32), items)
    named = languages.take(pa.array(np.where(total > 0, main, len(model.languages))))
    return spans, named, pa.array(letters[np.arange(texts), main] / np.maximum(total, 1))


def label_languages(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Add ``lang_spans`` (start, stop in code points, lang), ``lang_pred`` and ``lang_score`` to every row.

    Each word (a run of letters of one script) is scored for the languages that use its script; the best path through these scores,
    where a change costs ``SWITCH``, labels the words, and neighbours of one language are one span.  ``lang_pred`` has
    most letters, ``lang_score`` is its share of them (ties: the language first in order).  A null text, one without letters,
    and every text under a model without languages have no spans, ``und`` and 0.  Texts are read whole, however long.  Input
    columns of these three names are replaced, all others stay.
    """
    added = ["lang_spans", "lang_pred", "lang_score"]
    kept = [c for c in docs.columns if c not in added]
    schema = T.StructType(
        docs.select(*kept).schema.fields + [T.StructField("lang_spans", SPANS), T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for piece in pieces(batch, text_col):
                texts = piece.column(text_col)
                words, state = labeller(texts if shared.value.languages else texts.slice(0, 0))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *_per_text(words, state, piece.num_rows, shared.value)], names=[*kept, *added])

    return docs.mapInArrow(run, schema)
