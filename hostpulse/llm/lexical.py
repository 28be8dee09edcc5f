"""Ranked lexical search: hashed max-sketches bound every score, exact rescoring goes down the bounds to a threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.llm.common import SpanHash, bounded, flat, mix, pieces, splits, staged

#: Coordinates of a sketch: 2 to this power (at most 16).
COORDINATE_BITS = 13
#: Texts per item that are scored to get a first threshold, then those with the next highest bounds, then all that are left.
ROUNDS = (32, 256)
#: Items whose terms are sent to the tasks at once; more are searched block after block.
ITEMS_PER_BLOCK = 5_000
#: Sketches that are looked up together.
BATCH = 1024

_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Term bytes: digits, letters, and all of code points beyond ASCII.
_INSIDE = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _INSIDE[_low : _high + 1] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, with repeats, and the text of each."""
    body, offsets = flat(texts)
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _INSIDE[body]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = SpanHash(_BYTES[_LOWER[body]])(starts, ends)
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def _runs(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of the runs of equal keys, in ``order``."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def frequencies(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms per text: hash, text, and how often the term occurs there."""
    at, count = _runs(np.lexsort((hashes, text)), hashes, text)
    return hashes[at], text[at], count


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds per unit of its weight; it grows with ``tf``, so the largest ``tf`` has the largest impact."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Asked:
    """Items of a block: their ids, the hashes of all their terms in order, and per item the numbers of its terms."""

    ids: list
    terms: np.ndarray
    of_item: list[np.ndarray]
    bits: int = COORDINATE_BITS

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The coordinate of each term."""
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where no item asks for it."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


@dataclass
class Statistics:
    """Documents with a term, all their terms, and the weight of each asked term."""

    documents: int
    length: int
    weights: np.ndarray

    def m(self, n: np.ndarray) -> np.ndarray:
        return np.array([10 + 90 * x * self.documents // max(1, self.length) for x in n.tolist()], np.int64)


def _asked(items: DataFrame, bits: int) -> Asked:
    rows = items.collect()  # at most about ITEMS_PER_BLOCK rows, see ``search``
    hashes, owner = terms(pa.array([r["text"] for r in rows], pa.string()))
    distinct, number = np.unique(hashes, return_inverse=True)
    of_item = [np.unique(number[owner == i]) for i in range(len(rows))]
    return Asked([r["item_id"] for r in rows], distinct, of_item, bits)


def index_documents(docs: DataFrame, asked: Asked, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, two hashes of the text, number of terms, its sketch, and which of the ``asked`` terms it holds.

    The sketch is sparse: every coordinate that a term's hash falls on, and the largest frequency of the terms there, which
    stands for the largest impact whatever the corpus statistics will be.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(asked)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = piece.num_rows
                hashes, owner, tf = frequencies(*terms(piece.column("text")))
                n = np.bincount(owner, weights=tf, minlength=texts).astype(np.int64)
                place = shared.value.places(hashes)
                order = np.lexsort((-tf, place, owner))
                at, _ = _runs(order, place, owner)
                edges = np.append(0, np.cumsum(np.bincount(owner[at], minlength=texts)))
                places, most = place[at].astype("<u2"), tf[at].astype("<u4")
                number = shared.value.found(hashes)
                mine = np.flatnonzero(number >= 0)
                held = np.append(0, np.cumsum(np.bincount(owner[mine], minlength=texts))).astype(np.int32)
                cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("h"), piece.column("g"), pa.array(n), cut(places), cut(most), pa.ListArray.from_arrays(held, pa.array(number[mine].astype(np.int32)))],
                    names=["doc_id", "h", "g", "n", "places", "most", "held"],
                )

    schema = "doc_id long, h long, g long, n long, places binary, most binary, held array<int>"
    return staged(rows.mapInArrow(run, schema), "sketches")


def statistics(index: DataFrame, asked: Asked) -> Statistics:
    """Counts over all documents; of the asked terms each task sends one sum."""
    size = len(asked.terms)
    total = index.where("n > 0").agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("held").flatten().to_numpy(zero_copy_only=False), minlength=size)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for row in index.select("held").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]  # at most one row per asked term
    n = total["N"]
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()]
    return Statistics(n, total["L"], np.array(weights, np.int64))


class Bounds:
    """Upper bounds of the scores of a batch of sketches for all items, by one matrix product.

    A row of the matrix has the impacts at the coordinates of asked terms, a column of the other one the item's weights there.
    """

    def __init__(self, asked: Asked, stats: Statistics):
        place = asked.places(asked.terms)
        used, column = np.unique(place, return_inverse=True)
        self.column = np.full(1 << asked.bits, -1)
        self.column[used] = np.arange(len(used))
        self.weights = np.zeros((len(used), len(asked.ids)))
        for i, mine in enumerate(asked.of_item):
            np.add.at(self.weights, (column[mine], i), stats.weights[mine])
        self.stats = stats

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        body, offsets = flat(batch.column("places"))
        place = np.ascontiguousarray(body).view("<u2").astype(np.int64)
        most = np.ascontiguousarray(flat(batch.column("most"))[0]).view("<u4").astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 2)
        column = self.column[place]
        use = np.flatnonzero(column >= 0)
        m = self.stats.m(batch.column("n").to_numpy())
        sketch = np.zeros((batch.num_rows, len(self.weights)))
        sketch[owner[use], column[use]] = impacts(most[use], m[owner[use]])
        # sums beyond 2^53 are rounded; a bound may be too high, never too low
        return np.ceil((sketch @ self.weights) * (1 + 1e-12)).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without texts that repeat within one."""
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH):
            part = whole.slice(start, BATCH)
            key = np.rec.fromarrays([part.column("h").to_numpy(), part.column("g").to_numpy()])
            _, at = np.unique(key, return_index=True)
            yield part.take(pa.array(np.sort(at)))


PAIR = "item int, h long, g long, doc_id long, bound long"


def _pairs(batch: pa.RecordBatch, row: np.ndarray, item: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(item.astype(np.int32)), *(batch.column(c).take(at) for c in ("h", "g", "doc_id")), pa.array(bound)], names=["item", "h", "g", "doc_id", "bound"]
    )


def highest_bounds(index: DataFrame, asked: Asked, stats: Statistics, most: int) -> DataFrame:
    """Per item the ``most`` different texts of highest bound in all; each task sends as many of its own."""
    shared = index.sparkSession.sparkContext.broadcast((asked, stats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(*shared.value)
        items = len(shared.value[0].ids)
        best = None
        for batch in _batches(batches):
            if best is not None:
                fresh = ~np.isin(batch.column("h").to_numpy(), best.column("h").to_numpy())
                batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            value = bounds(batch)
            take = min(most, len(value))
            top = np.argpartition(-value, take - 1, axis=0)[:take].T.reshape(-1)
            item = np.repeat(np.arange(items), take)
            found = _pairs(batch, top, item, value[top, item])
            found = found.filter(pa.array(found.column("bound").to_numpy() > 0))
            if best is not None:
                found = pa.Table.from_batches([best, found]).combine_chunks().to_batches()
                found = found[0] if found else best
            order = np.lexsort((-found.column("bound").to_numpy(), found.column("item").to_numpy()))
            of = found.column("item").to_numpy()[order]
            nth = np.arange(len(of)) - np.searchsorted(of, of, side="left")
            best = found.take(pa.array(order[nth < most]))
        if best is not None:
            yield best

    found = index.where("n > 0").select("doc_id", "h", "g", "n", "places", "most").mapInArrow(run, PAIR)
    one = found.groupBy("item", "h", "g").agg(F.min("doc_id").alias("doc_id"), F.max("bound").alias("bound"))
    return one.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "h", "g"))).where(F.col("nth") <= most).drop("nth")


def reaching(index: DataFrame, asked: Asked, stats: Statistics, threshold: np.ndarray) -> DataFrame:
    """All pairs of an item and a text whose bound reaches the item's threshold; each text once."""
    shared = index.sparkSession.sparkContext.broadcast((asked, stats, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, stats, threshold = shared.value
        bounds = Bounds(asked, stats)
        for batch in _batches(batches):
            value = bounds(batch)
            row, item = np.nonzero(value >= threshold[None])
            yield _pairs(batch, row, item, value[row, item])

    found = index.where("n > 0").select("doc_id", "h", "g", "n", "places", "most").mapInArrow(run, PAIR)
    return found.groupBy("item", "h", "g").agg(F.min("doc_id").alias("doc_id"), F.max("bound").alias("bound"))


def rescored(pairs: DataFrame, docs: DataFrame, asked: Asked, stats: Statistics, *, text_col: str, id_col: str) -> DataFrame:
    """Exact scores of pairs, from the whole texts: ``item``, ``h``, ``g``, ``score``; each text is read once."""
    shared = docs.sparkSession.sparkContext.broadcast((asked, stats))
    wanted = pairs.groupBy(F.col("h").alias("w_h"), F.col("g").alias("w_g")).agg(F.min("doc_id").alias("w_id"), F.collect_set("item").alias("items"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    same = rows["id"].eqNullSafe(F.col("w_id")) & (F.xxhash64("text") == F.col("w_h")) & (F.xxhash64(F.lit(1), F.col("text")) == F.col("w_g"))
    read = rows.join(bounded(staged(wanted, "wanted-texts")), same).select(F.col("w_h").alias("h"), F.col("w_g").alias("g"), "items", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, stats = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = piece.num_rows
                hashes, owner, tf = frequencies(*terms(piece.column("text")))
                m = stats.m(np.bincount(owner, weights=tf, minlength=texts).astype(np.int64))
                number = asked.found(hashes)
                mine = np.flatnonzero(number >= 0)
                edges = np.searchsorted(owner[mine], np.arange(texts + 1))
                value = impacts(tf[mine], m[owner[mine]]) * stats.weights[number[mine]]
                row, item, score = [], [], []
                gain = np.zeros(len(asked.terms), np.int64)
                for r, items in enumerate(piece.column("items").to_pylist()):
                    here = slice(edges[r], edges[r + 1])
                    gain[number[mine][here]] = value[here]
                    row += [r] * len(items)
                    item += items
                    score += [int(gain[asked.of_item[i]].sum()) for i in items]
                    gain[number[mine][here]] = 0
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.int32()), piece.column("h").take(at), piece.column("g").take(at), pa.array(score, pa.int64())], names=["item", "h", "g", "score"]
                )

    # rows that repeat an id and its text give the same score
    return staged(read.mapInArrow(run, "item int, h long, g long, score long").distinct(), "exact-scores")


def _search_block(docs: DataFrame, items: DataFrame, k: int, rounds: Sequence[int], bits: int, *, text_col: str, id_col: str) -> DataFrame | None:
    asked = _asked(items, bits)
    if not len(asked.terms):
        return None
    index = index_documents(docs, asked, text_col=text_col, id_col=id_col)
    stats = statistics(index, asked)
    exact = rescored(staged(highest_bounds(index, asked, stats, max(k, rounds[0])), "highest-bounds"), docs, asked, stats, text_col=text_col, id_col=id_col)

    def thresholds() -> np.ndarray:
        by_score = Window.partitionBy("item").orderBy(F.desc("score"))
        kth = exact.where("score > 0").withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k).where(F.col("nth") >= k)
        out = np.ones(len(asked.ids), np.int64)
        for row in kth.collect():  # at most one row per item of the block
            out[row["item"]] = row["score"]
        return out

    level = thresholds()
    left = staged(reaching(index, asked, stats, level).join(exact.select("item", "h", "g"), ["item", "h", "g"], "left_anti"), "open-pairs")
    for most in (*rounds[1:], None):
        if left.isEmpty():
            break
        now = left
        if most is not None:
            by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "h", "g")
            now = staged(left.withColumn("nth", F.row_number().over(by_bound)).where(F.col("nth") <= most).drop("nth"), "next-bounds")
        exact = exact.union(rescored(now, docs, asked, stats, text_col=text_col, id_col=id_col))
        if most is not None:
            level = F.create_map(*(F.lit(int(x)) for kv in enumerate(thresholds()) for x in kv))
            rest = left.join(now.select("item", "h", "g"), ["item", "h", "g"], "left_anti")
            left = staged(rest.where(F.col("bound") >= F.element_at(level, F.col("item"))), "open-pairs")
    names = docs.sparkSession.createDataFrame(list(enumerate(asked.ids)), items.select(F.lit(0).alias("item"), "item_id").schema)
    exact = exact.where("score > 0")
    of_text = Window.partitionBy("h", "g").orderBy(F.col("doc_id").asc_nulls_last())
    # of copies of a text no more than k can be among the k best
    copies = index.join(bounded(staged(exact.select("h", "g").distinct(), "scored-texts")), ["h", "g"], "left_semi").select("h", "g", "doc_id")
    copies = copies.withColumn("nth", F.row_number().over(of_text)).where(F.col("nth") <= k).drop("nth")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = exact.join(copies, ["h", "g"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 10,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rounds: Sequence[int] = ROUNDS,
    items_per_block: int = ITEMS_PER_BLOCK,
    bits: int = COORDINATE_BITS,
) -> DataFrame:
    """The ``k`` documents of highest score for every item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    Scores are whole numbers: the weights of the item's terms times their impacts in the document, which fall with its length.  Every
    document gets a sketch, the largest impact at each hashed coordinate; the item's weights times the impacts at
    its terms' coordinates are an upper bound of the score.  The texts of highest bound are scored exactly, the k-th best score
    is a threshold, and those whose bound still reaches it follow, highest first, until none is left.

    Equal texts are scored once.  Equal scores are ranked by id, null ids last; rows that repeat are ranked each.  Null and empty
    texts have no terms and are never found; items without terms, or without a document that scores above 0, give no rows; rows that repeat
    an item and its text are one item.  Texts are read whole.  Other columns are ignored.
    """
    spark = docs.sparkSession
    asked = staged(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct(), "items")
    blocks = splits(asked.count(), items_per_block)
    out = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        found = _search_block(docs, part, k, rounds, bits, text_col=text_col, id_col=id_col)
        if found is not None:
            out = found if out is None else out.union(found)
    if out is None:
        kind = asked.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
