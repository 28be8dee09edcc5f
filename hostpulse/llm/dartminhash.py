"""Near-duplicate classes: DartMinHash signatures of weighted shingles, banded joining, verified links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.llm.common import flat, mix, pieces, spans_to_index, splits, staged, tasks_for, unused
from hostpulse.llm.components import components
from hostpulse.llm.shingles import Shingler

SIMILARITY = 0.8
#: 24 bands of 4 coordinates: two texts of similarity 0.8 miss all of them once in 300,000 pairs.
BANDS, ROWS = 24, 4
#: Pairs whose signatures agree in fewer coordinates than this share are not compared exactly: five standard deviations
#: below the similarity asked for.
LEAST_AGREEMENT = 0.55
#: Buckets with up to so many members outside their largest class have all pairs of different classes compared in the
#: last round; texts of fuller ones only where they share a rare element.
SMALL_BUCKET = 24
#: Counters of how often elements occur: 2 to a power between these, about one for 16 elements.
SLOT_BITS = (10, 22)
#: Bytes of elements that one task counts.
CENSUS_BYTES = 64 << 20
ROUNDS = 3

#: Cumulated Poisson(1) probabilities: how many darts a unit cell has.
_CELL = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
_A, _B, _C = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def weighted(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements per text, sorted by hash, and how often each occurs (its weight)."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])) if len(values) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return values[first], owner[first], np.diff(np.append(first, len(values)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def signatures(values: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
    """One row of ``k`` coordinates per text: the dart that came first in each.

    An element's region is its weight times all ranks.  Darts fall on it as a Poisson process, drawn in unit cells
    by hashing the element with the cell, so equal regions of different texts get equal darts.  A text looks at
    ranks up to a bound that gives it about k (ln k + 2) darts in all; a dart's hash names its coordinate, and the
    smallest rank there is kept.  Texts that leave a coordinate empty look at twice the ranks.  A text without
    elements has zeros.
    """
    out = np.zeros((texts, k), np.uint64)
    total = np.bincount(owner, weights=weight, minlength=texts).astype(float)
    wanted = k * (math.log(k) + 2)
    bound = np.where(total > 0, wanted / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        use = todo[owner]
        e, o, w = values[use], owner[use], weight[use]
        # cells: weight levels times rank levels
        levels = np.ceil(w).astype(np.int64)
        ranks = np.ceil(bound[o]).astype(np.int64)
        cells = levels * ranks
        at = np.repeat(np.arange(len(e)), cells)
        serial = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        level, rank = serial // ranks[at], serial % ranks[at]
        cell = mix(e[at] + level.astype(np.uint64) * _A + rank.astype(np.uint64) * _B)
        darts = np.searchsorted(_CELL, _uniform(cell), side="right")
        at, level, rank, cell = (np.repeat(x, darts) for x in (at, level, rank, cell))
        number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(cell + (number.astype(np.uint64) + np.uint64(1)) * _C)
        height = rank + _uniform(dart)
        named = mix(dart + _A)
        whole = w[at] >= level + 1
        reached = (height < bound[o[at]]) & (whole | (level + _uniform(mix(dart + _B)) < w[at]))
        at, dart, height, named = at[reached], dart[reached], height[reached], named[reached]
        slot = o[at] * k + (named % np.uint64(k)).astype(np.int64)
        order = np.argsort(-height, kind="stable")
        chosen = out.reshape(-1)
        chosen[slot[order]] = dart[order]  # the smallest rank is written last
        empty = (out == 0).any(axis=1) & todo
        out[empty] = 0
        bound = np.where(empty, bound * 2, bound)
        todo = empty
    return out


def sketch(docs: DataFrame, *, key: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: its key, a digest of its weighted shingles, band keys, coordinates (a byte each) and the
    sorted elements (32 bits each; the n-th occurrence of a shingle is an element of its own)."""
    k = bands * rows
    narrow = docs.select(key, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for piece in pieces(batch, text_col):
                n = piece.num_rows
                values, owner, weight = weighted(*shingle(piece.column(text_col)))
                signature = signatures(values, owner, weight, n, k)
                keys = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    keys += signature[:, r::rows] * factors[r]
                keys = mix(keys.reshape(-1)).reshape(n, bands).view(np.int64)
                # occurrences as elements: their set similarity is the weighted similarity
                each = np.repeat(np.arange(len(values)), weight)
                nth = spans_to_index(np.zeros(len(weight), np.int64), weight)
                whole = mix(values[each] + nth.astype(np.uint64) * _A)
                count = np.bincount(owner, weights=weight, minlength=n).astype(np.int64)
                ends = np.cumsum(count)
                sums = np.append(np.uint64(0), np.cumsum(whole))
                other = np.append(np.uint64(0), np.cumsum(mix(whole + _B)))
                first = ends - count
                digest = [f"{a:016x}{b:016x}{c:x}" if c else None for a, b, c in zip((sums[ends] - sums[first]).tolist(), (other[ends] - other[first]).tolist(), count.tolist())]
                short = (whole >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((short, np.repeat(np.arange(n), count)))
                short = short[order]
                blobs = [short[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
                marks = (signature & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(key),
                        pa.array(digest, pa.string()),
                        pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), keys.reshape(-1)),
                        pa.array([row.tobytes() for row in marks], pa.binary()),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=[key, "digest", "bands", "marks", "elements"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"{key} {kind}, digest string, bands array<long>, marks binary, elements binary")


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("a_marks", "b_marks")
        )
        near = (a == b).mean(axis=1) >= LEAST_AGREEMENT
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of pairs of element sets."""
    for batch in batches:
        found = []
        for x, y in zip(batch.column("a_elements"), batch.column("b_elements")):
            p, q = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
            shared = len(p) + len(q) - len(np.union1d(p, q)) if len(p) and len(q) else 0
            found.append(shared / max(1, len(p) + len(q) - shared))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
        )


def _shape(members: DataFrame, turn: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """One member and the size of each class in a bucket; leader and largest class of the buckets with several.

    In the first turn the members that meet most others in all their buckets go first: the text that many were copied
    from shares more bands with each of them than they do with each other.  Later it is one of the largest class.
    """
    order = F.struct((F.lit(0) if turn else -F.col("met")).cast("long").alias("met"), F.xxhash64(F.lit(turn), "id").alias("o"), "id")
    of_class = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("m")).coalesce(tasks)
    leader = F.max_by("m", F.struct("n", "label")) if turn else F.min("m")
    mixed = of_class.groupBy("band").agg(
        F.count(F.lit(1)).alias("classes"), leader.alias("leader"), F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size")
    )
    return of_class, mixed.where("classes > 1").withColumn("outside", F.col("size") - F.col("most.n"))


def _ends(x: Column, y: Column) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _across(members: DataFrame, mixed: DataFrame, fits: Column | None = None) -> DataFrame:
    """Pairs of different classes: each member outside a bucket's largest class with all members of other classes.

    ``fits`` is a further condition on the columns of both; those of the member outside are named ``x_...``.
    """
    inside = members.join(mixed.select("band", F.col("most.label").alias("most")), "band")
    outside = inside.where(F.col("label") != F.col("most")).select(*(F.col(c).alias(f"x_{c}") for c in members.columns))
    apart = (F.col("band") == F.col("x_band")) & (F.col("label") != F.col("x_label"))
    return outside.join(inside, apart if fits is None else apart & fits).select(*_ends(F.col("x_id"), F.col("id")))


def _elements(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all texts of a batch and how many each has."""
    body, offsets = flat(batch.column("elements"))
    return np.ascontiguousarray(body).view(np.uint32), np.diff(offsets) // 4


class Order:
    """The common order of all texts' elements: by how often the element's slot was counted, then by value.

    Any order that is the same for all texts is right; the counts make it short, as rare elements come first.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.often = np.zeros(1 << bits, np.int32)

    def slots(self, elements: np.ndarray) -> np.ndarray:
        return (mix(elements) >> np.uint64(64 - self.bits)).astype(np.int64)

    def first(self, batch: pa.RecordBatch, similarity: float) -> tuple[np.ndarray, ...]:
        """The first elements of every text: value, slot, text, place, size of the text."""
        elements, count = _elements(batch)
        slot = self.slots(elements)
        owner = np.repeat(np.arange(batch.num_rows), count)
        order = np.lexsort((elements, self.often[slot], owner))
        place = np.arange(len(elements)) - np.repeat(np.cumsum(count) - count, count)
        first = np.flatnonzero(place < (count - np.ceil(similarity * count - 1e-9).astype(np.int64) + 1)[owner])
        return elements[order][first], slot[order][first], owner[first], place[first], count[owner[first]]


def _census(texts: DataFrame, order: Order) -> DataFrame:
    """Counts of slots, from all elements of all texts; each task reports the slots with more than their fair share of its elements.

    Those are fewer than half of the slots, whatever the task reads, and what is not reported is rare and comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << order.bits, np.int64)
        for batch in batches:
            total += np.bincount(order.slots(_elements(batch)[0]), minlength=len(total))
        used = np.flatnonzero(total > 2 * total.mean())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    return texts.select("elements").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def _rare_elements(texts: DataFrame, similarity: float, tasks: int) -> DataFrame:
    """Per text (``id``, ``label``, ``elements``) its rarest elements as buckets, their place in the text's order, its size.

    Two texts of at least this similarity share one of the first n - ceil(similarity x n) + 1 of the common order.  Of
    these only those go out whose slot has texts of several classes and that come early enough for the shortest text there.
    The tables of slots grow with the elements up to a fixed size; a task counts a fixed number of bytes, so that its report
    is a small share of what it reads.
    """
    context = texts.sparkSession.sparkContext
    size = texts.agg(F.sum(F.length("elements"))).first()[0]
    gathered = texts.coalesce(splits(size, CENSUS_BYTES))
    order = Order(min(max((size // 64).bit_length(), SLOT_BITS[0]), SLOT_BITS[1]))
    for row in _census(gathered, order).coalesce(tasks).collect():  # at most one row per slot, whatever the data
        order.often[row["slot"]] = min(row["n"], (1 << 31) - 1)
    shared = context.broadcast(order)
    share, slots = similarity / (1 + similarity), 1 << order.bits

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.iinfo(np.int64).max
        low, high, short = np.full(slots, big), np.full(slots, -big), np.full(slots, big)
        for batch in batches:
            _, slot, owner, _, size = shared.value.first(batch, similarity)
            label = batch.column("label").to_numpy()[owner]
            np.minimum.at(low, slot, label)
            np.maximum.at(high, slot, label)
            np.minimum.at(short, slot, size)
        used = np.flatnonzero(short < big)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, low[used], high[used], short[used])], names=["slot", "low", "high", "short"])

    met = gathered.mapInArrow(survey, "slot long, low long, high long, short long").groupBy("slot")
    several = met.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("short").alias("short")).where("low < high")
    shortest = np.full(slots, -1)
    for row in several.coalesce(tasks).collect():  # at most one row per slot
        shortest[row["slot"]] = row["short"]
    partner = context.broadcast(shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            element, slot, owner, place, size = shared.value.first(batch, similarity)
            other = partner.value[slot]
            use = (other >= 0) & (size - place + 1e-6 >= (size + other) * share)
            chosen = pa.array(owner[use])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(element[use].astype(np.int64)),
                    *(batch.column(c).take(chosen) for c in ("id", "label")),
                    pa.array(place[use]),
                    pa.array(size[use]),
                ],
                names=["band", "id", "label", "place", "size"],
            )

    found = texts.mapInArrow(run, "band long, id long, label long, place long, size long")
    return found.withColumn("met", F.lit(0).cast("long"))


def _may_reach(similarity: float) -> Column:
    """Whether two texts whose first shared element has these places can share enough of what is left."""
    left = F.least(F.col("size") - F.col("place"), F.col("x_size") - F.col("x_place"))
    return left + F.lit(1e-6) >= (F.col("size") + F.col("x_size")) * F.lit(similarity / (1 + similarity))


def _pairs(members: DataFrame, nodes: DataFrame, turn: int, last: bool, similarity: float, tasks: int) -> DataFrame:
    """Candidate pairs (a < b) of different classes.

    Each class sends one member of a bucket, a different one each turn, and each is paired with the bucket's leader, whose
    choice also turns.  In the last turn all pairs of different classes follow where few members are outside a
    bucket's largest class, which is linear in the bucket's rows.  Texts of fuller buckets are paired where they share one
    of their rarest elements early enough: all similar ones do, whereas those that share a common passage alone do not.
    """
    of_class, mixed = _shape(members, turn, tasks)
    stars = of_class.join(mixed, "band").where(F.col("m.id") != F.col("leader.id")).select(*_ends(F.col("m.id"), F.col("leader.id")))
    if not last:
        return stars.coalesce(tasks).distinct()
    mixed = staged(mixed.coalesce(tasks), "mixed-buckets")
    pairs = stars.coalesce(tasks).union(_across(members, mixed.where(F.col("outside") <= SMALL_BUCKET)).coalesce(tasks))
    wide = members.join(mixed.where(F.col("outside") > SMALL_BUCKET).select("band"), "band", "left_semi").select("id", "label").coalesce(tasks).distinct()
    texts = staged(nodes.select("id", "elements").join(wide, "id").coalesce(tasks), "wide-texts")
    if not texts.isEmpty():
        rare = staged(_rare_elements(texts, similarity, tasks), "rare-elements")
        pairs = pairs.union(_across(rare, _shape(rare, turn, tasks)[1], _may_reach(similarity)).coalesce(tasks))
    return pairs.distinct()


def _verified(pairs: DataFrame, marks: DataFrame, elements: DataFrame, similarity: float, tasks: int) -> DataFrame:
    def with_both(df: DataFrame, side: DataFrame, name: str) -> DataFrame:
        a = side.select(F.col("id").alias("a"), F.col(name).alias(f"a_{name}"))
        b = side.select(F.col("id").alias("b"), F.col(name).alias(f"b_{name}"))
        return df.coalesce(tasks).join(a, "a").coalesce(tasks).join(b, "b").select("a", "b", f"a_{name}", f"b_{name}").coalesce(tasks)

    likely = staged(with_both(pairs, marks, "marks").mapInArrow(_agreement, "a long, b long"), "likely-pairs")
    exact = with_both(likely, elements, "elements").mapInArrow(_similarity, "a long, b long, similarity double")
    return staged(exact.where(F.col("similarity") >= similarity), "links")


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """Classes of near-duplicate documents: ``doc_id``, ``class_id``, ``text_hash`` and ``class_key``, one row per input row.

    Two documents are linked where the weighted similarity of their five-word shingles (weights: occurrences) is at least
    ``similarity``; classes are the connected components, named by their smallest id (``class_key`` tells apart classes
    that share an id, or have none).  Documents with equal
    shingles are one node from the start (named by a 64-bit hash), so copies make no pairs.  Candidates share a band of their DartMinHash
    signatures.  In every bucket each class is compared with a leader, not with all others; links merge classes, and
    further turns with other leaders compare what is still apart; the last turn compares all pairs that are left (``_pairs``).  Null and empty texts are classes of their own; null ids
    are told apart by their text, and their class is named by a smallest id if one has any, else null.
    Extra columns are ignored.
    """
    keyed = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash")).alias("key"), F.col(text_col).alias("text"))
    alone = F.concat_ws(":", F.lit("none"), F.col("key.doc_id"), F.col("key.text_hash"))
    sketched = staged(
        sketch(keyed, key="key", text_col="text")
        .withColumn("digest", F.coalesce("digest", alone))
        .select("key.*", F.xxhash64("digest").alias("id"), "bands", "marks", "elements"),
        "sketches",
    )
    tasks = tasks_for(sketched)
    with_words = sketched.where(F.length("elements") > 0)
    bands = with_words.select("id", F.posexplode("bands").alias("n", "value")).select(F.xxhash64("n", "value").alias("band"), "id").distinct().coalesce(tasks)
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = F.sum("c").over(Window.partitionBy("id")).alias("met")
    buckets = staged(bands.join(shared, "band").coalesce(tasks).select("band", "id", met).coalesce(tasks), "buckets")
    # one row of each node that shares a bucket, with what comparing needs
    head = with_words.join(buckets.select("id").distinct(), "id", "left_semi").groupBy("id").agg(
        F.min("doc_id").alias("h_doc"), F.min("text_hash").alias("h_any")
    )
    heads = head.select(F.col("id").alias("h_id"), "h_doc", "h_any")
    at_head = (F.col("id") == F.col("h_id")) & F.when(F.col("h_doc").isNull(), F.col("text_hash") == F.col("h_any")).otherwise(F.col("doc_id") == F.col("h_doc"))
    nodes = staged(with_words.join(heads, at_head).select("id", "marks", "elements").dropDuplicates(["id"]).coalesce(tasks), "nodes")
    members = buckets.withColumn("label", F.col("id"))
    links, labels = None, None
    for turn in range(ROUNDS):
        pairs = _pairs(members, nodes, turn, turn == ROUNDS - 1, similarity, tasks)
        found = _verified(pairs, nodes.select("id", "marks"), nodes.select("id", "elements"), similarity, tasks).select("a", "b")
        if turn and found.isEmpty():
            if turn < ROUNDS - 1:
                continue
            break
        links = found if links is None else links.union(found)
        labels = components(links, tasks=tasks)
        members = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        members = staged(members.select("band", "id", "label", "met").coalesce(tasks), "members")
    rows = sketched.select("doc_id", "text_hash", "id").join(labels.withColumnRenamed("node", "id"), "id", "left")
    rows = rows.select("doc_id", "text_hash", F.coalesce("label", "id").alias("label")).coalesce(tasks)
    smallest = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return rows.join(smallest, "label").select("doc_id", "class_id", "text_hash", F.col("label").alias("class_key")).coalesce(tasks)


def keep_one(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class: the one with the smallest id; all columns kept.

    Of rows that repeat this id, and of classes without any id, one row stays.
    """
    classes = staged(near_duplicates(docs, text_col=text_col, id_col=id_col, similarity=similarity), "classes")
    tasks = tasks_for(classes)
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    named = first.groupBy("class_key", F.col("doc_id").alias("_k_id")).agg(F.min("text_hash").alias("_k_hash")).coalesce(tasks)
    one = staged(named.select("_k_id", "_k_hash").distinct().coalesce(tasks), "kept-ids")
    one = one.toDF(*(unused(docs, c) for c in ("kept_id", "kept_hash")))
    same = docs[id_col].eqNullSafe(one[one.columns[0]]) & (F.xxhash64(docs[text_col]) == one[one.columns[1]])
    kept = docs.join(one, same, "left_semi").coalesce(tasks)
    repeated = classes.groupBy("doc_id", "text_hash").count().where("count > 1").coalesce(tasks)
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col]).coalesce(tasks)
