"""Benchmark decontamination by spaced seeds, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import bounded, staged, tasks_for, unused

#: Positions that each mask reads; the others are ignored.  Every window of 13 tokens with up to two
#: substituted ones holds a place where each position of at least one mask is untouched.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
WINDOW = 13
SUBSTITUTIONS = 2
#: Items shorter than the window are matched whole: from this many tokens on with one substitution, below exactly.
ONE_SUBSTITUTION = 8
#: Items of fewer tokens than this are evidence only where they are all that a document says.
SHORTEST = 5


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for a null text."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.filter(runs, lambda t: t != F.lit(""))


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _whole(hashes: Column) -> Column:
    """The seed of a text of very few tokens: all of them, and that there are no others."""
    few = F.array(F.struct(F.xxhash64(F.lit(-1), hashes).alias("seed"), F.lit(0).alias("at")))
    return F.when(F.size(hashes).between(1, SHORTEST - 1), few).otherwise(F.array().cast("array<struct<seed:bigint,at:int>>"))


def seeds(hashes: Column, masks: Sequence[Sequence[int]], *, names: Sequence[int] | None = None, places: Column | None = None) -> Column:
    """All (seed, position) of a text, or those at the given places; a seed also names its mask."""
    n = F.size(hashes)

    def of(mask: Sequence[int], name: int) -> Column:
        seed = lambda i: F.struct(
            F.xxhash64(F.lit(name), *(F.get(hashes, i + m) for m in mask)).alias("seed"), i.alias("at")
        )
        where = F.sequence(F.lit(0), n - 1 - max(mask)) if places is None else places
        return F.when(n > max(mask), F.transform(where, seed)).otherwise(
            F.array().cast("array<struct<seed:bigint,at:int>>")
        )

    return F.concat(*(of(mask, name) for name, mask in zip(range(len(masks)) if names is None else names, masks)))


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item shorter than the window: its two halves, one of which a substitution leaves whole, or all of it."""
    if n < ONE_SUBSTITUTION:
        return [tuple(range(n))]
    return [tuple(range(n // 2)), tuple(range(n // 2, n))]


def benchmark_seeds(benchmark: DataFrame, masks: Sequence[Sequence[int]], *, id_col: str, text_col: str) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Items with their token hashes and seeds, and all masks: short items add those of their length."""
    items = benchmark.select(F.col(id_col).alias("item_id"), token_hashes(F.col(text_col)).alias("item")).where(F.size("item") > 0)
    # at most WINDOW - SHORTEST lengths
    short = sorted(r[0] for r in items.where(F.size("item").between(SHORTEST, WINDOW - 1)).select(F.size("item")).distinct().coalesce(1).collect())
    every = [*map(tuple, masks)]
    n = F.size("item")
    found = F.when(n >= WINDOW, seeds(F.col("item"), masks)).when(n < SHORTEST, _whole(F.col("item")))
    for length in short:
        own = short_masks(length)
        names = range(len(every), len(every) + len(own))
        found = found.when(n == length, seeds(F.col("item"), own, names=names, places=F.array(F.lit(0))))
        every += own
    return items.withColumn("seeds", found), every


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text_col: str = "text",
    masks: Sequence[Sequence[int]] = MASKS,
) -> DataFrame:
    """Verified overlaps of documents with benchmark items: ``doc_id``, ``text_hash``, ``item_id``, ``matched``, ``at``.

    A document overlaps an item where 13 aligned tokens agree in at least 11 places.  An item of 8 to 12 tokens must agree whole but
    for one token, one of 5 to 7 tokens wholly; a still shorter one is found only in a document that has no other tokens.  Seeds of both sides are
    joined (the benchmark's are broadcast only after a count), a hit fixes an alignment, and the whole item
    is compared along it.  ``matched`` is the largest number of agreeing tokens over the item's alignments, ``at`` the
    document's token at which the item would start.  One row per (document, item); documents are told apart
    by id and text, so repeated rows give one row and a null id is an id like any other.  Null and empty texts, and an empty
    benchmark, give no rows, nor do items without tokens.  Texts are read whole, however long.  Other columns are ignored.
    """
    items, every = benchmark_seeds(benchmark, masks, id_col=item_col, text_col=item_text_col)
    items = staged(items, "benchmark-items")
    tasks = max(tasks_for(docs), tasks_for(items))
    item_seeds = items.select("item_id", F.explode("seeds").alias("s")).select(
        "item_id", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at")
    )
    item_seeds = staged(item_seeds.distinct().coalesce(tasks), "benchmark-seeds")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), token_hashes(F.col(text_col)).alias("h"))
    positions = keyed.select("doc_id", "text_hash", F.explode(F.concat(seeds(F.col("h"), every), _whole(F.col("h")))).alias("s")).select(
        "doc_id", "text_hash", F.col("s.seed").alias("seed"), F.col("s.at").alias("at")
    )
    hits = positions.join(bounded(item_seeds), "seed")
    aligned = staged(hits.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct().coalesce(tasks), "benchmark-hits")
    hit_docs = aligned.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct().coalesce(tasks)
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    full = narrow.join(bounded(hit_docs), same).select("k_id", "k_hash", token_hashes(F.col("text")).alias("h"))
    pairs = aligned.join(full, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash")))
    joined = pairs.join(items.select("item_id", "item"), "item_id")
    agree = F.transform(
        "item", lambda t, j: F.coalesce((F.get("h", j + F.col("shift")) == t) & (j + F.col("shift") >= 0), F.lit(False)).cast("int")
    )
    judged = joined.select("doc_id", "text_hash", "item_id", "shift", agree.alias("agree"), F.size("h").alias("tokens"))
    width = F.least(F.lit(WINDOW), F.size("agree"))
    n = F.size("agree")
    allowed = F.when(n >= WINDOW, SUBSTITUTIONS).when(n >= ONE_SUBSTITUTION, 1).otherwise(0)
    alone = (n >= SHORTEST) | (F.col("tokens") == n)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("agree") - width),
        lambda s: F.aggregate(F.slice("agree", s + 1, width), F.lit(0), lambda a, x: a + x),
    )
    verified = judged.where(alone & (F.array_max(windows) >= width - allowed)).withColumn(
        "matched", F.aggregate("agree", F.lit(0), lambda a, x: a + x)
    )
    best = verified.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max(F.struct("matched", (-F.col("shift")).alias("back"))).alias("best")
    )
    return best.select("doc_id", "text_hash", "item_id", "best.matched", (-F.col("best.back")).alias("at")).coalesce(tasks)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without a verified overlap, all columns kept, nulls and repeated rows included."""
    found = overlaps(docs, benchmark, text_col=text_col, id_col=id_col, **options)
    leaked = staged(found.select("doc_id", "text_hash").distinct().coalesce(tasks_for(docs)), "leaks")
    leaked = leaked.toDF(*(unused(docs, c) for c in ("leak_id", "leak_hash")))
    same = docs[id_col].eqNullSafe(leaked[leaked.columns[0]]) & (F.xxhash64(docs[text_col]) == leaked[leaked.columns[1]])
    return docs.join(bounded(leaked), same, "left_anti")
