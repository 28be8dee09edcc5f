"""Ordered per-key work that survives a hot key.

A plain ``Window.partitionBy(host)`` puts every row of one host into one task.  Events without an
identity all land on the host ``unknown``, so one host can hold a large part of the data.  The
ordered operators therefore work on (key, chunk): ordinary keys have the single chunk 0, a key with
more than ``target`` rows is cut into consecutive ranges of its order column.  What a chunk needs to
know about the chunks before it arrives as a few *seed* rows in front of it.

Cost on data without hot keys: one partial count per key.  The table of hot keys is then empty, and
adaptive execution drops the seed branches before they scan anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS = 20_000_000
# With a unique whole-number order column no chunk can hold more rows than its span, so this bounds
# a chunk even when a key's rows come in one burst.
MAX_SPAN = 1 << 27


def hot_keys(
    rows: DataFrame,
    key: str,
    order: str,
    *,
    target: int = TARGET_ROWS,
    max_span: int | None = MAX_SPAN,
) -> DataFrame:
    """(key, span) of the keys with more than ``target`` rows; at most rows/target of them."""
    share = F.expr("cast((hi - lo + 1) * (cast(%d as double) / n) as bigint)" % target)
    span = F.greatest(share, F.lit(1).cast("long"))
    if max_span is not None:
        span = F.least(span, F.lit(max_span).cast("long"))
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"))
        .where(F.col("n") > target)
        .select(key, span.alias("span"))
    )


def split_hot(
    rows: DataFrame,
    key: str,
    order: str,
    *,
    target: int | None = TARGET_ROWS,
    max_span: int | None = MAX_SPAN,
    flag: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Add ``chunk``, and whether the key is hot as ``flag``; also return the rows of hot keys alone, for building seeds.

    The broadcast side has at most rows/target entries (50,000 for 10^12 rows).  A ``target`` of
    None is for callers that know all rows together to be few, such as a counted micro-batch:
    nothing is split and there are no hot rows.
    """
    if target is None:
        whole = rows.withColumn("chunk", F.lit(0).cast("long"))
        return whole.withColumn(flag, F.lit(False)) if flag else whole, None
    hot = F.broadcast(hot_keys(rows, key, order, target=target, max_span=max_span))
    chunk = F.expr(f"cast({order} div span as bigint)")
    every = rows.join(hot, key, "left").withColumn(
        "chunk", F.coalesce(chunk, F.lit(0).cast("long"))
    )
    only_hot = rows.join(hot, key, "inner").withColumn("chunk", chunk)
    if flag:
        every = every.withColumn(flag, F.col("span").isNotNull())
    return every.drop("span"), only_hot.drop("span")


def earlier_chunks(key: str) -> Window:
    """All chunks of the same key before the current one, over one row per (key, chunk)."""
    return (
        Window.partitionBy(key)
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
