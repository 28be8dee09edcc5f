"""As-of joins: for every row the last change of its key before it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.operators.hot_keys import TARGET_ROWS, earlier_chunks, split_hot


def as_of(
    rows: DataFrame,
    changes: DataFrame,
    key: str,
    order: str,
    values: Mapping[str, Column],
    *,
    target: int | None = TARGET_ROWS,
) -> DataFrame:
    """``rows`` with, per entry of ``values``, what it was at the newest change of the row's ``key`` before its ``order``.

    ``changes`` has ``key`` and ``order`` (whole numbers, unique among the changes of a key) and whatever ``values`` reads; an entry that is
    null in a change is not changed by it.  A change at the very place of a row comes after it.  Both sides share one exchange
    and one sort; a key with more than ``target`` rows is cut into ranges of ``order``, each of which starts from the
    values that the ranges before it left.  Rows without a key, and before the first change, have nulls.
    """
    told = changes.where(F.col(key).isNotNull()).select(key, order, *(c.alias(n) for n, c in values.items()))
    unset = [F.lit(None).cast(told.schema[n].dataType).alias(n) for n in values]
    both = rows.select("*", *unset, F.lit(False).alias("_change")).unionByName(
        told.withColumn("_change", F.lit(True)), allowMissingColumns=True
    )
    every, only_hot = split_hot(both, key, order, target=target, max_span=None)
    if only_hot is not None:
        newest = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in values]
        per_chunk = only_hot.groupBy(key, "chunk").agg(*newest)
        before = earlier_chunks(key)
        seeds = per_chunk.select(key, "chunk", *(F.last(n, ignorenulls=True).over(before).alias(n) for n in values))
        every = every.unionByName(seeds.withColumn("_change", F.lit(True)), allowMissingColumns=True)
    through = (
        Window.partitionBy(key, "chunk").orderBy(F.asc_nulls_first(order), "_change").rowsBetween(Window.unboundedPreceding, 0)
    )
    kept = [c for c in rows.columns if c not in values]
    known = every.select(*kept, "_change", *(F.last(n, ignorenulls=True).over(through).alias(n) for n in values))
    return known.where(~F.col("_change")).drop("_change")
