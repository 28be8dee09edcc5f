"""Greedy anchored chains: the first row at least ``gap`` after the previous anchor is the next one.

Each anchor depends on the one before, so no window frame expresses it.  Rows are partitioned and
sorted by (key, chunk, time) and one pass over the Arrow batches follows the chain.  A hot key is
cut into chunks (see ``hot_keys``): a chunk's effect is a non-decreasing step function from the
anchor entering it to the anchor leaving it, those steps are composed per key, and each chunk then
starts from its own seed row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostpulse.operators.hot_keys import TARGET_ROWS, split_hot
from hostpulse.operators.lookup import lookup

# Stands for "no threshold can be reached"; later than any microsecond timestamp.
NEVER = np.iinfo(np.int64).max // 2
ALWAYS = -NEVER


def _reached(first: np.ndarray, hop: np.ndarray) -> np.ndarray:
    """Rows on the chains that begin at ``first`` and follow ``hop``; the last entry of ``hop`` is the end of all."""
    marked = np.zeros(len(hop), bool)
    marked[first] = True
    while True:
        marked[hop[marked]] = True
        if hop.min() == len(hop) - 1:
            return marked[:-1]
        hop = hop[hop]


def _marker(key: str, time: str, gap: int, entry: int):
    """One forward pass over sorted batches; the open chain of a group crosses batch borders.

    Only key, chunk, time and flags become arrays, the other columns stay as they came.  All groups of a batch are
    followed together, by doubling hops.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, anchor, threshold = None, None, entry
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(key)
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            chunks = batch.column("chunk").to_numpy(zero_copy_only=False)
            times = batch.column(time).to_numpy(zero_copy_only=False)
            forced = np.flatnonzero(batch.column("forced").fill_null(False).to_numpy(zero_copy_only=False))
            seeds = batch.column("seed").to_numpy(zero_copy_only=False)
            fresh = np.append(True, (codes[1:] != codes[:-1]) | (chunks[1:] != chunks[:-1]))
            starts = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            ends = np.append(starts[1:], n)
            if (keys[0].as_py(), chunks[0]) != open_group:
                anchor, threshold = None, entry

            # The place of a time among all times of the batch, so that (group, time) is one ascending number.
            distinct = np.unique(times)
            width = len(distinct) + 1
            order = group * width + np.searchsorted(distinct, times)
            next_forced = np.append(forced, n)

            def next_at(groups, limits, rows):
                by_time = np.searchsorted(order, groups * width + np.searchsorted(distinct, limits))
                by_force = next_forced[np.searchsorted(forced, rows)]
                at = np.minimum(np.maximum(by_time, rows), by_force)
                return np.where(at < ends[groups], at, n)

            limits = np.full(len(starts), entry)
            limits[0] = threshold
            first = next_at(np.arange(len(starts)), limits, starts)
            first = np.where(seeds[starts], starts, first)
            hop = np.append(next_at(group, times + gap, np.arange(n) + 1), n)
            picked = _reached(first, hop)

            newest = np.maximum.accumulate(np.where(picked, np.arange(n), -1))
            known = newest >= starts[group]
            anchors = times[np.maximum(newest, 0)]
            if anchor is not None:
                carried = ~known & (group == 0)
                anchors[carried] = anchor
                known |= carried
            if known[-1]:
                anchor = int(anchors[-1])
                threshold = anchor + gap
            elif len(starts) > 1:
                anchor, threshold = None, entry
            open_group = (keys[n - 1].as_py(), chunks[n - 1])
            out = pa.Table.from_batches([batch])
            out = out.append_column("anchor", pa.array(anchors, pa.int64(), mask=~known))
            out = out.append_column("is_anchor", pa.array(picked, pa.bool_()))
            yield from (out.filter(pa.array(~seeds)) if seeds.any() else out).to_batches()

    return mark


def _steps(key: str, time: str, gap: int):
    """The chunk's effect: for entry thresholds up to ``upto`` the last anchor is ``last``."""

    def steps(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(time)
        times = ordered[time].to_numpy()
        forced = np.flatnonzero(ordered["forced"].to_numpy())
        n = len(times)
        hop = np.searchsorted(times, times + gap, side="left")
        hop = np.maximum(hop, np.arange(n) + 1)
        if len(forced):
            slot = np.searchsorted(forced, np.arange(n) + 1, side="left")
            nearest = np.append(forced, n)[slot]
            hop = np.minimum(hop, nearest)
        last = np.where(hop >= n, np.arange(n), hop)
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        stop = forced[0] if len(forced) else n - 1
        entries = np.arange(stop + 1)
        upto = times[: stop + 1].astype(np.int64).copy()
        if len(forced):
            # Every threshold beyond the first forced row still ends at that row.
            upto[stop] = np.iinfo(np.int64).max
        exits = times[last[entries]]
        keep = np.append(exits[1:] != exits[:-1], True)
        return pd.DataFrame(
            {
                key: group[key].iloc[0],
                "chunk": group["chunk"].iloc[0],
                "upto": upto[keep],
                "last": exits[keep],
            }
        )

    return steps


def _resolver(key: str, time: str, gap: int, entry: int):
    """Compose a key's chunk steps in order; emit the anchor with which each chunk is entered.

    A key's steps are few against its rows: a chunk has at most one per time that can be its first
    anchor, and neighbours that leave the chunk by the same anchor are one step.
    """

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        threshold, anchor = entry, None
        chunks, anchors = [], []
        for chunk, steps in group.sort_values(["chunk", "upto"]).groupby("chunk", sort=True):
            if anchor is not None:
                chunks.append(chunk)
                anchors.append(anchor)
            upto = steps["upto"].to_numpy()
            slot = int(np.searchsorted(upto, threshold, side="left"))
            if slot < len(upto):
                anchor = int(steps["last"].iloc[slot])
                threshold = anchor + gap
        return pd.DataFrame(
            {
                key: pd.Series([group[key].iloc[0]] * len(chunks), dtype=object),
                "chunk": pd.Series(chunks, dtype="int64"),
                time: pd.Series(anchors, dtype="int64"),
            }
        )

    return resolve


def mark_anchors(
    rows: DataFrame,
    key: str,
    time: str,
    *,
    tie: str | tuple[str, ...],
    gap: int,
    entry: int = ALWAYS,
    forced: str | None = None,
    target: int | None = TARGET_ROWS,
    max_span: int | None = None,
) -> DataFrame:
    """Add ``anchor`` (time of the newest anchor up to the row) and ``is_anchor``.

    ``time`` is a whole-number column; ``entry`` is the threshold before the first row (``ALWAYS``:
    the first row is an anchor, ``NEVER``: only a forced row starts the chain).  ``forced`` names a
    boolean column of rows that are anchors whatever the gap.
    """
    flag = F.col(forced) if forced else F.lit(False)
    flagged = rows.withColumn("forced", flag)
    every, only_hot = split_hot(flagged, key, time, target=target, max_span=max_span)
    key_type = rows.schema[key].dataType.simpleString()

    seeded = every.withColumn("seed", F.lit(False))
    if only_hot is not None:
        # Rows at one time act as one, so the groups hold distinct times only.
        times = only_hot.groupBy(key, "chunk", time).agg(F.max("forced").alias("forced"))
        steps = times.groupBy(key, "chunk").applyInPandas(
            _steps(key, time, gap), f"{key} {key_type}, chunk bigint, upto bigint, last bigint"
        )
        seeds = steps.groupBy(key).applyInPandas(
            _resolver(key, time, gap, entry), f"{key} {key_type}, chunk bigint, {time} bigint"
        )
        seeded = seeded.unionByName(
            seeds.withColumn("seed", F.lit(True)).withColumn("forced", F.lit(False)),
            allowMissingColumns=True,
        )
    ordered = seeded.repartition(key, "chunk").sortWithinPartitions(
        key,
        "chunk",
        F.desc("seed"),
        time,
        F.desc("forced"),
        *([tie] if isinstance(tie, str) else tie),
    )
    out = T.StructType(
        ordered.schema.fields
        + [T.StructField("anchor", T.LongType()), T.StructField("is_anchor", T.BooleanType())]
    )
    marked = ordered.mapInArrow(_marker(key, time, gap, entry), out)
    extra = ["chunk", "seed"] + ([] if "forced" in rows.columns else ["forced"])
    return marked.drop(*extra)


def with_anchors_before(rows: DataFrame, state: DataFrame, key: str, time: str, *, spread: str) -> DataFrame:
    """``rows`` with the anchors that earlier batches left as forced first rows of their keys (``stored``).

    ``state`` has ``key`` and ``anchor_before``, at most one row per key; every row also gets its key's.  A row older than that anchor counts as
    one at its time: a batch cannot change what was decided before.  Keys without new rows are not touched.
    """
    known = lookup(rows, state.select(key, "anchor_before"), key, spread=spread)
    moved = known.withColumn(time, F.greatest(F.col(time), F.coalesce("anchor_before", time)))
    seeds = moved.where(F.col("anchor_before").isNotNull()).groupBy(key).agg(F.max("anchor_before").alias("anchor_before"))
    seeds = seeds.select(key, F.col("anchor_before").alias(time), F.lit(True).alias("stored"))
    return moved.withColumn("stored", F.lit(False)).unionByName(seeds, allowMissingColumns=True)


def newest_anchors(marked: DataFrame, state: DataFrame | None, key: str) -> DataFrame:
    """The newest anchor of every key after a batch: what ``with_anchors_before`` of the next one needs."""
    newest = marked.where(F.col("anchor").isNotNull()).groupBy(key).agg(F.max("anchor").alias("anchor_before"))
    if state is None:
        return newest
    return newest.unionByName(state.select(key, "anchor_before").join(newest, key, "left_anti"))
