"""Byte-balanced shards of indivisible groups, by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import numbered, splits, staged

#: Partial partitions that one task combines; more are combined in levels.
FAN_IN = 20_000
ROWS_PER_BIN = 100_000


def difference(parts: Sequence[Sequence[int]], shards: int) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions until one is left.

    Each part has up to ``shards`` sums, in descending order.  The two parts of largest spread are added
    in opposite order (largest with smallest) again and again; ties go to the earlier part.  Returns for
    each part the shard of each of its positions, and the shards' sums in descending order.
    """
    sums = [list(p) + [0] * (shards - len(p)) for p in parts]
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a = heapq.heappop(heap)[1]
        b = heap[0][1]
        added = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(range(shards), key=added.__getitem__, reverse=True)
        place = [0] * shards
        for position, source in enumerate(order):
            place[source] = position
        merges.append((a, b, place))
        merged = [added[source] for source in order]
        sums[a] = sums[b] = None
        sums.append(merged)
        heapq.heapreplace(heap, (merged[-1] - merged[0], len(sums) - 1))
    where: list = [None] * len(sums)
    where[-1] = list(range(shards))
    for node in range(len(sums) - 1, len(parts) - 1, -1):
        a, b, place = merges[node - len(parts)]
        mine = where[node]
        where[a] = [mine[p] for p in place]
        where[b] = [mine[p] for p in reversed(place)]
    return where[: len(parts)], sums[-1]


def _chunk_of(shards: int):
    """Combines the parts of one chunk: rows (part, sums) in, (part, positions, chunk sums) out."""

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("part", kind="stable")
        where, total = difference(chunk["sums"].tolist(), shards)
        return pd.DataFrame(
            {"chunk": chunk["chunk"], "part": chunk["part"], "places": where, "total": [total] * len(chunk)}
        )

    return run


def balanced_groups(groups: DataFrame, shards: int, *, size_col: str = "bytes", fan_in: int = FAN_IN) -> DataFrame:
    """Add ``shard`` to a table of groups (``part`` string, unique, and a size).

    Parts are dealt into hash chunks of about ``fan_in``, each chunk is differenced down to one partial
    partition, and the chunks' partial partitions are the parts of the next level, until one is left.
    No task sees more than a chunk.  An empty table gives an empty table.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    level = groups.select("part", F.array(F.col(size_col).cast("long")).alias("sums"))
    count = level.count()
    tables = []
    schema = "chunk long, part string, places array<int>, total array<long>"
    while True:
        chunks = splits(count, fan_in)
        dealt = level.withColumn("chunk", F.pmod(F.xxhash64(F.lit(len(tables)), "part"), F.lit(chunks)))
        done = staged(dealt.groupBy("chunk").applyInPandas(_chunk_of(shards), schema), "differenced")
        tables.append(done)
        if chunks == 1:
            break
        level = done.groupBy("chunk").agg(F.first("total").alias("sums")).select(
            F.col("chunk").cast("string").alias("part"), "sums"
        )
        count = chunks
    places = tables.pop().select("part", F.col("places").alias("to"))
    while tables:
        above = places.withColumnRenamed("part", "chunk_key")
        below = tables.pop().withColumn("chunk_key", F.col("chunk").cast("string"))
        moved = F.transform("places", lambda p: F.get("to", p))
        places = below.join(above, "chunk_key").select("part", moved.alias("to"))
    return groups.join(places.select("part", F.get("to", F.lit(0)).alias("shard")), "part")


def shard_documents(
    docs: DataFrame,
    shards: int,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    size: Column | None = None,
    staging: str = "shards",
) -> DataFrame:
    """Put documents into byte-balanced shards; equal texts stay together.

    Adds ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each
    shard).  Null texts form one group of their own with size 1 each and a null checksum; empty texts are another.
    Rows repeated with the same id are rows like any other and keep separate slots.  The text itself is
    not carried: only its digest is shuffled.  Other columns are dropped.
    """
    text = F.col(text_col)
    amount = size if size is not None else F.coalesce(F.octet_length(text), F.lit(0)) + 1
    narrow = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            amount.cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null")).alias("part"),
        ),
        staging,
    )
    rows = narrow.count()
    groups = narrow.groupBy("part").agg(F.sum("size").alias("bytes"))
    placed = balanced_groups(groups, shards).select("part", "shard")
    out = narrow.join(placed, "part").drop("part")
    order = [F.col(c) for c in ("doc_id", "size", "text_crc32")]
    return numbered(out, order, within=["shard"], column="slot", per_bin=ROWS_PER_BIN, rows=rows)
