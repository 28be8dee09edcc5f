"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import staged

#: Links that one task unites by itself; more are contracted first.
FEW_LINKS = 200_000


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links in one task, which are few: every node joins the smallest node that it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], names=["node", "label"])


def components(links: DataFrame, *, few: int = FEW_LINKS, tasks: int | None = None) -> DataFrame:
    """``node`` and ``label`` (the component's smallest node) for links ``a`` - ``b`` of whole numbers; self-links and repeats are fine.

    Each round ranks the nodes anew by a hash, gives every node the first of itself and its neighbours (partial minima,
    so a hub is no burden), and contracts: links are moved to what their ends were given, and those within one node go.
    A round is expected to leave at most three quarters of the nodes that still have links (half of a chain's), whatever
    the diameter, and always fewer than before, so rounds need no cap.  As soon as no more than ``few`` links are left they are united in
    one task.  The rounds' maps shrink alike; they are followed
    from the last to the first.  Every step is a table in the shared folder, so lineage does not grow.  ``tasks`` bounds its files.
    """

    def stage(df: DataFrame, name: str) -> DataFrame:
        return staged(df if tasks is None else df.coalesce(tasks), name)

    edges = stage(_pairs(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "a", "b"), "edges")
    steps: list[DataFrame] = []
    while edges.count() > few:

        def rank(node: str, turn: int = len(steps)) -> Column:
            return F.xxhash64(node, F.lit(turn))  # one-to-one for whole numbers of one type, so there are no ties

        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("near"))
        step = stage(near.select(F.col("a").alias("node"), F.when(rank("near") < rank("a"), F.col("near")).otherwise(F.col("a")).alias("label")), "steps")
        ends = [step.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")) for end in ("a", "b")]
        moved = edges.where("a <> b").join(ends[0], "a").join(ends[1], "b").where("a_label <> b_label")
        edges = stage(_pairs(moved, "a_label", "b_label"), "edges")
        steps.append(step)
    labels = staged(edges.coalesce(1).mapInArrow(_united, "node long, label long"), "labels")
    if not steps:
        return labels
    while steps:
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = stage(steps.pop().join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels")
    smallest = stage(labels.groupBy("label").agg(F.min("node").alias("least")), "smallest")
    return stage(labels.join(smallest, "label").select("node", F.col("least").alias("label")), "labels")
