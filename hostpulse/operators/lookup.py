"""Left lookups into a side table whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
SALTS = 64


def broadcast_if_small(side: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast when it has at most ``max_rows`` rows, else unchanged.

    The check stops counting just above the bound.
    """
    return F.broadcast(side) if side.limit(max_rows + 1).count() <= max_rows else side


def lookup(
    rows: DataFrame,
    side: DataFrame,
    key: str,
    *,
    spread: str,
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` left-joined with ``side`` (at most one row per key).

    A side of at most ``max_rows`` rows is broadcast.  A larger side is joined by shuffle, with the
    rows of each key spread over ``salts`` partitions by the ``spread`` column so that a hot key
    does not end in one task.
    """
    if side.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(side), key, "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = side.withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(copies, [key, "salt"], "left").drop("salt")
