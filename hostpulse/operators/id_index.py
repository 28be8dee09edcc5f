"""An index of stored ids: files of hashed buckets, each with a Bloom filter, so that a batch opens only files that may hold its ids.

An id's hash names its bucket.  Files hold ids of one bucket, at most ``FILE_IDS`` each; beside them a table has one Bloom filter per
file.  A batch's ids meet the filters of their buckets first, and only files with a hit are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1024
FILE_IDS = 1_000_000
#: Ten bits and seven probes let about one in a hundred ids through that a file does not hold.
BITS_PER_ID, PROBES = 10, 7

IDS = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("event_date", T.DateType()), T.StructField("h", T.LongType()), T.StructField("bucket", T.IntegerType())])
BLOOMS = "bucket int, file string, n long, bits binary"


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def hashed(ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Ids with their hash and bucket."""
    return ids.withColumn("h", F.xxhash64("event_id")).withColumn("bucket", _bucket(F.col("h"), buckets))


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in a filter of ``bits`` bits, one row per probe."""
    x = h.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    first, step = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (first + np.arange(PROBES, dtype=np.uint64)[:, None] * step) % np.uint64(bits)


def bloom_bits(h: np.ndarray) -> bytes:
    bits = max(64, -(-len(h) * BITS_PER_ID // 8) * 8)
    marked = np.zeros(bits, np.uint8)
    marked[_probes(h, bits).reshape(-1).astype(np.int64)] = 1
    return np.packbits(marked).tobytes()


def may_hold(bits: bytes, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; never false for one that is."""
    packed = np.frombuffer(bits, np.uint8)
    at = _probes(h, len(packed) * 8)
    return ((packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


def write_ids(ids: DataFrame, path: str, blooms_path: str, *, buckets: int = BUCKETS) -> None:
    """Write ids (event_id, event_date) as bucket files below ``path`` and their filters to ``blooms_path``; both are replaced."""
    rows = hashed(ids.where(F.col("event_id").isNotNull()).select("event_id", "event_date"), buckets)
    ordered = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "event_id")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", FILE_IDS).partitionBy("bucket").parquet(path)
    written = ids.sparkSession.read.schema(IDS).parquet(path).select("bucket", F.col("_metadata.file_path").alias("file"), "h")

    def fold(group: pa.Table) -> pa.Table:
        h = group.column("h").to_numpy()
        return pa.table(
            {"bucket": group.column("bucket").slice(0, 1), "file": group.column("file").slice(0, 1), "n": [len(h)], "bits": [bloom_bits(h)]},
            schema=pa.schema([("bucket", pa.int32()), ("file", pa.string()), ("n", pa.int64()), ("bits", pa.binary())]),
        )

    # a group is one file: at most FILE_IDS hashes
    written.groupBy("file", "bucket").applyInArrow(fold, BLOOMS).write.mode("overwrite").parquet(blooms_path)


def files_to_open(asked: DataFrame, blooms: DataFrame, *, buckets: int = BUCKETS) -> list[str]:
    """Files whose filter lets at least one of the asked ids (event_id) through."""
    wanted = hashed(asked.where(F.col("event_id").isNotNull()).select("event_id"), buckets).select("bucket", "h").distinct()
    there = F.broadcast(wanted.select("bucket").distinct())  # at most ``buckets`` rows
    near = blooms.join(there, "bucket", "left_semi")

    def hit(key: tuple, ids: pa.Table, filters: pa.Table) -> pa.Table:
        h = ids.column("h").to_numpy()
        found = [f for f, bits in zip(filters.column("file").to_pylist(), filters.column("bits").to_pylist()) if may_hold(bits, h).any()]
        return pa.table({"file": pa.array(found, pa.string())})

    hits = wanted.groupBy("bucket").cogroup(near.groupBy("bucket")).applyInArrow(hit, "file string")
    return sorted(r["file"] for r in hits.distinct().collect())  # the files to read, not their ids


def stored_ids(asked: DataFrame, paths: list[str], blooms: DataFrame | None, *, buckets: int = BUCKETS, since: Column | None = None) -> DataFrame:
    """Stored ids (event_id, event_date) from the files that may hold any of the asked ones; ``since`` leaves out older days."""
    spark = asked.sparkSession
    files = files_to_open(asked, blooms, buckets=buckets) if blooms is not None and paths else []
    if not files:
        return spark.createDataFrame([], "event_id string, event_date date")
    # the bucket is known from the hash; files are named one by one, so nothing else is listed or opened
    schema = T.StructType(IDS.fields[:3])
    found = spark.read.schema(schema).parquet(*files).select("event_id", "event_date")
    return found if since is None else found.where(F.col("event_date") >= since)
