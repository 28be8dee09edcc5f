"""What the corpus operators share: stage tables, sizes, numbering, and Arrow text as flat arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.session import shared_dir
from hostpulse.sources.tables import delete_folder, folder_uri

#: Text bytes that a Python worker turns into arrays at once; a longer text is a piece of its own.
PIECE_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stages_folder(spark: SparkSession) -> str:
    return folder_uri(spark, f"{shared_dir(spark)}/corpus/{spark.sparkContext.applicationId}")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that all executors and the driver reach."""
    return f"{stages_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_stages(spark: SparkSession) -> None:
    """Remove all stage tables and files that the corpus operators of this application wrote, once no result needs them."""
    delete_folder(spark, stages_folder(spark))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a stage as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    # nobody waits for a stage's marker; it would be two more files, made by the driver
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files of a stage (as ``staged`` returned it) that nothing will read again."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)


#: Documents (each with what belongs to it) that a task of a stage takes, once their number is known.
DOCUMENTS_PER_TASK = 10_000


def tasks_for(df: DataFrame) -> int:
    """Tasks, and so files, of the stages made of these documents (already written, so that counting reads no column).

    One for every core at least, and more as the documents grow: a shuffle of many partitions would otherwise end in as many small files.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, splits(df.count(), DOCUMENTS_PER_TASK))


#: Rows of a counted table up to which it is broadcast.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """The table (narrow rows, already written) marked for broadcast where a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of the table is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_bytes(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, as two numbers on the driver."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def splits(amount: int, per_split: int) -> int:
    return max(1, -(-amount // per_split))


def numbered(df: DataFrame, order: list[Column], *, within: list[str], column: str, per_bin: int, rows: int) -> DataFrame:
    """Add gapless numbers from 0 per ``within``, without bringing one of its groups into one task.

    Rows are dealt into hash bins of about ``per_bin`` rows, numbered inside each bin, and moved up by
    the rows of the bins before; only the counts per bin are cumulated.
    """
    from pyspark.sql import Window

    bins = max(64, splits(rows, per_bin))
    dealt = df.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)))
    keys = [*within, "_bin"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = ranked.join(offsets, keys)
    return out.withColumn(column, F.col("_rank") - 1 + F.col("_offset")).drop("_bin", "_rank", "_offset")


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of text each, at least one row."""
    if batch.num_rows == 0:
        return
    ends = flat(batch.column(column))[1][1:]
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; a null is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and their offsets; a null is empty."""
    body, offsets = flat(texts)
    points = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(body):
        return points, offsets
    starts = np.zeros(len(body) + 1, np.int64)
    np.cumsum((body & 0xC0) != 0x80, out=starts[1:])
    return points, starts[offsets]


def spans_to_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many spans, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}
#: A second base, modulo a prime: sequences whose sums modulo 2^64 agree by their form alone differ here.
_PRIME, _ROOT = (1 << 31) - 1, 7


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _POWERS[base] = known
    return known[:n]


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^64 modulo the prime."""
    prime, bits = np.uint64(_PRIME), np.uint64(31)
    x = (x & prime) + (x >> bits)
    x = (x & prime) + (x >> bits)
    return np.where(x >= prime, x - prime, x)


def _prime_powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(-base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.ones(1, np.uint64)
        while len(known) < size:
            known = np.concatenate([known, _reduced(known * np.uint64(pow(base, len(known), _PRIME)))])
        _POWERS[-base] = known
    return known[:n]


class SpanHash:
    """64-bit hashes of any spans of one sequence, from running sums.

    Each value (already a mixed 64-bit number) is multiplied by a power of an odd base; a span's hash is
    the sum over it, moved back to power 0 by the inverse power, then mixed with the length.  Modulo 2^64 alone, long spans of two
    values in certain orders agree whatever the base (from 1,024 values on for certain); so the hash of a span
    also holds such a sum modulo the prime 2^31 - 1.  ``fixed`` leaves that out and is for short widths only: below 128 values
    two chosen spans agree in at most 21 bits by their form, and the other 43 by chance.
    """

    def __init__(self, mixed: np.ndarray):
        self.mixed = mixed
        self.sums = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed * _powers(_BASE, len(mixed)), out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), len(mixed) + 1)
        self.second: np.ndarray | None = None

    def _second(self) -> np.ndarray:
        if self.second is None:
            made = (self.mixed >> np.uint64(33)) * _prime_powers(_ROOT, len(self.mixed))
            made = (made & np.uint64(_PRIME)) + (made >> np.uint64(31))
            self.second = np.zeros(len(made) + 1, np.uint64)
            np.cumsum(made, out=self.second[1:])
        return self.second

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        second = self._second()
        other = _reduced(second[ends] - second[starts]) * _prime_powers(pow(_ROOT, -1, _PRIME), len(second))[starts]
        raw += _reduced(other) * np.uint64(0xA24BAED4963EE407)
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def fixed(self, width: int) -> np.ndarray:
        """Hashes of all spans of one width, by their start."""
        raw = self.sums[width:] - self.sums[:-width]
        raw *= self.back[: len(raw)]
        return mix(raw)
