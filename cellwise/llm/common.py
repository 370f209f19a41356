"""Arrow and numpy helpers shared by the text operators, and bucketed intermediate tables.

Texts are read from Arrow buffers as UTF-8 bytes with document offsets, so that words, hashes and
windows of many documents are found in one vectorised pass. Batches are cut into slices of bounded
bytes before that; a single document longer than the bound forms a slice of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.session import scratch_dir

SLICE_BYTES = 2 << 20
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str | int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of ``column``, one row at least."""
    _, at = utf8(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (``[^\\x20\\x09-\\x0D]+``, or runs of ``is_word`` bytes) and, per document, the index of its first word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begins[cuts] = inside[1:-1][cuts]
    stops[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, at)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def packed_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray = _IS_WORD) -> pa.Array:
    """The words as one contiguous Arrow column."""
    flat = data[is_word[data]]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Polynomial hashes of sub-ranges of a 64-bit sequence, modulo 2**64, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.powers, self.inverse = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (sums[high] - sums[low]) * self.inverse[low]


_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTES = Rolling(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every task."""
    sums = _BYTES.prefix(_BYTE_VALUES[data])
    return mix(_BYTES.ranges(sums, starts, ends) + (ends - starts).astype(np.uint64))


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of one byte buffer as a binary column; ``offsets`` in bytes."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def bucketed(df: DataFrame, key: str, buckets: int | None = None, spread: bool = True) -> DataFrame:
    """Write ``df`` once as a table bucketed by ``key`` in the shared warehouse and read it back.

    Later joins and groupings on ``key`` need no further shuffle of this side, and lost executors
    find the table again. The number of buckets follows the session's shuffle partitions.
    """
    spark = df.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"llm_{uuid.uuid4().hex}"
    placed = df.repartition(count, F.col(key)) if spread else df
    placed.write.bucketBy(count, key).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``materialize`` with a denser codec, for intermediate tables that hold texts or ids.

    Parquet asks for the size of its pages and row groups once in a hundred rows at most, and keeps the least and the greatest value of
    every row group up to the end of the file. For rows of megabytes ``rows`` bounds a row group and leaves these values out, so that
    a task holds one row group of its file when it writes or reads it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if rows:
        writer = writer.option("parquet.block.row.count.limit", rows).option("parquet.column.statistics.enabled", "false")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 16 << 20) -> None:
    """Bound the rows and bytes of one Arrow batch, unless the session already asks for less."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= bound):
            spark.conf.set(key, str(bound))


def bucket_bits(chunks: int, per_bucket: int = 1) -> int:
    """Bits of a hash that name a bucket: about one bucket for ``per_bucket`` chunks, 64 to 65,536 of them."""
    return min(16, max(6, (max(1, chunks // per_bucket) - 1).bit_length()))
