"""What the operators of this subpackage share: Arrow mapping, hashing of words, written tables.

Nothing outside the subpackage imports it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.sources.shared import written  # noqa: F401  the operators take it from here

#: Rows in an Arrow batch that Spark sends to Python, and bytes of text that a kernel works on at once.
BATCH_ROWS, KERNEL_BYTES = 256, 2 << 20


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what is run inside, afterwards as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts do not fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of a column take about ``most`` bytes; a longer text stays whole, alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        if sizes.sum() <= most:
            if batch.num_rows:
                yield batch
            continue
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


def map_text(df: DataFrame, column: str, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``kernel`` over each piece of a table; a lost task is simply run again, as a kernel keeps no state that matters."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            yield kernel(piece)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, by: int) -> Column:
    """crc32 of a column as text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n-1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: each bit of the result depends on each bit of the argument."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings and the offsets of each; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words between white space [\\x20\\x09-\\x0D], where each begins, and words before each bound.

    A word never crosses a bound.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    if not len(data):
        return none
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    terms = _BYTE[data[at]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), starts, np.searchsorted(starts, bounds)
