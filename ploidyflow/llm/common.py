"""Helpers that the operators of this subpackage share.

Text operators run in Arrow batches: the bytes of many documents lie side by
side in one buffer, so words, hashes and windows are numpy operations over the
buffer and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import discard, marked, release, shared_path, shared_root, written  # noqa: F401  for the operators

#: Bytes of text that are worked on at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20
#: Rows in an Arrow batch sent to Python, so that a batch of long texts stays small.
BATCH_ROWS = 512

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd, and 3 modulo 8, so that powers of it differ in their low bits.
_BASE = 0x9E3779B97F4A7C13
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: A random number for each byte.
BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)


# ---------------------------------------------------------------- Spark side


def session_setup(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows, and lets exchanged files go when a query ends, as results are written tables."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows to an Arrow batch, for tables of long rows that are read and written within."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def local_of(uri: str) -> str | None:
    """The local path of a file: URI, or None for any other store."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def documents_of(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text, and columns to carry: others, clashing names among them, are left out.

    Rows without doc_id are no documents; a null text counts as empty.
    """
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), *carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


# --------------------------------------------------------------- buffer side


def text_slices(batches, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds) with at most so many bytes, or one document, at a time.

    bounds has one more entry than rows: document i is bytes[bounds[i]:bounds[i+1]].
    """
    for batch in batches:
        texts = batch.column(column)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        n, at = len(texts), texts.offset
        if n == 0:
            continue
        wide = pa.types.is_large_string(texts.type)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t-\\r]+, and for each document the number of words before it."""
    is_word = _WORD[data]
    start, end = is_word.copy(), is_word.copy()
    start[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    full = bounds[1:] > bounds[:-1]
    first, last = bounds[:-1][full], bounds[1:][full] - 1
    start[first] = is_word[first]
    end[last] = is_word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE, inverse: int = _BASE_INV) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up, down = (np.full(size, x, U64) for x in (base, inverse))
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_sums(values: np.ndarray, base: int = _BASE, inverse: int = _BASE_INV) -> np.ndarray:
    """Prefix sums of values[i] * base**i: range_hash() makes any window's hash of them."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values), base, inverse)[0][: len(values)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE, inverse: int = _BASE_INV) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(len(sums), base, inverse)[1][starts])


#: What the lanes of a string are told apart by, and the lanes hashed at once.
_LANE, _LANES = 0xD1342543DE82EF95, 1 << 19


def lanes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 8 bytes, or fewer, from each start to its end as a number; at most 8 count."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    every = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    short = np.clip(8 - (ends - starts), 0, 7).astype(U64) << U64(3)
    return ((every[starts] << short) >> short) * (ends > starts)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every word's bytes; another seed gives an independent one.

    A word is cut into lanes of 8 bytes. Each lane is mixed by itself, then with its
    number, and the sum of all is mixed with the length. No polynomial is involved, so no order of
    letters makes different words equal but by a chance of 2**-64.
    """
    key = U64(seed * 0xA0761D6478BD642F + 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    size = ends - starts
    total = mixed(lanes_of(data, starts, ends) + key)
    long = np.flatnonzero(size > 8)
    more = (size[long] - 1) >> 3  # lanes after the first
    upto = np.cumsum(more)
    at = 0
    while at < len(long):
        last = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _LANES, "right")))
        own, n = long[at:last], more[at:last]
        number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + 1
        word = np.repeat(own, n)
        lane = lanes_of(data, starts[word] + 8 * number, ends[word])
        lane = mixed(mixed(lane + key) + number.astype(U64) * U64(_LANE))
        total[own] += np.add.reduceat(lane, np.cumsum(n) - n)
        at = last
    return mixed(total + size.astype(U64) * U64(_LANE))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def string_list(data: bytes, bounds: np.ndarray) -> list[str]:
    """The documents of a slice as Python strings."""
    text = memoryview(data)
    return [str(text[a:b], "utf-8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
