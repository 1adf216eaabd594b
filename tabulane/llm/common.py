"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HELD_OUT = 2  # remainder of crc32(doc_id as text) modulo 4 that no model learns from


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents no model learns from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def over_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """Run `work` over the Arrow batches of each partition; it yields dicts of equally long columns."""
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, fields)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null reads as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (multiply and shift; wraps)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64, kept per process up to a few MB."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if size <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


class RangeHash:
    """64-bit hashes of byte ranges of one buffer: a polynomial over a prefix sum, then spread.

    Equal bytes give equal hashes wherever the range lies and whatever buffer it is in.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, n), out=self.sums[1:])
        self.undo = _powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.undo[start] + (end - start).astype(np.uint64))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file of a byte-level vocabulary: base64 of the bytes, then the rank. Its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def partitions(spark: SparkSession) -> int:
    """Parts that packed rows are dealt to; follows the session's shuffle size, which the user sizes to the input."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
