"""A Bloom filter of bounded size over 64-bit keys, to keep rows that cannot match out of a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS, PER_KEY, HASHES = 1 << 27, 12, 3


class Bloom:
    """bits: 64-bit words. The size is fixed before keys are added, so it never grows with the data beyond MOST_BITS."""

    def __init__(self, n_keys: int) -> None:
        self.n_bits = int(min(MOST_BITS, max(1 << 16, 1 << int(np.ceil(np.log2(max(1, n_keys) * PER_KEY))))))
        self.bits = np.zeros(self.n_bits // 64, np.uint64)

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = keys.view(np.uint64)
        step = (h >> np.uint64(33)) | np.uint64(1)
        for k in range(HASHES):
            yield (h + np.uint64(k) * step) & np.uint64(self.n_bits - 1)

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


def bloom_of(keys: DataFrame, n_keys: int) -> Bloom:
    """The filter of (key long). Tasks fill their own, words are merged in Spark, and at most the filter's words come back."""
    out = Bloom(n_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(n_keys)
        for b in batches:
            own.add(b.column(0).to_numpy(zero_copy_only=False))
        at = np.nonzero(own.bits)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.bits[at].view(np.int64))], names=["word", "bits"])

    rows = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def sift(df: DataFrame, key: str, bloom: Bloom, inside: bool = True) -> DataFrame:
    """The rows whose key (long) the filter may hold, or with inside=False the others, which it surely does not hold."""
    shared = df.sparkSession.sparkContext.broadcast(bloom)
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.may_hold(b.column(at).to_numpy(zero_copy_only=False)) == inside))

    return df.mapInArrow(run, df.schema)
