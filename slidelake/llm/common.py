"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Separators of words: the six ASCII white-space characters. bytes.split() splits on the same six.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written under the checkpoint folder that all executors share (spark.checkpoint.dir)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table under the shared folder: smaller than a checkpoint for narrow rows, and read by column.

    The tables lie in the session's own checkpoint folder and go when that is removed; a lazily read result needs them.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words, without building a second array: split and take off the empty ends."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    head = F.element_at(parts, 1) == F.lit("")
    tail = F.element_at(parts, -1) == F.lit("")
    n = F.size(parts)
    return F.when(n == 1, F.when(head, 0).otherwise(1)).otherwise(n - head.cast("int") - tail.cast("int")).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def small(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def text_runs(column: pa.Array, most: int = 1_000_000, step: int = 64) -> Iterator[tuple[int, list[bytes | None]]]:
    """(number of the first text, texts) of runs of at most most bytes of a column, or of one longer text; each text whole.

    Only a run and step texts are Python objects at a time, whatever the size of the batch.
    """
    first, held, out = 0, 0, []
    for k in range(0, len(column), step):
        for i, text in enumerate(column.slice(k, step).to_pylist(), start=k):
            if out and held + len(text or b"") > most:
                yield first, out
                first, held, out = i, 0, []
            held += len(text or b"")
            out.append(text)
    if out:
        yield first, out


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While jobs of long rows run: Arrow batches of at most rows rows, so buffers on either side stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def tidy() -> None:
    """At the end of a task in a Python worker that lives on: give freed memory back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


Query = Callable[[SparkSession, str], DataFrame]
