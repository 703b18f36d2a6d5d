"""Facade: a slide's tissue patches as an indexed collection with a transform."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.pixels import BLACK, FAILED, MEANS, REJECT, STDS, WHITE
from .operators.grid import kept_index
from .operators.tissue import decisions
from .plans.slides import patch_counts, patch_pixels


def to_tensor(pixels: np.ndarray) -> np.ndarray:
    """(rows, columns, 3) bytes to (3, rows, columns) floats from 0 to 1."""
    return pixels.transpose(2, 0, 1).astype(np.float32) / np.float32(255)


def normalised(pixels: np.ndarray) -> np.ndarray:
    return (to_tensor(pixels) - np.array(MEANS, np.float32)[:, None, None]) / np.array(STDS, np.float32)[:, None, None]


class SlideDataset:
    """Patches of one slide, or of all slides of a folder, that hold tissue, in row-major order.

    transform: applied to the (rows, columns, 3) uint8 array of a patch; default to_tensor. Raises OSError if a slide cannot
    be opened and ValueError if no patch is kept.
    """

    def __init__(self, spark: SparkSession, path: str, patch_size: int = 1024, stride: int = 1024, transform: Callable[[np.ndarray], Any] | None = None, white_pixel_threshold: int = WHITE, black_pixel_threshold: int = BLACK, rejection_ratio: float = REJECT, precision: str = "luma") -> None:
        self.spark, self.patch, self.stride, self.transform = spark, patch_size, stride, transform or to_tensor
        self.reject = rejection_ratio
        # Counts are a few numbers per candidate; they are kept, so decisions, length and retrieval do not decode again.
        self.counts = patch_counts(spark, path, patch_size, stride, white_pixel_threshold, black_pixel_threshold, precision).persist()
        good = ~F.col("damaged") & F.col("status").startswith("selected")
        self.coordinates: DataFrame = kept_index(self.decisions().where(good).select("slide_id", "path", "x", "y"), "path")
        # Numbers run through the slides: a row per slide goes through the global window, patches never do.
        per = self.coordinates.groupBy("slide_id", "path").agg(F.count(F.lit(1)).alias("__n"))
        earlier = Window.orderBy("slide_id", "path").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select(F.col("path").alias("__path"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
        self.coordinates = self.coordinates.join(per, F.col("path") == F.col("__path")).withColumn("row", (F.col("__first") + F.col("idx")).cast("long")).drop("__path", "__first").persist()
        self._n = self.coordinates.count()
        if not self._n:
            raise ValueError("no patch holds tissue; other thresholds may keep some")

    def decisions(self) -> DataFrame:
        """Every candidate with its shares and the decision in words."""
        out = decisions(self.counts, self.reject)
        return out.withColumn("status", F.when(F.col("damaged"), F.lit(FAILED)).otherwise(F.col("status")))

    def __len__(self) -> int:
        return self._n

    def _array(self, r) -> np.ndarray:
        return np.frombuffer(bytes(r.rgb), np.uint8).reshape(self.patch, self.patch, 3)

    def __getitem__(self, i: int) -> tuple[Any, tuple[int, int]]:
        i = i + self._n if i < 0 else i
        if not 0 <= i < self._n:
            raise IndexError(i)
        r = patch_pixels(self.coordinates.where(F.col("row") == i), self.patch).first()
        return self.transform(self._array(r)), (r.x, r.y)

    def patches(self) -> DataFrame:
        return patch_pixels(self.coordinates, self.patch)

    def batches(self, size: int, shuffle: bool = False, drop_last: bool = False, seed: int = 0) -> Iterator[tuple[list[Any], list[tuple[int, int]]]]:
        """Batches in order or in a seeded random order, one partition in memory at a time."""
        order = F.xxhash64(F.lit(seed), "row") if shuffle else F.col("row")
        items, at = [], []
        for r in patch_pixels(self.coordinates.orderBy(order), self.patch).toLocalIterator():
            items.append(self.transform(self._array(r)))
            at.append((r.x, r.y))
            if len(items) == size:
                yield items, at
                items, at = [], []
        if items and not drop_last:
            yield items, at
