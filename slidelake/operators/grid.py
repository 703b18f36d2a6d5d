"""Patch grids over slides, the tiles they cover, and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def candidates(slides: DataFrame, patch: int, stride: int, w: str = "w", h: str = "h") -> DataFrame:
    """slides with a row (x, y) per window that lies wholly inside. Slides smaller than the patch give none.

    Two generators in one stage, without a shuffle; the bounds carry the in-bounds condition.
    """
    fits = slides.where((F.col(w) >= patch) & (F.col(h) >= patch))
    steps = lambda c: F.sequence(F.lit(0).cast("long"), (F.col(c) - patch).cast("long"), F.lit(stride).cast("long"))
    return fits.withColumn("y", F.explode(steps(h))).withColumn("x", F.explode(steps(w)))


def candidate_count(w: Column, h: Column, patch: Column | int, stride: Column | int) -> Column:
    """Number of candidates without enumerating them."""
    patch, stride = (F.lit(v) if isinstance(v, int) else v for v in (patch, stride))
    per = lambda n: F.floor((n - patch) / stride) + 1
    return F.when((w >= patch) & (h >= patch), per(w) * per(h)).otherwise(F.lit(0)).cast("long")


def check_geometry(patch: int, stride: int, tile_w: int, tile_h: int) -> None:
    """Patches must be unions of whole tiles for counts to add up; overlapping patches are fine."""
    for what, n, d in (("patch size", patch, tile_w), ("patch size", patch, tile_h), ("stride", stride, tile_w), ("stride", stride, tile_h)):
        if n % d:
            raise ValueError(f"{what} {n} is not a multiple of the tile size {d}")


def tile_cover(cand: DataFrame, patch: int, tile_w: int, tile_h: int, tiles_per_row: str) -> DataFrame:
    """A row per (candidate, tile): tile_id counts row by row. Shuffle-free."""
    nx, ny = patch // tile_w, patch // tile_h
    at = F.expr(f"explode(sequence(0, {nx * ny - 1}))")
    out = cand.withColumn("d", at)
    row = F.expr(f"y div {tile_h}") + F.expr(f"d div {nx}")
    col = F.expr(f"x div {tile_w}") + F.col("d") % nx
    return out.withColumn("tile_id", row * F.col(tiles_per_row) + col).drop("d")


def unaligned_cover(cand: DataFrame, patch: int, tile_w: int, tile_h: int, tiles_per_row: str) -> DataFrame:
    """As tile_cover for any geometry: adds the part of the tile that the patch takes (x0, y0, x1, y1 inside the tile)."""
    out = cand.withColumn("ty", F.explode(F.sequence(F.expr(f"y div {tile_h}"), F.expr(f"(y + {patch - 1}) div {tile_h}"))))
    out = out.withColumn("tx", F.explode(F.sequence(F.expr(f"x div {tile_w}"), F.expr(f"(x + {patch - 1}) div {tile_w}"))))
    x, y, tx, ty = (F.col(c) for c in ("x", "y", "tx", "ty"))
    zero = F.lit(0).cast("long")
    return out.select(
        *cand.columns,
        (ty * F.col(tiles_per_row) + tx).alias("tile_id"),
        F.greatest(zero, x - tx * tile_w).alias("x0"),
        F.greatest(zero, y - ty * tile_h).alias("y0"),
        F.least(F.lit(tile_w).cast("long"), x + patch - tx * tile_w).alias("x1"),
        F.least(F.lit(tile_h).cast("long"), y + patch - ty * tile_h).alias("y1"),
    )


def kept_index(kept: DataFrame, slide: str = "slide_id") -> DataFrame:
    """Row-major position of each kept patch in its slide, from 0."""
    w = Window.partitionBy(slide).orderBy("y", "x")
    return kept.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


#: Quantiles of the order that bound the buckets of a prefix sum; rows that a bucket is meant to hold.
QUANTILES, PER_BUCKET = 1000, 500_000


def prefix_sums(df: DataFrame, order: str, by: list[str] | None = None, value: Column | None = None, then: list[str] | None = None, name: str = "before", per_bucket: int = PER_BUCKET) -> DataFrame:
    """df with name: the sum of value (default: the number of rows) over the rows that stand before, in their group of by.

    order is a numeric column, then breaks its ties. Rows are cut into buckets at quantiles of order, so that no task holds
    a hot group or the whole table: buckets are summed, their sums are offsets (at most QUANTILES rows a group), and rows are
    summed inside their bucket. A bucket depends on the row alone. Null orders come first.
    """
    by, value = by or [], F.lit(1) if value is None else value
    at = [float(k) / QUANTILES for k in range(1, QUANTILES)]
    got = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col(order).cast("double"), at, 10_000).alias("q")).first()
    want = min(QUANTILES, -(-got.n // per_bucket)) if got.n else 1
    bounds = sorted({got.q[k * QUANTILES // want - 1] for k in range(1, want)}) if got.q else []
    bucket = F.size(F.filter(F.array(*[F.lit(q) for q in bounds]), lambda q: q < F.col(order).cast("double"))) if bounds else F.lit(0)
    df = df.withColumn("__bucket", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(bucket)).withColumn("__value", value)
    sums = df.groupBy(*by, "__bucket").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__bucket") == F.col("__b")]
    inside = Window.partitionBy(*by, "__bucket").orderBy(order, *(then or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.join(sums, on).withColumn(name, (F.col("__offset") + F.sum("__value").over(inside) - F.col("__value")).cast("long"))
    return out.drop("__bucket", "__value", "__b", "__offset", *[f"__{c}" for c in by])


def batch_slots(df: DataFrame, by: list[str], order: str, batch: int, slots: int) -> DataFrame:
    """Number of the batch a row falls into, in order within its group, and the slot that the batch takes in turn."""
    out = prefix_sums(df, order, by, name="chunk").withColumn("chunk", F.floor(F.col("chunk") / batch).cast("long"))
    return out.withColumn("slot", (F.col("chunk") % slots).cast("long"))


def first_batches(df: DataFrame, order: list[str], batch: int, n: int = 5) -> DataFrame:
    """The rows of the first n batches in order, but always fewer than all batches; a top-k, without a full sort."""
    batches = -(-df.count() // batch)
    return df.orderBy(*order).limit(batch * max(0, min(n, batches - 1)))


def first_seen(df: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, compact): distinct keys numbered from 0 by their first position, which must be numeric; equal positions share a number."""
    firsts = df.groupBy(key).agg(F.min(order).alias("first_at"))
    places = prefix_sums(firsts.select("first_at").distinct(), "first_at", name="compact").select(F.col("first_at").alias("__at"), "compact")
    return firsts.join(places, F.col("first_at").eqNullSafe(F.col("__at"))).select(key, "compact")


def sampling_grid(slides: DataFrame, patch: int, n: int, w: str = "w", h: str = "h") -> DataFrame:
    """About n evenly spread positions: the whole root of n per axis, row-major, cut at n."""
    root = int(n**0.5)
    step = lambda c, i: F.lit(0) if root < 2 else F.floor((F.col(c) - patch) * F.col(i) / F.lit(root - 1))
    out = slides.where((F.col(w) >= patch) & (F.col(h) >= patch))
    out = out.withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(root - 1)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(root - 1))))
    out = out.where(F.col("iy") * root + F.col("ix") < n)
    return out.withColumn("x", step(w, "ix").cast("long")).withColumn("y", step(h, "iy").cast("long")).drop("ix", "iy")


def diagonal(slides: DataFrame, patch: int, n: int, w: str = "w", h: str = "h") -> DataFrame:
    out = slides.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = lambda c: F.least(F.col("i") * patch, F.col(c) - patch).cast("long")
    return out.withColumn("x", at(w)).withColumn("y", at(h)).drop("i")


def centre(slides: DataFrame, patch: int, w: str = "w", h: str = "h") -> DataFrame:
    at = lambda c: F.floor((F.col(c) - patch) / 2).cast("long")
    return slides.withColumn("x", at(w)).withColumn("y", at(h))


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of short lists of parameters (tens of rows), for sweeps over strides, sizes or versions."""
    import itertools

    rows = list(itertools.product(*values.values()))
    return spark.createDataFrame(rows, list(values))
