"""Tile counts, their rollup to patches, and the tissue filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import BLACK, REJECT, WHITE, is_black, is_white, keeps, status
from .grid import candidates, check_geometry, tile_cover


def tile_counts(pixels: DataFrame, keys: list[str], gray: str = "gray", white: int = WHITE, black: int = BLACK) -> DataFrame:
    """(keys, white, black, n) of a relation of pixels; partial counts are made before the shuffle."""
    g = F.col(gray)
    return pixels.groupBy(*keys).agg(F.count_if(is_white(g, white)).alias("white"), F.count_if(is_black(g, black)).alias("black"), F.count(F.lit(1)).alias("n"))


def rollup(cover: DataFrame, counts: DataFrame, on: list[str], patch: list[str], empty_pixels: int) -> DataFrame:
    """Patch sums of tile counts. A tile without counts is empty: all its empty_pixels are black.

    Counts are one row per tile, made before this join, so a tile that several patches share is counted once.
    """
    c = counts.select(*[F.col(k).alias(f"__{k}") for k in on], *[F.col(k).alias(f"__{k}") for k in ("white", "black", "n")])
    cond = [F.col(k) == F.col(f"__{k}") for k in on]
    joined = cover.join(c, cond, "left")
    total = lambda k, default: F.sum(F.coalesce(F.col(f"__{k}"), F.lit(default))).cast("long").alias("total" if k == "n" else k)
    return joined.groupBy(*patch).agg(total("white", 0), total("black", empty_pixels), total("n", empty_pixels))


def tissue_patches(slides: DataFrame, counts: DataFrame, patch: int = 1024, stride: int = 1024, tile: int = 512, empty_pixels: int | None = None, reject: float = REJECT, tiles_per_row: str = "ntx") -> DataFrame:
    """Kept patches (slide_id, x, y, white, black, total) of slides (slide_id, w, h, tiles_per_row) with tile counts."""
    check_geometry(patch, stride, tile, tile)
    cover = tile_cover(candidates(slides.select("slide_id", "w", "h", tiles_per_row), patch, stride), patch, tile, tile, tiles_per_row)
    sums = rollup(cover.select("slide_id", "x", "y", "tile_id"), counts, ["slide_id", "tile_id"], ["slide_id", "x", "y"], tile * tile if empty_pixels is None else empty_pixels)
    return sums.where(keeps(F.col("white"), F.col("black"), F.col("total"), reject))


def decisions(sums: DataFrame, reject: float = REJECT) -> DataFrame:
    """sums with both shares and the decision in words."""
    n = F.nullif(F.col("total").cast("double"), F.lit(0.0))
    out = sums.withColumn("white_ratio", F.col("white") / n).withColumn("black_ratio", F.col("black") / n)
    return out.withColumn("status", status(F.col("white"), F.col("black"), F.col("total"), reject))


def tile_patches(cover: DataFrame, tile: list[str], patch: list[str]) -> DataFrame:
    """The inverted bridge: for each tile the patches that use it. A tile lies in as many patches as overlap it."""
    return cover.groupBy(*tile).agg(F.sort_array(F.collect_set(F.struct(*patch))).alias("patches"))


def tile_use(cover: DataFrame, tile: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """For each tile how many patches use it and where the first begins; sums of partial counts, no list of patches."""
    return cover.groupBy(*tile).agg(F.count(F.lit(1)).alias("n_patches"), F.min(y).alias("first_y"), F.min(x).alias("first_x"))


def routed_counts(pixels: DataFrame, group: str, keys: list[str], least: int, gray: str = "gray", white: int = WHITE, black: int = BLACK) -> DataFrame:
    """(group, keys, white, black, n, route): tile counts by one of two ways with one answer.

    Groups of at least least tiles are counted in Arrow batches, the others by the relational aggregate. Both give partial
    sums before the shuffle, so the route changes where the work is done and nothing else.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pixels.groupBy(group).agg(F.count_distinct(*keys).alias("__tiles")).select(F.col(group).alias("__group"), F.when(F.col("__tiles") >= least, "batch").otherwise("rows").alias("route"))
    src = pixels.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).select(group, *keys, F.col(gray).cast("int").alias("__gray"), "route")
    names = [group, *keys]

    def run(batches):
        for b in batches:
            g = b.column(b.schema.get_field_index("__gray"))
            t = pa.table({**{c: b.column(c) for c in names}, "white": pc.cast(pc.greater(g, white), pa.int64()), "black": pc.cast(pc.less(g, black), pa.int64()), "n": pa.array([1] * b.num_rows, pa.int64())})
            sums = t.group_by(names).aggregate([("white", "sum"), ("black", "sum"), ("n", "sum")])
            yield from sums.select([*names, "white_sum", "black_sum", "n_sum"]).rename_columns([*names, "white", "black", "n"]).to_batches()

    schema = ", ".join([f"`{c}` {src.schema[c].dataType.simpleString()}" for c in names] + ["white long", "black long", "n long"])
    wide = src.where("route = 'batch'").drop("route").mapInArrow(run, schema)
    wide = wide.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("white", "black", "n")]).withColumn("route", F.lit("batch"))
    narrow = tile_counts(src.where("route = 'rows'"), names, "__gray", white, black).withColumn("route", F.lit("rows"))
    return wide.unionByName(narrow)
