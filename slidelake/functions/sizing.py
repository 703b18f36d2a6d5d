"""Batch sizes from memory, sort keys of version names and other scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of one decoded 512 x 512 tile with its planes.
TILE_BYTES = 884_736


def auto_batch(free: Column, share: float = 0.35, least: int = 64, most: int = 8192) -> Column:
    """Tiles per batch that fit a share of free bytes, between least and most."""
    return F.least(F.greatest(F.floor(free * F.lit(share) / F.lit(TILE_BYTES)), F.lit(least)), F.lit(most)).cast("long")


def budget_batch(gigabytes: Column, least: int = 32) -> Column:
    return F.greatest(F.floor(F.floor(gigabytes * F.lit(1e9)) / F.lit(TILE_BYTES)), F.lit(least)).cast("long")


def version_number(name: Column) -> Column:
    """The number after a leading v, null if there is none; sort nulls last."""
    return F.nullif(F.regexp_extract(name, r"^v(\d+)(\w*)", 1), F.lit("")).cast("long")


def version_suffix(name: Column) -> Column:
    return F.when(version_number(name).isNull(), name).otherwise(F.regexp_extract(name, r"^v(\d+)(\w*)", 2))


def bandwidth_gbs(mem_clock_khz: Column, bus_bits: Column) -> Column:
    return 2 * mem_clock_khz * 1000.0 * bus_bits / 8 / 1e9


def tera_flops(sm: Column, cores_per_sm: Column, clock_khz: Column) -> Column:
    return 2 * sm * cores_per_sm * clock_khz * 1000.0 / 1e12


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stage_text(stages: dict[str, Column]) -> Column:
    """Non-zero stage times as 'name 1.23', joined by commas; '-' if there are none."""
    parts = [F.when(c > 0, F.concat(F.lit(f"{k} "), F.format_string("%.2f", c))) for k, c in stages.items()]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("-"))
