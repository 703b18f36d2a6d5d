"""Timings: summaries, speedups, ranking, sections, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sizing import version_number, version_suffix


def summary(times: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, mean, population deviation, max and number of the times of each version."""
    v = F.col(value)
    return times.groupBy(*by).agg(F.min(v).alias("min_t"), F.avg(v).alias("mean_t"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std_t"), F.max(v).alias("max_t"), F.count(v).alias("n"))


def best(times: DataFrame, by: list[str], value: str, name: str = "min_t") -> DataFrame:
    """The least positive time of each group and the number of times; null where there is none."""
    v = F.col(value)
    return times.groupBy(*by).agg(F.min(F.when(v > 0, v)).alias(name), F.count(v).alias("n"))


def running_peak(samples: DataFrame, by: list[str], order: str, attributes: list[str]) -> DataFrame:
    """samples, reduced to one row per group and order, with the largest attribute so far. order is a short axis (days, steps)."""
    top = F.greatest(*[F.max(a) for a in attributes]) if len(attributes) > 1 else F.max(attributes[0])
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return samples.groupBy(*by, order).agg(top.alias("peak")).withColumn("running_peak", F.max("peak").over(so_far))


def stage_sums(times: DataFrame, by: list[str], stage: Column, value: str, stages: list[str]) -> DataFrame:
    """Seconds by stage of each group, one column per stage; a stage that never ran has 0."""
    return times.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(stage == s, F.col(value))), F.lit(0.0)).alias(s) for s in stages])


def throughput(n_candidates: Column, best: Column) -> Column:
    return F.coalesce(n_candidates / F.nullif(best, F.lit(0.0)), F.lit(0.0))


def speedups(best: DataFrame, base: str, version: str = "version", value: str = "min_t", within: list[str] | None = None) -> DataFrame:
    """best with speedup over the base version (null without one) and rank by time, inside each group of within."""
    group = Window.partitionBy(*(within or []))
    ref = F.max(F.when(F.col(version) == base, F.col(value))).over(group)
    order = Window.partitionBy(*(within or [])).orderBy(value, version)
    return best.withColumn("speedup", ref / F.nullif(F.col(value), F.lit(0.0))).withColumn("rank", F.row_number().over(order).cast("long"))


def kernel_share(df: DataFrame, total: str, kernel: str) -> DataFrame:
    return df.withColumn("overhead", F.col(total) - F.col(kernel)).withColumn("kernel_pct", F.coalesce(100 * F.col(kernel) / F.nullif(F.col(total), F.lit(0.0)), F.lit(0.0)))


def natural_order(df: DataFrame, version: str = "version") -> list[Column]:
    """Sort columns: v2 before v10, names of another form last."""
    return [version_number(F.col(version)).asc_nulls_last(), version_suffix(F.col(version))]


def section_boundaries(rows: DataFrame, sections: DataFrame, version: str = "version") -> DataFrame:
    """(section, ord, n, boundary): members present in each section, and how many come before it. sections is a short list."""
    present = rows.select(version).distinct().join(sections, version).groupBy("section", "ord").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return present.withColumn("boundary", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def adjacent(df: DataFrame, order: str, value: str) -> DataFrame:
    """Change against the first row and the row before, in order, of a short list of configurations."""
    w = Window.orderBy(order)
    return df.withColumn("vs_first", F.col(value) - F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("vs_previous", F.col(value) - F.lag(value).over(w))


def markdown_rows(best: DataFrame, version: str = "version") -> DataFrame:
    """A text line per version, as of a Markdown table."""
    show = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.format_string("%.2fx", F.col(c)))
    return best.select(F.col(version), F.concat_ws(" | ", F.col(version), F.format_string("%.3f", F.col("min_t")), F.format_string("%.3f", F.col("mean_t")), show("speedup")).alias("line"))


def load_fraction(df: DataFrame, load: Column, compute: Column) -> DataFrame:
    return df.agg((F.sum(load) / F.nullif(F.sum(load) + F.sum(compute), F.lit(0.0))).alias("load_fraction"))


def threads_scale(rates: DataFrame, mode: str = "mode", rate: str = "rate") -> DataFrame:
    """One row: single rate, best rate of several workers, whether the best exceeds 1.5 times the single one."""
    one = F.max(F.when(F.col(mode) == "single", F.col(rate)))
    most = F.max(F.when(F.col(mode) != "single", F.col(rate)))
    return rates.agg(one.alias("single"), most.alias("best"), (most > 1.5 * one).alias("scales"))
