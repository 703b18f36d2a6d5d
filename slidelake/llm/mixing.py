"""Operator 5: mix sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, n_words, table

#: Weights dealt to the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets by source from (source, size) rows: share x all sizes, dealt by weight, none above most x its source.

    The excess of capped sources is dealt again by weight until none is above. That is the level L with
    sum(min(w L, cap)) = total: with the sources by cap / w, the first k are capped, and k is the least number for
    which the level of the others stays at or below the next cap / w. One row per source goes through the global
    windows; documents never do.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(kinds, (F.row_number().over(order) - 1) % len(weights) + 1))
    every = Window.partitionBy()
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    per = per.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
    per = per.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left_weight"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    per = per.withColumn("level", F.max(fits).over(every))
    return per.select("source", "source_size", "n_rows", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", bucket_rows: int = 5_000) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target, taken; one row per input row.

    A source's documents are ordered by a hash key of the id. It takes whole epochs while its budget (the target
    rounded down) holds them, then the head of the order, cut inside the document at which the budget ends.

    The prefix sums are distributed: keys are uniform, so fixed key ranges cut each source into buckets of about
    bucket_rows rows, whatever its share of all rows. Bucket totals are summed into offsets (one row per bucket), and
    rows are ranged and summed inside their bucket only. Nothing depends on sampling or on partitions, so reruns agree.

    Nulls: a null text has size 0, a null source is a source of its own and comes last, a null doc_id is hashed as the
    empty text. Equal keys are ordered by id and size; rows equal in those are interchangeable. Empty tables give no
    rows. Other columns are ignored.
    """
    rows = cut(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size")))
    targets = cut(source_targets(rows, share, most, weights)).select(F.col("source").alias("t_source"), "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / bucket_rows)).alias("n_buckets"))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # One row per source: AQE broadcasts it if its size allows, and splits the hot source if not.
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("key", key)
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(at * F.col("n_buckets") / F.lit(2**32)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.col("offset") + F.sum("size").over(within) - F.col("size"))
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0e0, 1.0e0, 2.0e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             2.0e0 * source_size AS cap, 1.5e0 * (SELECT sum(source_size) FROM s) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER f, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER f, 0)) AS level
      FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT max(level) FROM l WHERE level <= cap / weight), 1e300)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""
