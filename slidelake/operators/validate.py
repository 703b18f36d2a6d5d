"""Comparison of kept sets and of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import prefix_sums


def compare_sets(base: DataFrame, test: DataFrame, key: list[str]) -> DataFrame:
    """One row: n_base, n_test, n_agree, n_missing, n_extra, jaccard, precision, recall, f1, passed. Empty unions agree."""
    a = base.select(*key).distinct().withColumn("in_base", F.lit(1))
    b = test.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct().withColumn("in_test", F.lit(1))
    both = a.join(b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "full_outer")
    count = lambda c, name: F.count_if(c).alias(name)
    old, new = F.col("in_base").isNotNull(), F.col("in_test").isNotNull()
    n = both.agg(count(old, "n_base"), count(new, "n_test"), count(old & new, "n_agree"), count(old & ~new, "n_missing"), count(~old & new, "n_extra"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(1.0))
    n = n.withColumn("jaccard", share(F.col("n_agree"), F.col("n_agree") + F.col("n_missing") + F.col("n_extra")))
    n = n.withColumn("precision", share(F.col("n_agree"), F.col("n_test"))).withColumn("recall", share(F.col("n_agree"), F.col("n_base")))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return n.withColumn("f1", f1).withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def first_differences(base: DataFrame, test: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    """(side, rank, key): the n smallest missing and extra keys, in the order of the key's columns."""

    def side(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        gone = a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_anti")
        w = Window.partitionBy("side").orderBy(*key)
        return gone.withColumn("side", F.lit(name)).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)

    return side(base, test, "missing").unionByName(side(test, base, "extra"))


def identical_order(a: DataFrame, b: DataFrame, key: list[str], order_a: Column, order_b: Column, then: list[str] | None = None) -> DataFrame:
    """One row: whether both are the same sequence. Orders are numeric; then breaks their ties."""

    def placed(df: DataFrame, order: Column, tag: str) -> DataFrame:
        return prefix_sums(df.select(*dict.fromkeys([*key, *(then or [])]), order.alias("__order")), "__order", then=then, name=f"p{tag}").select(f"p{tag}", F.struct(*key).alias(f"k{tag}"))

    both = placed(a, order_a, "a").join(placed(b, order_b, "b"), F.col("pa") == F.col("pb"), "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.col("ka").eqNullSafe(F.col("kb"))), F.lit(True)).alias("identical_order"))


def all_pass(checks: DataFrame, by: list[str], passed: str = "passed") -> DataFrame:
    """(by, n, n_failed, passed): whether every check of a group passed; a check without an answer has not."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    return checks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("n_failed"), F.bool_and(ok).alias("passed"))


def array_errors(df: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """One row: largest, mean and L2 error of two columns, share within tolerance, whether all are equal."""
    d = F.abs(F.col(a) - F.col(b)).cast("double")
    return df.agg(
        F.max(d).alias("max_error"),
        F.avg(d).alias("mean_error"),
        F.sqrt(F.sum(d * d)).alias("l2_error"),
        F.avg((d <= tolerance).cast("double")).alias("match_rate"),
        F.bool_and(F.col(a) == F.col(b)).alias("exact"),
    )
