"""Operator 7: drop lines that make up boilerplate of their site, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: A line that only one page of its site has is no boilerplate, however few pages the site has.
RATIO, LEAST_PAGES = 0.1, 2
#: Bytes of hosts and their lists that may be broadcast; beyond, the documents are shuffled to their host's list instead.
MOST_BROADCAST = 16_000_000


def line_key(line):
    """16 bytes that stand for a line: compact to shuffle, and without chance collisions."""
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): the keys of each host's boilerplate lines, with n_pages, the host's rows.

    A line is boilerplate if more than ratio of the host's rows contain it, and least_pages of them at least. A line
    counts once per row. The lists are bounded by the data's shape, not by its size: the ratios of a host's lines add
    up to its mean number of lines per page, so at most (lines per page) / ratio lines can exceed it.
    """
    # Generate runs inside codegen: a row per distinct line of a row, map-side combined before the only shuffle of lines.
    lines = docs.select(F.col(host).alias("host"), F.array_distinct(F.split(F.col(text), "\n")).alias("ls"))
    lines = lines.select("host", F.explode("ls").alias("line")).where(F.col("line") != "")
    counts = lines.groupBy("host", line_key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    totals = docs.groupBy(F.col(host).alias("t_host")).agg(F.count(F.lit(1)).alias("n_pages"))
    found = counts.join(totals, F.col("host").eqNullSafe(F.col("t_host")))
    found = found.where((F.col("n") >= least_pages) & (F.col("n") > F.col("n_pages") * F.lit(ratio)))
    return found.groupBy("t_host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text reduced to the lines that are not their host's boilerplate; adds counts: lines before, lines dropped.

    The other columns pass through as they are; a count whose name docs has already gets underscores in front. Lines are split at newline characters; empty lines are never
    boilerplate. A null text stays null with no lines, a null host is a host of its own, an empty text is one empty line.
    Repeated rows count as pages of their own. Clashing column names are no matter: the added working columns carry
    reserved names.
    """
    bad = boilerplate(docs, host, text, ratio, least_pages).select(F.col("t_host").alias("__b_host"), F.col("keys").alias("__b_keys"))
    # One row per host with boilerplate. Counted first, so that texts stay where they are unless there are too many hosts;
    # then AQE splits the partitions of a hot host.
    bad = cut(bad)
    size = bad.agg(F.sum(F.size("__b_keys") * 32 + F.coalesce(F.octet_length(F.col("__b_host").cast("string")), F.lit(0)) + 64).alias("b")).first().b or 0
    bad = F.broadcast(bad) if size <= MOST_BROADCAST else bad
    out = docs.join(bad, F.col(host).eqNullSafe(F.col("__b_host")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: (x == F.lit("")) | ~F.array_contains(F.col("__b_keys"), line_key(x)))
    kept = F.when(F.col("__b_keys").isNull(), lines).otherwise(kept)
    out = out.withColumn("__kept", kept)
    n = F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    left = F.coalesce(F.when(F.col(text).isNotNull(), F.size("__kept")), F.lit(0)).cast("long")
    names = [next(c for c in ("_" * k + name for k in range(len(docs.columns) + 1)) if c not in docs.columns) for name in counts]
    return out.select(*[F.array_join("__kept", "\n").alias(c) if c == text else F.col(c) for c in docs.columns], n.alias(names[0]), (n - left).alias(names[1]))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with their source as the site."""
    out = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line),
t AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
b AS (SELECT t.source, list(c.line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE n >= 2 AND n > n_pages * 0.1e0 GROUP BY t.source),
k AS (SELECT doc_id, d.source, string_split(text, chr(10)) AS ls,
             list_filter(string_split(text, chr(10)), lambda x: x = '' OR NOT coalesce(list_contains(bad, x), false)) AS kept
      FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM k
"""
