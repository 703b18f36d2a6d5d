"""Operator 1: licence scans by canonical digest lookup, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import NOTICES, TEXTS

#: Equivalent spellings, in the order in which they are replaced (after lower-casing).
SPELLINGS = (("licence", "license"), ("licenc", "licens"), ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("programme", "program"))
#: A line that only states who holds the copyright: it differs from project to project.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*(copyright|[0-9]{4})|©)[^\n]*"
MARKS = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """The text as digests see it: lower case, without copyright lines, marks as one space, one spelling; newlines stay."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, MARKS, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def flat(canon: Column) -> Column:
    """A canonical text with its line breaks folded away."""
    return F.trim(F.regexp_replace(canon, r"[ \n]+", " "))


def digest(flat_text: Column) -> Column:
    return F.sha2(flat_text.cast("binary"), 256)


def known(spark: SparkSession, entries: tuple[tuple[str, str], ...]) -> DataFrame:
    """(license_id, digest) of a catalogue of known texts, put through the same canonical form; equal texts go by the smaller id."""
    rows = spark.createDataFrame(list(entries), "license_id string, text string")
    return rows.select("license_id", digest(flat(canonical(F.col("text")))).alias("k_digest")).groupBy("k_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts=TEXTS, notices=NOTICES) -> DataFrame:
    """(doc_id, digest, license_id, notices): one row per input row.

    digest: of the canonical entire text. license_id: the known licence with that digest, else null. notices: sorted ids
    of the known short notices that stand on lines of their own, joined by commas ('' if there are none); rows with equal
    doc_id share their notices, null ids too.

    A null text has null digest and license, an empty text has the digest of '' and no licence. Extra columns are ignored.
    Both lookups are hash joins against the catalogue, whose size is fixed by the caller and not by the data.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("canon"))
    whole = base.select("doc_id", digest(flat(F.col("canon"))).alias("digest"))
    whole = whole.join(F.broadcast(known(spark, texts)), F.col("digest") == F.col("k_digest"), "left").drop("k_digest")
    lines = base.select("doc_id", F.explode(F.array_distinct(F.split("canon", "\n"))).alias("line"))
    lines = lines.select("doc_id", digest(F.trim("line")).alias("l_digest"))
    marks = known(spark, notices)
    found = lines.join(F.broadcast(marks), F.col("l_digest") == F.col("k_digest"))
    found = found.groupBy(F.col("doc_id").alias("n_id")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    out = whole.join(found, F.col("doc_id").eqNullSafe(F.col("n_id")), "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def canon(x: str) -> str:
        x = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '\\1', 'g')"
        x = f"regexp_replace({x}, '{MARKS}', ' ', 'g')"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    def flat(x: str) -> str:
        return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"

    def rows(entries) -> str:
        return ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in entries)

    return f"""
WITH kt AS (SELECT min(id) AS id, sha256({flat(canon('t'))}) AS dig FROM (VALUES {rows(TEXTS)}) v(id, t) GROUP BY 2),
kn AS (SELECT min(id) AS id, sha256({flat(canon('t'))}) AS dig FROM (VALUES {rows(NOTICES)}) v(id, t) GROUP BY 2),
d AS (SELECT doc_id, {canon('text')} AS c FROM documents),
l AS (SELECT DISTINCT doc_id, sha256(trim(line)) AS dig FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS line FROM d)),
n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT id)), ',') AS notices FROM l JOIN kn USING (dig) GROUP BY doc_id)
SELECT d.doc_id, sha256({flat('c')}) AS digest, kt.id AS license_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN kt ON sha256({flat('c')}) = kt.dig LEFT JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id
"""


SQL = _sql()
