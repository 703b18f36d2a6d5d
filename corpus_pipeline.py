"""A pipeline over documents: quality, line dedup, near-duplicates, benchmark decontamination, mixing.

Each stage takes the rows its predecessor kept and returns the columns of documents, the last one the mix: how many words it
takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.llm import decontaminate, line_dedup, mixing, quality, similar, simhash
from slidelake.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged as an empty line; ids may be null or
    repeated, each row is judged by its own text. An empty table gives none."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; n_chars follows the text. Null texts stay null, a null source is a source
    of its own, repeated rows count as pages of their own; columns named n_lines or n_dropped are kept as they are."""
    out = line_dedup.drop_boilerplate(docs, counts=("__lines", "__dropped"))
    n = F.when(F.col("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[n.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    First groups of fingerprints within two bits go, by the tree; then groups of five-word shingle sets of similarity 0.8 or
    more, which a tree of two bits does not see. Rows with a null id stay only where their group has no other; repeated rows
    are copies; null and empty texts are one group. An empty table gives none.
    """
    return similar.keep_one_similar(simhash.keep_one(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows with a null id are judged together, as are rows of equal ids; null and empty
    texts hold no item. An empty table or benchmark changes nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row. A null text has size 0, a null source comes last,
    equal keys are ordered by id and size; an empty table gives none."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mix sources", mix_stage),
]

#: The classifier is a trained model, which SQL cannot express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; what a stage keeps is cut before the next one reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
