import pytest
from compare import rows_of, rows_of_sql
from pyspark.sql import functions as F

from slidelake.plans import catalogue, slide_queries  # noqa: F401  the latter registers its queries


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf)) == rows_of_sql(sf, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() >= 1


def test_every_patch_has_a_decision(spark, sf):
    patches = catalogue.grid.candidates(catalogue.part_slides(spark, sf), 1024, 512)
    assert catalogue.QUERIES["decision_log"](spark, sf).count() == patches.count() > 0


def test_shares_print_half_up(spark):
    """As integers round them, ties included."""
    from slidelake.functions import pixels as px

    rows = spark.range(1, 402).withColumnRenamed("id", "total").selectExpr("total", "explode(sequence(0L, total)) white")
    h = F.expr("(200 * white + total) div (2 * total)")
    want = F.concat(F.lit("selected (white: "), F.format_string("%d.%02d", F.floor(h / 100), h % 100), F.lit(", black: 0.00)"))
    got = px.status(F.col("white"), F.lit(0), F.col("total"), 2.0)
    assert rows.where(got != want).count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_text_operators(tmp_path):
    """The entry point imports and keeps its own queries if the optional part is gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "slidelake"), tmp_path / "slidelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):  # the pipeline may stay behind without its operators
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tissue_filter' in q and not [x for x in q if x.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
