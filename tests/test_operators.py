import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slidelake.functions import pixels as px
from slidelake.functions import sizing
from slidelake.operators import grid, metrics, validate


@pytest.mark.parametrize(("w", "h", "stride", "n"), [(21504, 23040, 1024, 462), (21504, 23040, 2048, 121), (103424, 50176, 1024, 4949), (1024, 1024, 1024, 1), (512, 512, 1024, 0), (2560, 2560, 1024, 4)])
def test_known_grids(spark, w, h, stride, n):
    s = spark.createDataFrame([("a", w, h)], "slide_id string, w long, h long")
    assert grid.candidates(s, 1024, stride).count() == n
    assert s.select(grid.candidate_count(F.col("w"), F.col("h"), 1024, stride).alias("n")).first().n == n


@pytest.mark.parametrize(("rgb", "gray"), [((0, 0, 0), 0), ((255, 255, 255), 255), ((255, 0, 0), 76), ((0, 255, 0), 150), ((0, 0, 255), 29), ((230, 230, 230), 230), ((25, 25, 25), 25)])
def test_luma(spark, rgb, gray):
    df = spark.createDataFrame([rgb], "r int, g int, b int")
    r = df.select(px.luma(F.col("r"), F.col("g"), F.col("b")).alias("g")).select("g", px.is_white(F.col("g")).alias("w"), px.is_black(F.col("g")).alias("k")).first()
    assert r.g == gray and r.w == (gray > 230) and r.k == (gray < 25)


def test_keep_edges(spark):
    rows = [(943718, 1048576, True), (943719, 1048576, False), (368639, 409600, True), (368640, 409600, False), (0, 0, False)]
    df = spark.createDataFrame(rows, "white int, total int, kept boolean")
    assert df.where(px.keeps(F.col("white"), F.lit(0), F.col("total")) != F.col("kept")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.sets(st.integers(0, 8)), st.sets(st.integers(0, 8)))
def test_compare_sets(spark, a, b):
    frame = lambda s: spark.createDataFrame([(x,) for x in s], "x int")
    r = validate.compare_sets(frame(a), frame(b), ["x"]).first()
    assert (r.n_agree, r.n_missing, r.n_extra) == (len(a & b), len(a - b), len(b - a))
    assert r.jaccard == (len(a & b) / len(a | b) if a | b else 1.0)
    assert r.precision == (len(a & b) / len(b) if b else 1.0) and r.recall == (len(a & b) / len(a) if a else 1.0)
    assert r.passed == (a == b)


def test_known_comparison(spark):
    base = spark.createDataFrame([(0, 0), (0, 1024), (1024, 0)], "x int, y int")
    r = validate.compare_sets(base, base.limit(2), ["x", "y"]).first()
    assert r.n_missing == 1 and r.n_extra == 0 and r.jaccard == pytest.approx(2 / 3) and r.f1 == pytest.approx(0.8)
    d = validate.first_differences(base, base.where("x = 0"), ["x", "y"]).collect()
    assert [(x.side, x.x, x.y) for x in d] == [("missing", 1024, 0)]
    assert validate.identical_order(base, base, ["x", "y"], F.col("x"), F.col("y"), ["x", "y"]).first().identical_order is False


def test_array_errors(spark):
    r = validate.array_errors(spark.createDataFrame([(1.0, 1.0), (2.0, 4.0)], "a double, b double"), "a", "b", 1.0).first()
    assert (r.max_error, r.mean_error, r.l2_error, r.match_rate, r.exact) == (2.0, 1.0, 2.0, 0.5, False)


def test_natural_order(spark):
    df = spark.createDataFrame([("v10_b",), ("v2_z",), ("other",), ("v2_a",)], "version string")
    assert [r.version for r in df.orderBy(*metrics.natural_order(df)).collect()] == ["v2_a", "v2_z", "v10_b", "other"]


def test_speedup_without_base_is_null(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "version string, min_t double")
    assert {r.version: r.speedup for r in metrics.speedups(df, "a").collect()} == {"a": 1.0, "b": 2.0}
    assert {r.speedup for r in metrics.speedups(df, "none").collect()} == {None}


def test_batch_sizes(spark):
    df = spark.createDataFrame([(0.0,), (1e9,), (1e13,)], "f double")
    assert [r.b for r in df.select(sizing.auto_batch(F.col("f")).alias("b")).collect()] == [64, 395, 8192]


def test_cover_with_overlap(spark):
    s = spark.createDataFrame([("a", 2048, 1536, 4)], "slide_id string, w long, h long, ntx long")
    got = {(r.x, r.y, r.tile_id) for r in grid.tile_cover(grid.candidates(s, 1024, 512), 1024, 512, 512, "ntx").collect()}
    want = {(x, y, (y // 512 + a) * 4 + x // 512 + b) for y in (0, 512) for x in (0, 512, 1024) for a in (0, 1) for b in (0, 1)}
    assert got == want
    with pytest.raises(ValueError, match="multiple"):
        grid.check_geometry(640, 640, 512, 512)


def test_half_luma_is_near(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(int(v) for v in r) for r in rng.integers(0, 256, (64, 3))], "r int, g int, b int")
    h = px.luma_half()(F.col("r"), F.col("g"), F.col("b"))
    assert df.where(F.abs(h["half"] - px.luma(F.col("r"), F.col("g"), F.col("b"))) > 1.5).count() == 0
