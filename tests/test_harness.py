import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake import fixtures
from slidelake.operators import grid, metrics
from slidelake.__main__ import chosen, main
from slidelake.dataset import SlideDataset
from slidelake.plans import harness, slides


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("small_slides")
    px = np.full((512, 1024, 3), 255, np.uint8)
    px[:256, :512] = np.random.default_rng(0).integers(60, 200, (256, 512, 3))
    px[256:, 768:] = 2
    (out / "a.tif").write_bytes(fixtures.slide_bytes(spark, px, tile=256))
    return str(out)


def test_variants_agree(spark, folder, tmp_path):
    m, kept = harness.measure(spark, folder, iterations=1, warm_up=False, patch=512, stride=256)
    assert {r.version for r in m.where("failed is null").collect()} == set(harness.REGISTRY)
    assert m.where("n_candidates <> 3").count() == 0
    same = {r.version: r.passed for r in harness.agreement(kept).collect()}
    assert all(same[v] for v in harness.REGISTRY) and kept["base"].count() > 0
    text = harness.document(m, {"script": "test", "wsi": folder, "patch_size": 512, "stride": 256, "iterations": 1, "warmup": False, "timestamp": "20260101_000000"})
    for name in ("benchmark_1.json", "benchmark_2.json"):
        (tmp_path / name).write_text(text)
    back = harness.read_documents(spark, f"{tmp_path}/benchmark_*.json")
    assert back.count() == 2 * len(harness.REGISTRY)
    last = harness.read_documents(spark, f"{tmp_path}/benchmark_*.json", latest=True)
    assert last.count() == len(harness.REGISTRY) and last.where(~F.col("file").endswith("benchmark_2.json")).count() == 0
    lines = [r.line for r in harness.report(last, "base").orderBy("ord").collect()]
    assert len(lines) == len(harness.REGISTRY) and any("1.00x" in x for x in lines if x.startswith("base"))


def test_failures_are_told(spark, tmp_path):
    with pytest.raises(Exception, match="cannot open"):
        harness.measure(spark, str(tmp_path / "none.tif"), ["base"])
    (tmp_path / "bad.tif").write_bytes(fixtures.tiff_bytes(512, 512, 512, [b"junk"], compression=5))
    m, kept = harness.measure(spark, str(tmp_path / "bad.tif"), ["base"], iterations=1, warm_up=False, patch=512, stride=512)
    assert "compression 5" in m.first().failed or m.first().failed and not kept


def test_registry_and_probe(spark, folder):
    assert {r.version for r in harness.registry(spark, "precision").collect()} == {"half", "luma_plane"}
    assert harness.registry(spark).where("version = 'default'").first().options == {"alias_of": "parallel"}
    assert harness.properties(spark).where("name = 'cores'").first().value == str(spark.sparkContext.defaultParallelism)
    assert {r.direction for r in harness.transfer_bandwidth(spark, 2).where("rate > 0").collect()} == {"to Python", "there and back"}
    rates = harness.probe(spark, folder)
    assert rates.count() == 5 and metrics.threads_scale(rates.where("stage = 'count'")).first().scales in (True, False)


def test_samples(spark):
    s = spark.createDataFrame([("a", 4096, 2048)], "slide_id string, w long, h long")
    assert [(r.x, r.y) for r in grid.centre(s, 1024).collect()] == [(1536, 512)]
    assert [(r.x, r.y) for r in grid.diagonal(s, 1024, 4).orderBy("x").collect()] == [(0, 0), (1024, 1024), (2048, 1024), (3072, 1024)]
    assert grid.sampling_grid(s, 1024, 9).count() == 9
    assert grid.parameter_grid(spark, stride=[1, 2], patch=[3]).count() == 2


def test_command_line(spark, folder, tmp_path, capsys):
    assert main(["list"]) == 0 and "luma_plane" in capsys.readouterr().out
    assert chosen(["precision", "default"]) == ["parallel", "half", "luma_plane"] and chosen(["all"]) == list(harness.REGISTRY)
    with pytest.raises(SystemExit):
        main(["nothing_like_it", "--slides", folder])
    how = ["--slides", folder, "--patch", "512", "--stride", "256", "--iterations", "1", "--no-warm-up"]
    assert main(["base", *how, "--json", str(tmp_path / "b.json"), "--report", "kernel"], spark) == 0
    assert capsys.readouterr().out.startswith("base")
    back = harness.read_documents(spark, str(tmp_path / "b.json")).first()
    assert back.version == "base" and back.peak_gpu_bytes > 0 and len(back.kernel_times) == 1
    rows = harness.read_documents(spark, str(tmp_path / "b.json"))
    assert harness.summary_report(rows).first().line.startswith("base: ") and harness.section_report(rows).count() == 2


def test_training_split(spark, folder):
    d = SlideDataset(spark, folder, 512, 256)
    seen = []
    got = harness.training_split(d.batches(1), lambda items, at: seen.append(at), 1)
    assert got["batches"] == 1 == len(seen) and 0 < got["load_fraction"] <= 1


def test_jvm_decoder(spark, folder):
    ours = {r.tile_id: r for r in slides.decode_tiles(slides.index_of(spark, folder)).collect()}
    theirs = harness.decode_with_jvm(spark, folder).collect()
    assert {r.tile_id for r in theirs} == set(ours)
    for r in theirs:
        a = np.frombuffer(bytes(ours[r.tile_id].rgb), np.uint8).reshape(-1, 3).astype(int)
        b = np.frombuffer(bytes(r.bgr), np.uint8).reshape(-1, 3)[:, ::-1].astype(int)
        assert np.abs(a - b).mean() < 12
