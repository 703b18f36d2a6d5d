import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidelake import fixtures
from slidelake.dataset import SlideDataset, normalised
from slidelake.plans import slides
from slidelake.sources import jpeg, tiff
from slidelake.streaming.slides import filter_arrivals


@pytest.fixture(scope="module")
def texture():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:512, 0:512]
    base = np.stack([128 + 80 * np.sin(x / 17) + 20 * np.sin(y / 5), 120 + 60 * np.cos(y / 23), 140 + 50 * np.sin((x + y) / 31)], -1)
    return np.clip(base + rng.normal(0, 8, base.shape), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(spark, texture, tmp_path_factory):
    """mixed: tissue, white, white but for a quarter, white, black, and a patch with an empty and a cut tile."""
    out = tmp_path_factory.mktemp("slides")
    big = np.full((2048, 3072, 3), 255, np.uint8)
    big[:1024, :1024] = np.tile(texture, (2, 2, 1))
    big[1024:, 1024:2048] = 3
    big[:512, 2048:2560] = texture
    big[1024:, 2048:] = np.tile(texture, (2, 2, 1))
    (out / "mixed.tif").write_bytes(fixtures.slide_bytes(spark, big, empty={23}, cut={22}))
    (out / "edge.tif").write_bytes(fixtures.slide_bytes(spark, np.tile(texture, (3, 3, 1))[:1300, :1300], order=">"))
    (out / "small.tif").write_bytes(fixtures.slide_bytes(spark, texture))
    return out


def truth(planes_of, patch, white=230, black=25):
    gray = jpeg.luma_of(planes_of)
    return {(x, y): (int((gray[y : y + patch, x : x + patch] > white).sum()), int((gray[y : y + patch, x : x + patch] < black).sum())) for y in range(0, gray.shape[0] - patch + 1, patch) for x in range(0, gray.shape[1] - patch + 1, patch)}


def pixels(tiles, tables=b"", size=None):
    """The pixels of each tile; None for damaged ones."""
    out = [None] * len(tiles)
    for g in jpeg.decode(tiles, tables, size):
        for j, i in enumerate(g.at):
            out[i] = None if g.damaged[j] else jpeg.rgb(g.planes)[j]
    return out


def test_decoder_agrees_with_the_jvm(spark, texture):
    stream = fixtures.encode(spark, texture)
    tables, tile = fixtures.parted(stream)
    got = pixels([tile, tile], tables)
    assert (got[0] == got[1]).all() and (pixels([stream])[0] == got[0]).all()
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(tile[:2] + tables[2:-2] + tile[2:]))
    raw = bytes(jvm.java.nio.ByteBuffer.wrap(image.getRaster().getDataBuffer().getData()).array())
    other = np.frombuffer(raw, np.uint8).reshape(512, 512, 3)[:, :, ::-1]
    error = np.abs(got[0].astype(int) - other.astype(int))
    assert error.mean() < 1.5 and error.max() <= 16  # chroma is upsampled differently
    assert np.abs(got[0].astype(int) - texture.astype(int)).mean() < 10


def test_damaged_tiles_are_told(spark, texture):
    tables, tile = fixtures.parted(fixtures.encode(spark, texture))
    assert [p is None for p in pixels([tile, tile[: len(tile) // 2], b"junk"], tables)] == [False, True, True]


def test_a_tile_does_not_depend_on_its_neighbours(spark, texture):
    """Tiles of another geometry, of tables of their own, and broken ones, in every order and batch."""
    tables, tile = fixtures.parted(fixtures.encode(spark, texture))
    coefs = np.zeros((1, 3, 64), np.int64)
    coefs[0, :, 0] = 40, 3, -2
    small = fixtures.stream(coefs, 8, 8, (1, 1), [16] * 64)  # other geometry, own tables
    flat = np.zeros((1024, 6, 64), np.int64)
    flat[:, 0, 0] = 1
    own = fixtures.stream(flat, 512, 512, (2, 2), [4] * 64)  # own tables, same geometry
    alone = {name: pixels([t], tables, (512, 512))[0] for name, t in (("t", tile), ("s", small), ("o", own), ("j", b"junk"))}
    assert alone["s"] is None and alone["j"] is None and alone["o"] is not None
    kinds = {"t": tile, "s": small, "o": own, "j": b"junk"}
    for order in ("sttt", "ttts", "otto", "tojs", "jsot"):
        got = pixels([kinds[k] for k in order], tables, (512, 512))
        for k, p in zip(order, got, strict=True):
            assert (p is None) == (alone[k] is None) and (p is None or (p == alone[k]).all())


def test_grey_and_alpha():
    coefs = np.zeros((1, 1, 64), np.int64)
    coefs[0, 0, 0] = 50
    assert (pixels([fixtures.stream(coefs, 8, 8, (1, 1), [8] * 64, n_parts=1)])[0] == 178).all()
    four = np.zeros((1, 4, 64), np.int64)
    four[0, :, 0] = 50, 0, 0, 99
    assert (pixels([fixtures.stream(four, 8, 8, (1, 1), [8] * 64, n_parts=4)])[0] == 178).all()


def test_bad_slides_are_set_aside(spark, folder, tmp_path):
    import shutil

    shutil.copy(folder / "edge.tif", tmp_path)
    (tmp_path / "lzw.tif").write_bytes(fixtures.tiff_bytes(512, 512, 512, [b"x"], compression=5))
    (tmp_path / "cut.tif").write_bytes((folder / "edge.tif").read_bytes()[:1000])
    (tmp_path / "no.tif").write_bytes(b"GIF89a..")
    assert {r.slide_id for r in slides.bad_slides(spark, str(tmp_path)).collect()} == {"lzw", "cut", "no"}
    assert {r.slide_id for r in slides.tissue(spark, str(tmp_path)).collect()} == {"edge"}
    with pytest.raises(Exception, match="compression 5"):
        slides.tissue(spark, str(tmp_path / "lzw.tif"), 512, 512).collect()


def test_a_slide_is_spread_over_tasks(spark, folder):
    register = tiff.TiffReader({"path": str(folder / "mixed.tif"), "mode": "index", "partitionbytes": "100000"})
    parts = register.partitions()
    ids = [i for p in parts for b in register.read(p) for i in b.column(6).to_pylist()]
    assert len(parts) > 3 and sorted(ids) == list(range(24))


def test_bad_files(spark, tmp_path):
    for name, how in (("big", {"magic": 43}), ("untiled", {"tiled": False})):
        (tmp_path / f"{name}.tif").write_bytes(fixtures.tiff_bytes(512, 512, 512, [b"x"], **how))
        with pytest.raises(ValueError, match="BigTIFF|not tiled"):
            tiff.read_directory(str(tmp_path / f"{name}.tif"))
    (tmp_path / "lzw.tif").write_bytes(fixtures.tiff_bytes(512, 512, 512, [b"x"], compression=5))
    with pytest.raises(ValueError, match="compression 5"):
        tiff.checked(tiff.read_directory(str(tmp_path / "lzw.tif")))
    (tmp_path / "no.tif").write_bytes(b"GIF89a..")
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.read_directory(str(tmp_path / "no.tif"))
    with pytest.raises(OSError, match="cannot open"):
        tiff.read_directory(str(tmp_path / "absent.tif"))


def test_source_modes(spark, folder):
    tiff.register(spark)
    read = lambda mode, **o: spark.read.format("tiledtiff").option("mode", mode).options(**o).load(str(folder))
    assert {(r.slide_id, r.width, r.height) for r in read("slides").collect()} == {("mixed", 3072, 2048), ("edge", 1300, 1300), ("small", 512, 512)}
    assert read("index").count() == 24 + 9 + 1
    t = read("tiles", skipEmpty="true", partitionBytes="100000")
    assert t.count() == 33 and t.rdd.getNumPartitions() > 3
    assert t.where("bytecount <> length(raw)").count() == 0


def test_counts_match_pixels(spark, folder):
    full = slides.patch_counts(spark, str(folder / "edge.tif"), 1024, 1024).collect()
    px = slides.patch_pixels(spark.createDataFrame(full), 1024).collect()
    assert len(full) == 1
    for r in px:
        gray = jpeg.luma_of(np.frombuffer(bytes(r.rgb), np.uint8).reshape(1024, 1024, 3))
        assert (r.white, r.black, r.total) == (int((gray > 230).sum()), int((gray < 25).sum()), 1024 * 1024)


@pytest.mark.parametrize(("patch", "stride"), [(640, 640), (512, 300), (1024, 512)])
def test_other_geometries(spark, folder, patch, stride):
    got = slides.patch_counts(spark, str(folder / "edge.tif"), patch, stride)
    rows = got.collect()
    assert len(rows) == ((1300 - patch) // stride + 1) ** 2
    for r in slides.patch_pixels(got, patch).collect():
        gray = jpeg.luma_of(np.frombuffer(bytes(r.rgb), np.uint8).reshape(patch, patch, 3))
        assert (r.white, r.black, r.total) == (int((gray > 230).sum()), int((gray < 25).sum()), patch * patch)


def test_tissue_and_empty_and_damaged(spark, folder):
    rows = {(r.x, r.y): r for r in slides.patch_counts(spark, str(folder / "mixed.tif")).collect()}
    assert rows[2048, 1024].damaged and rows[1024, 1024].black == 1 << 20 and rows[1024, 0].white == 1 << 20
    assert {(r.x, r.y) for r in slides.tissue(spark, str(folder / "mixed.tif")).collect()} == {(0, 0), (2048, 0)}
    assert {(r.x, r.y) for r in slides.tissue(spark, str(folder / "mixed.tif"), precision="half").collect()} == {(0, 0), (2048, 0)}


def test_unused_tiles_are_pruned(spark, folder):
    used = slides.index_of(spark, str(folder / "edge.tif")).where(slides.covered(512, 1024)).select("tile_id").collect()
    assert {r.tile_id for r in used} == {0}
    assert slides.index_of(spark, str(folder / "small.tif")).where(slides.covered(1024, 1024)).count() == 0


def test_dataset(spark, folder):
    d = SlideDataset(spark, str(folder / "mixed.tif"))
    item, at = d[0]
    assert len(d) == 2 and item.shape == (3, 1024, 1024) and item.dtype == np.float32 and at == (0, 0) and d[-1][1] == (2048, 0)
    with pytest.raises(IndexError):
        d[2]
    said = {(r.x, r.y): r.status for r in d.decisions().collect()}
    assert said[2048, 0].startswith("selected (white: 0.7") and "white_ratio 1.00" in said[1024, 0] and "error" in said[2048, 1024]
    assert [b for _, b in d.batches(1)] == [[(0, 0)], [(2048, 0)]]
    assert [len(a) for a, _ in d.batches(2, shuffle=True)] == [2] and list(d.batches(3, drop_last=True)) == []
    assert SlideDataset(spark, str(folder / "mixed.tif"), transform=normalised)[0][0].min() < 0
    with pytest.raises(ValueError, match="no patch"):
        SlideDataset(spark, str(folder / "small.tif"))
    with pytest.raises(Exception, match="cannot open"):
        SlideDataset(spark, str(folder / "absent.tif"))


def test_arrivals(spark, folder, tmp_path):
    q = filter_arrivals(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), per_trigger=1, patch=512, stride=512)
    q.awaitTermination(120)
    got = {r.slide_id for r in spark.read.parquet(str(tmp_path / "out")).select("slide_id").distinct().collect()}
    assert got == {"mixed", "edge", "small"} and len(os.listdir(tmp_path / "out")) == 3


def test_small_slides_share_tasks_and_steps(spark, folder, tmp_path, monkeypatch):
    """Many small slides are few tasks, a bad one among them is skipped, and tiles of several slides go in lock step."""
    from slidelake.plans import slide_queries as sq

    for k, body in sq.slides_made(list(range(1, 61))):
        (tmp_path / f"s{k}.tif").write_bytes(body)
    register = tiff.TiffReader({"path": str(tmp_path), "mode": "index", "onerror": "skip"})
    parts = register.partitions()
    rows = [r for p in parts for b in register.read(p) for r in slides.rows_of(b)]
    assert len(parts) == 1 and len({r.path for r in rows}) == 59  # slide 50 is of another compression
    calls = []
    plain = jpeg.coefficients
    monkeypatch.setattr(jpeg, "coefficients", lambda tiles, h: calls.append(len(tiles)) or plain(tiles, h))
    got = {i: (None if g.damaged[j] else [c[j].tobytes() for c in g.planes]) for at, g in slides.decoded(rows) for j, i in enumerate(at)}
    assert len(calls) < 20 and len(got) == sum(r.bytecount > 0 for r in rows)
    for i in range(0, len(rows), 97):
        if rows[i].bytecount:
            ((_, alone),) = slides.decoded([rows[i]])
            assert got[i] == (None if alone.damaged[0] else [c[0].tobytes() for c in alone.planes])


def test_scans_coded_at_once():
    """Tiles coded together are byte for byte those coded alone, runs of zeros and stuffing included."""
    rng = np.random.default_rng(7)
    coefs = rng.integers(-1000, 1000, (40, 2, 3, 64)) * (rng.random((40, 2, 3, 64)) < rng.random((40, 1, 1, 1)) ** 4)
    coefs[0] = 0
    coefs[1, ..., 1:] = 0
    coefs[1, ..., 63] = 5
    assert fixtures.many_scans(coefs) == [fixtures.scan_bytes(c) for c in coefs]


def test_patches_share_tiles(spark, folder, monkeypatch):
    """Rows keep their order; a tile that several patches of a batch take is decoded once; neighbours lose no row."""
    from slidelake.operators.grid import candidates

    cand = candidates(slides.slides_of(spark, str(folder)).select("slide_id", "path", "w", "h"), 300, 250).drop("w", "h")
    near = slides.neighbours(cand)
    key = lambda r: (r.path, r.x, r.y)
    assert sorted(map(key, near.collect())) == sorted(map(key, cand.collect()))
    assert len({tuple(sorted(p)) for p in near.select("path", F.spark_partition_id().alias("p")).distinct().groupBy("path").agg(F.collect_list("p").alias("p")).select("p").toArrow()["p"].to_pylist()}) <= 3
    one = {key(r): r.rgb for r in slides.patch_pixels(near.orderBy("path", "y", "x"), 300).collect()}
    many = slides.patch_pixels(cand.orderBy(F.desc("path"), "x", "y").coalesce(1), 300).collect()
    assert [key(r) for r in many] == [key(r) for r in cand.orderBy(F.desc("path"), "x", "y").collect()]
    assert {key(r): r.rgb for r in many} == one and None in one.values()
    wants = []
    batch = []

    class Frame:  # takes the function that tasks run
        columns, schema = cand.columns, cand.schema

        def mapInArrow(self, run, schema):
            batch.append(run)

    slides.patch_pixels(Frame(), 300)
    plain = jpeg.decode
    monkeypatch.setattr(jpeg, "decode", lambda tiles, *a: wants.append(len(tiles)) or plain(tiles, *a))
    mixed = cand.where("slide_id = 'small'").toArrow()
    (out,) = batch[0](iter(mixed.to_batches()))
    assert out.num_rows == 1 == sum(wants)
    wants.clear()
    edge = cand.where("slide_id = 'edge'").toArrow().combine_chunks()
    (out,) = batch[0](iter(edge.to_batches()))
    assert out.num_rows == 25 and sum(wants) == 9
