"""Queries over slides in storage, and their SQL over what the slides were made of.

No table holds images, so each supplier is made into a slide: its tiles' coefficients are arithmetic on the supplier's key, so
that every pixel is a whole number that SQL can work out from the key alone. A tile is 32 x 32 pixels of four MCUs (luma
doubled both ways). A luma block has a mean, and two waves whose basis is +-1/8 everywhere; chroma blocks are flat. Some tiles
have no bytes, some are cut off, some bring tables of their own, and some slides are of another compression.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import pixels as px
from ..operators.grid import kept_index
from ..operators.tissue import decisions
from ..session import shared_folder
from ..sources import jpeg
from . import slides
from .catalogue import query, table

TILE, LEVELS, QUANT = 32, 256, 8
_WAVE_X, _WAVE_Y = (int(np.nonzero(jpeg.ZIGZAG == k)[0][0]) for k in (4, 32))
_WRITTEN: dict[tuple[str, str], str] = {}


def size_of(k: int) -> tuple[int, int]:
    return TILE * (4 + k % 3) - k % 5, TILE * (3 + k % 4) - k % 7


def tiles_of(k: np.ndarray, t: np.ndarray) -> list[bytes | None]:
    """Tiles t of slides k; None where one has no bytes."""
    own = (k + t) % 7 == 0  # its own tables: half the step, twice the coefficients
    coefs = np.zeros((len(k), 4, 6, 64), np.int64)
    own_k, own_t = k, t
    k, t = k[:, None, None], t[:, None, None]
    m, b = np.arange(4)[None, :, None], np.arange(4)[None, None]
    coefs[:, :, :4, 0] = (k * 37 + t * 53 + m * 29 + b * 17) % LEVELS - 128
    coefs[:, :, :4, _WAVE_X] = (k + t * 3 + m + b) % 7 - 3
    coefs[:, :, :4, _WAVE_Y] = (k * 2 + t + m * 2 + b) % 5 - 2
    coefs[:, :, 4, 0] = ((k * 11 + t * 7 + m * 5) % LEVELS - 128)[:, :, 0]
    coefs[:, :, 5, 0] = ((k * 5 + t * 13 + m * 3) % LEVELS - 128)[:, :, 0]
    coefs *= np.where(own, 2, 1)[:, None, None, None]
    coefs[:, :, :4, 0] = np.diff(coefs[:, :, :4, 0].reshape(-1, 16), axis=1, prepend=0).reshape(-1, 4, 4)
    coefs[:, :, 4:, 0] = np.diff(coefs[:, :, 4:, 0], axis=1, prepend=0)
    heads = [fixtures.stream_head(TILE, TILE, (2, 2), q) for q in (None, [QUANT // 2] * 64)]
    out = []
    for kk, tt, o, scan in zip(own_k.tolist(), own_t.tolist(), own.tolist(), fixtures.many_scans(coefs), strict=True):
        body = heads[o] + scan + b"\xff\xd9"
        out.append(None if (kk + tt) % 11 == 0 else body[: len(body) // 2] if (kk * 7 + tt) % 97 == 0 else body)
    return out


def slides_made(keys: list[int]) -> Iterator[tuple[int, bytes]]:
    """(key, slide) of each key; tiles of several slides are coded at once."""
    tables = b"\xff\xd8" + fixtures.tables_of([QUANT] * 64) + b"\xff\xd9"
    for i in range(0, len(keys), 64):
        some = keys[i : i + 64]
        n = [-(-w // TILE) * -(-h // TILE) for w, h in map(size_of, some)]
        tiles = tiles_of(np.repeat(np.array(some, np.int64), n), np.concatenate([np.arange(c) for c in n]))
        at = 0
        for k, c in zip(some, n, strict=True):
            yield k, fixtures.tiff_bytes(*size_of(k), TILE, tiles[at : at + c], tables, compression=5 if k % 50 == 0 else 7, order="<" if k % 2 else ">")
            at += c


def written(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the suppliers' slides, written once per session by tasks, under the folder that all executors share."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        folder = f"{shared_folder(spark)}/slides-{uuid.uuid4().hex}"
        fs, inner = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        fs.create_dir(inner)
        local = isinstance(fs, pafs.LocalFileSystem)
        target = inner if local else folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = pafs.LocalFileSystem() if local else pafs.FileSystem.from_uri(target)[0]
            for b in batches:
                for k, body in slides_made(b.column(0).to_pylist()):
                    with store.open_output_stream(f"{inner}/s{k}.tif") as f:  # a task that runs again writes the same file
                        f.write(body)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long")).distinct()
        keys.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "n long").agg(F.sum("n")).collect()
        _WRITTEN[key] = target
    return _WRITTEN[key]


def key_of() -> Column:
    return F.expr("cast(substring(slide_id, 2) as bigint)").alias("k")


# --- the same slides in SQL ---------------------------------------------------------------------------------------

SLIDES = f"""sl AS (SELECT k, w, h, (w + {TILE - 1}) // {TILE} AS ntx, (h + {TILE - 1}) // {TILE} AS nty, k % 50 = 0 AS bad
FROM (SELECT DISTINCT s_suppkey AS k, {TILE} * (4 + s_suppkey % 3) - s_suppkey % 5 AS w, {TILE} * (3 + s_suppkey % 4) - s_suppkey % 7 AS h FROM supplier)),
ti AS (SELECT *, t // ntx AS tr, t % ntx AS tc, (k + t) % 11 = 0 AS bare, (k + t) % 11 <> 0 AND (k * 7 + t) % 97 = 0 AS cut
       FROM (SELECT *, unnest(range(0, ntx * nty)) AS t FROM sl))"""


def floor_sql(x: str) -> str:
    return f"least(255, greatest(0, CAST(floor({x} + 0.5e0) AS BIGINT)))"


PIXELS = f"""WITH {SLIDES},
pp AS (SELECT *, tc * {TILE} + px AS gx, tr * {TILE} + py AS gy, (py // 16) * 2 + px // 16 AS m, ((py % 16) // 8) * 2 + (px % 16) // 8 AS b,
              CASE WHEN px % 8 IN (0, 3, 4, 7) THEN 1 ELSE -1 END AS sx, CASE WHEN py % 8 IN (0, 3, 4, 7) THEN 1 ELSE -1 END AS sy
       FROM (SELECT *, unnest(range(0, {TILE})) AS px FROM (SELECT *, unnest(range(0, {TILE})) AS py FROM ti WHERE NOT bad))),
yc AS (SELECT *, least(255, greatest(0, (k * 37 + t * 53 + m * 29 + b * 17) % 256 + ((k + t * 3 + m + b) % 7 - 3) * sx + ((k * 2 + t + m * 2 + b) % 5 - 2) * sy)) AS lum,
              (k * 11 + t * 7 + m * 5) % 256 - 128 AS cb, (k * 5 + t * 13 + m * 3) % 256 - 128 AS cr FROM pp),
c0 AS (SELECT *, {floor_sql('lum + 1.402e0 * cr')} AS r0, {floor_sql('lum - 0.344136e0 * cb - 0.714136e0 * cr')} AS g0, {floor_sql('lum + 1.772e0 * cb')} AS b0 FROM yc),
p AS (SELECT k, t, tr, tc, w, h, gx, gy, bare, cut, CASE WHEN bare THEN 0 ELSE lum END AS lum, CASE WHEN bare THEN 0 ELSE r0 END AS r, CASE WHEN bare THEN 0 ELSE g0 END AS g,
             CASE WHEN bare THEN 0 ELSE b0 END AS bl, CASE WHEN bare THEN 0 ELSE (r0 * 19595 + g0 * 38470 + b0 * 7471 + 32768) >> 16 END AS gray FROM c0)"""


def patches_sql(patch: int, stride: int) -> str:
    return f"""{PIXELS},
ca AS (SELECT k, x, y FROM (SELECT *, unnest(range(0, w - {patch} + 1, {stride})) AS x FROM (SELECT *, unnest(range(0, h - {patch} + 1, {stride})) AS y FROM sl WHERE NOT bad AND w >= {patch} AND h >= {patch}))),
s AS (SELECT ca.k, x, y, count(*) FILTER (gray > 230 AND NOT cut) AS white, count(*) FILTER (gray < 25 AND NOT cut) AS black, count(*) AS total, bool_or(cut) AS damaged
      FROM ca JOIN p ON ca.k = p.k AND gx >= x AND gx < x + {patch} AND gy >= y AND gy < y + {patch} GROUP BY ca.k, x, y)"""


# --- queries ------------------------------------------------------------------------------------------------------


@query(f"WITH {SLIDES} SELECT k, w AS width, h AS height, CAST({TILE} AS BIGINT) AS tile_w, CAST({TILE} AS BIGINT) AS tile_h, CAST(7 AS BIGINT) AS compression, CAST(ntx AS BIGINT) AS ntx FROM sl WHERE NOT bad")
def slide_headers(spark, sf_dir):
    """Metadata scan: one directory per slide, read in tasks."""
    out = slides.slides_of(spark, written(spark, sf_dir))
    return out.select(key_of(), *[F.col(c).cast("long").alias(c) for c in ("width", "height", "tile_w", "tile_h", "compression", "ntx")])


@query(f"WITH {SLIDES} SELECT k, 's' || k || ': compression 5; only JPEG tiles (7) can be decoded' AS error FROM sl WHERE bad")
def slide_quarantine(spark, sf_dir):
    """Files of the folder that were set aside, and why."""
    return slides.bad_slides(spark, written(spark, sf_dir)).select(key_of(), "error")


@query(f"WITH {SLIDES} SELECT k, CAST(t AS BIGINT) AS tile_id, CAST(tr AS BIGINT) AS tile_row, CAST(tc AS BIGINT) AS tile_col, NOT bare AS has_bytes FROM ti WHERE NOT bad")
def slide_index(spark, sf_dir):
    """The tile index: position and bytes of every tile."""
    out = slides.index_of(spark, written(spark, sf_dir))
    return out.select(key_of(), "tile_id", F.col("tile_row").cast("long").alias("tile_row"), F.col("tile_col").cast("long").alias("tile_col"), (F.col("bytecount") > 0).alias("has_bytes"))


@query(f"""WITH {SLIDES}, ca AS (SELECT k, x, y FROM (SELECT *, unnest(range(0, w - 40 + 1, 70)) AS x FROM (SELECT *, unnest(range(0, h - 40 + 1, 70)) AS y FROM sl WHERE NOT bad)))
SELECT DISTINCT k, CAST(t AS BIGINT) AS tile_id FROM ti SEMI JOIN ca ON ca.k = ti.k AND x < (tc + 1) * {TILE} AND x + 40 > tc * {TILE} AND y < (tr + 1) * {TILE} AND y + 40 > tr * {TILE} WHERE NOT bad""")
def slide_index_pruned(spark, sf_dir):
    """The tiles that a sparse grid of patches needs: by arithmetic on the index, before any tile is read."""
    return slides.index_of(spark, written(spark, sf_dir)).where(slides.covered(40, 70)).select(key_of(), "tile_id")


@query(f"""WITH {SLIDES},
bl AS (SELECT k, t, m, b, o.u AS block, (k * 37 + t * 53 + m * 29 + b * 17) % 256 - 128 AS dc, (k + t * 3 + m + b) % 7 - 3 AS ax, (k * 2 + t + m * 2 + b) % 5 - 2 AS ay, 0 AS comp
       FROM (SELECT *, unnest(range(0, 4)) AS b FROM (SELECT *, unnest(range(0, 4)) AS m FROM ti WHERE NOT bad AND NOT bare AND NOT cut)), LATERAL (SELECT m * 6 + b AS u) o
       UNION ALL SELECT k, t, m, 4, m * 6 + 4, (k * 11 + t * 7 + m * 5) % 256 - 128, 0, 0, 1 FROM (SELECT *, unnest(range(0, 4)) AS m FROM ti WHERE NOT bad AND NOT bare AND NOT cut)
       UNION ALL SELECT k, t, m, 5, m * 6 + 5, (k * 5 + t * 13 + m * 3) % 256 - 128, 0, 0, 2 FROM (SELECT *, unnest(range(0, 4)) AS m FROM ti WHERE NOT bad AND NOT bare AND NOT cut)),
d AS (SELECT *, CASE WHEN (k + t) % 7 = 0 THEN 2 ELSE 1 END AS f, dc - coalesce(lag(dc) OVER (PARTITION BY k, t, comp ORDER BY block), 0) AS diff FROM bl),
v AS (SELECT k, t, block, 0 AS pos, diff * f AS value FROM d UNION ALL SELECT k, t, block, 4, ax * f FROM d UNION ALL SELECT k, t, block, 32, ay * f FROM d)
SELECT k, CAST(t AS BIGINT) AS tile_id, CAST(block AS BIGINT) AS block, CAST(pos AS BIGINT) AS pos, CAST(value AS BIGINT) AS value FROM v WHERE value <> 0""")
def slide_coefficients(spark, sf_dir):
    """What entropy decoding gives: every coefficient of every tile, DC as differences, before prediction and transform."""
    out = slides.tile_coefficients(slides.index_of(spark, written(spark, sf_dir)))
    return out.select(key_of(), "tile_id", "block", F.col("k").alias("pos"), "value")


def _tile_counts_sql(gray: str) -> str:
    count = lambda c: f"CASE WHEN bool_or(cut) THEN NULL ELSE count(*) FILTER ({c}) END"
    return PIXELS + f"SELECT k, CAST(t AS BIGINT) AS tile_id, {count(gray + ' > 230')} AS white, {count(gray + ' < 25')} AS black, {count('true')} AS n, bool_or(cut) AS damaged FROM p WHERE NOT bare GROUP BY k, t"


@query(_tile_counts_sql("gray"))
def slide_tile_counts(spark, sf_dir):
    """White and black pixels of every tile that has bytes: read, entropy decoding, transform, colour, luma, counts."""
    return slides.count_tiles(slides.index_of(spark, written(spark, sf_dir))).select(key_of(), "tile_id", "white", "black", "n", "damaged")


@query(_tile_counts_sql("lum"))
def slide_y_plane_counts(spark, sf_dir):
    """The same with the luma plane in place of the luma of RGB."""
    return slides.count_tiles(slides.index_of(spark, written(spark, sf_dir)), precision="y").select(key_of(), "tile_id", "white", "black", "n", "damaged")


@query(patches_sql(64, 32) + " SELECT k, x, y, white, black, total, damaged FROM s")
def slide_patch_counts(spark, sf_dir):
    """Counts of overlapping patches that are unions of whole tiles; damaged ones are told."""
    return _patches(spark, sf_dir, 64, 32)


def _patches(spark: SparkSession, sf_dir: str, patch: int, stride: int) -> DataFrame:
    return slides.patch_counts(spark, written(spark, sf_dir), patch, stride).select(key_of(), "x", "y", "white", "black", "total", "damaged")


@query(patches_sql(48, 40) + " SELECT k, x, y, white, black, total, damaged FROM s")
def slide_patch_counts_unaligned(spark, sf_dir):
    """The same where patches cut through tiles."""
    return _patches(spark, sf_dir, 48, 40)


@query(patches_sql(64, 32) + " SELECT k, x, y FROM s WHERE NOT damaged AND white / total < 0.3e0 AND black / total < 0.3e0")
def slide_tissue(spark, sf_dir):
    """The tissue filter over the folder: the patches that are neither white nor black, of slides that can be read."""
    return slides.tissue(spark, written(spark, sf_dir), 64, 32, reject=0.3).select(key_of(), "x", "y")


@query(patches_sql(64, 32) + " SELECT k, row_number() OVER (PARTITION BY k ORDER BY y, x) - 1 AS idx, x, y FROM s WHERE NOT damaged AND white / total < 0.3e0 AND black / total < 0.3e0")
def slide_kept_index(spark, sf_dir):
    """Kept patches numbered in each slide, row by row: what an item's number means."""
    return kept_index(slides.tissue(spark, written(spark, sf_dir), 64, 32, reject=0.3)).select(key_of(), "idx", "x", "y")


def _hundredths(count: str) -> str:
    h = f"((200 * {count} + total) // (2 * total))"
    return f"printf('%d.%02d', CAST({h} // 100 AS BIGINT), CAST({h} % 100 AS BIGINT))"


@query(patches_sql(64, 32) + f""" SELECT k, x, y, CASE WHEN damaged THEN 'discarded (reason: error processing patch)'
WHEN white / total >= 0.3e0 THEN 'discarded (reason: white_ratio ' || {_hundredths('white')} || ' >= 0.3)'
WHEN black / total >= 0.3e0 THEN 'discarded (reason: black_ratio ' || {_hundredths('black')} || ' >= 0.3)'
ELSE 'selected (white: ' || {_hundredths('white')} || ', black: ' || {_hundredths('black')} || ')' END AS status FROM s""")
def slide_decisions(spark, sf_dir):
    """Every candidate of every slide with the decision in words, an error for patches with a damaged tile."""
    out = decisions(slides.patch_counts(spark, written(spark, sf_dir), 64, 32), 0.3)
    return out.select(key_of(), "x", "y", F.when(F.col("damaged"), F.lit(px.FAILED)).otherwise(F.col("status")).alias("status"))


@query(patches_sql(48, 40) + """, f AS (SELECT k, x, y FROM s WHERE NOT damaged)
SELECT f.k, f.x, f.y, CAST(sum(r) AS BIGINT) AS red, CAST(sum(g) AS BIGINT) AS green, CAST(sum(bl) AS BIGINT) AS blue,
CAST(sum((r + 3 * g + 7 * bl) * (((gy - y) * 48 + gx - x) % 8191)) AS BIGINT) AS placed
FROM f JOIN p ON f.k = p.k AND gx >= x AND gx < x + 48 AND gy >= y AND gy < y + 48 GROUP BY f.k, f.x, f.y""")
def slide_pixels(spark, sf_dir):
    """Random regions: the pixels of every patch that is not damaged, as sums by channel and a sum that knows places."""
    kept = slides.patch_counts(spark, written(spark, sf_dir), 48, 40).where("not damaged").select("slide_id", "path", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = np.stack([np.frombuffer(v, np.uint8).reshape(-1, 3) for v in b.column(4).to_pylist()]).astype(np.int64)
            sums = body.sum(axis=1)
            placed = ((body @ np.array([1, 3, 7])) * (np.arange(body.shape[1]) % 8191)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *[pa.array(sums[:, c]) for c in range(3)], pa.array(placed)], names=["slide_id", "x", "y", "red", "green", "blue", "placed"])

    out = slides.patch_pixels(slides.neighbours(kept), 48).mapInArrow(run, "slide_id string, x long, y long, red long, green long, blue long, placed long")
    return out.select(key_of(), "x", "y", "red", "green", "blue", "placed")


@query(patches_sql(64, 64) + """, f AS (SELECT k, x, y FROM s WHERE NOT damaged)
SELECT f.k, f.x, f.y, round(avg((r / 255e0 - 0.485e0) / 0.229e0), 4) AS red, round(avg((g / 255e0 - 0.456e0) / 0.224e0), 4) AS green, round(avg((bl / 255e0 - 0.406e0) / 0.225e0), 4) AS blue
FROM f JOIN p ON f.k = p.k AND gx >= x AND gx < x + 64 AND gy >= y AND gy < y + 64 GROUP BY f.k, f.x, f.y""")
def slide_normalised(spark, sf_dir):
    """Channel means of the normalised tensor of every patch: what the facade's transform hands to training."""
    kept = slides.patch_counts(spark, written(spark, sf_dir), 64, 64).where("not damaged").select("slide_id", "path", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..dataset import normalised

        for b in batches:
            means = np.array([normalised(np.frombuffer(v, np.uint8).reshape(64, 64, 3)).astype(np.float64).mean(axis=(1, 2)) for v in b.column(4).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *[pa.array(means[:, c]) for c in range(3)]], names=["slide_id", "x", "y", "red", "green", "blue"])

    out = slides.patch_pixels(slides.neighbours(kept), 64).mapInArrow(run, "slide_id string, x long, y long, red double, green double, blue double")
    return out.select(key_of(), "x", "y", *[F.round(c, 4).alias(c) for c in ("red", "green", "blue")])
