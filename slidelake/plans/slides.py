"""The tissue filter over slides in storage: index, prune, decode and count in one Python hop, roll up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.pixels import BLACK, REJECT, WHITE, keeps
from ..sources import jpeg
from ..sources.tiff import FILE, Files, checked, directory, listed, one_file, register

#: Tiles that are read together, and the compressed bytes up to which more small ones are, of whatever slides.
LOCK_STEP, LOCK_BYTES = 512, 4 << 20
#: Bytes of patches that patch_pixels holds at a time, and the side of the squares of a slide that neighbours keeps together.
PATCH_BYTES, SQUARE = 32 << 20, 8192
LEAST_PART, MOST_PART = 1 << 20, 8 << 20
GEOMETRY = ("slide_id", "path", "width", "height", "tile_w", "tile_h", "tile_id", "tile_row", "tile_col", "offset", "bytecount")


def _read(spark: SparkSession, path: str, mode: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("tiledtiff").option("mode", mode).option("onerror", "raise" if one_file(path) else "skip").options(**options).load(path)


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """A row per tile of every slide that can be decoded, without its bytes; neighbouring tiles lie in one partition.

    A partition stands for MOST_PART bytes of slides, or for fewer where that would leave cores idle.
    """
    total = sum(max(FILE, size) for _, size in listed(path))
    return _read(spark, path, "index", partitionbytes=max(LEAST_PART, min(MOST_PART, total // (3 * spark.sparkContext.defaultParallelism))))


def slides_of(spark: SparkSession, path: str) -> DataFrame:
    """The slides that can be decoded. The fault of a single file is raised; for a folder see bad_slides."""
    out = _read(spark, path, "slides").where("error is null").drop("error")
    return out.withColumn("w", F.col("width").cast("long")).withColumn("h", F.col("height").cast("long")).withColumn("ntx", F.ceil(F.col("width") / F.col("tile_w")))


def bad_slides(spark: SparkSession, path: str) -> DataFrame:
    """(slide_id, path, error) of the files of a folder that were set aside."""
    register(spark)
    return spark.read.format("tiledtiff").option("mode", "slides").option("onerror", "skip").load(path).where("error is not null").select("slide_id", "path", "error")


def covered(patch: int, stride: int) -> Column:
    """Whether any candidate covers a tile of the index: arithmetic on its position, so unused tiles are never read."""

    def axis(at: str, tile: str, size: str) -> Column:
        lo, n = F.col(at) * F.col(tile), F.col(size)
        hi = lo + F.col(tile) - 1
        last = F.floor((n - patch) / stride) * stride  # where the last candidate begins
        nearest = F.least(F.floor(hi / stride) * stride, last)  # the last candidate that begins at or before the tile's end
        return (n >= patch) & (nearest + patch > lo)

    return axis("tile_col", "tile_w", "width") & axis("tile_row", "tile_h", "height")


class Tile(NamedTuple):
    """A row of the index."""

    slide_id: str
    path: str
    width: int
    height: int
    tile_w: int
    tile_h: int
    tile_id: int
    tile_row: int
    tile_col: int
    offset: int
    bytecount: int


def rows_of(batch: pa.RecordBatch) -> list[Tile]:
    return [Tile(*r) for r in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in GEOMETRY), strict=True)]


def decoded(rows: list[Tile]) -> Iterator[tuple[list[int], jpeg.Group]]:
    """(positions among rows, decoded group) of the rows that have bytes, read by slide and in file order.

    Tiles are decoded in lock step across slides that share tables and tile size, so small slides are no slower than a large one.
    """
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        if r.bytecount > 0:
            by.setdefault(r.path, []).append(i)
    held: dict[tuple[bytes, int, int], tuple[list[int], list[bytes]]] = {}
    n = size = 0

    def done() -> Iterator[tuple[list[int], jpeg.Group]]:
        for (tables, w, h), (at, raw) in held.items():
            for g in jpeg.decode(raw, tables, (w, h)):
                yield [at[j] for j in g.at], g
        held.clear()

    for path, at in by.items():
        tables = checked(directory(path)).jpegtables
        f = Files(path)
        try:
            at.sort(key=lambda i: rows[i].offset)
            for i in at:
                r = rows[i]
                own = held.setdefault((tables, r.tile_w, r.tile_h), ([], []))
                own[0].append(i)
                own[1].append(f.read(r.offset, r.bytecount))
                n, size = n + 1, size + r.bytecount
                if n >= LOCK_STEP and size >= LOCK_BYTES:
                    yield from done()
                    n = size = 0
        finally:
            f.close()
    yield from done()


def gray_of(planes: list[np.ndarray], precision: str) -> np.ndarray:
    """luma: integer luma of RGB. y: the luma plane itself. half: luma in half precision, unrounded."""
    if precision == "y":
        return planes[0]
    if precision == "half":
        r, g, b = (c.astype(np.float16) for c in jpeg.channels(planes))
        return r * np.float16(0.299) + g * np.float16(0.587) + b * np.float16(0.114)
    return jpeg.luma(planes)


COUNTS = ["slide_id string", "path string", "tile_id long", "white long", "black long", "n long", "damaged boolean"]


def count_tiles(index: DataFrame, white: int = WHITE, black: int = BLACK, precision: str = "luma") -> DataFrame:
    """(slide_id, path, tile_id, white, black, n, damaged) of the tiles of an index that have bytes.

    One vectorised function reads, decodes, converts and counts: pixels never leave the task, and two numbers per tile do. A
    damaged tile has null counts, whatever its neighbours are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = rows_of(b)
            n = len(rows)
            w, k, total, damaged = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
            for at, g in decoded(rows):
                if not g.planes:
                    continue
                gray = gray_of(g.planes, precision)
                w[at], k[at] = np.count_nonzero(gray > white, axis=(1, 2)), np.count_nonzero(gray < black, axis=(1, 2))
                total[at], damaged[at] = gray.shape[1] * gray.shape[2], g.damaged
            counts = [pa.array(c, pa.int64(), mask=damaged) for c in (w, k, total)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(b.schema.get_field_index("tile_id")), *counts, pa.array(damaged)], names=[c.split()[0] for c in COUNTS])

    return index.where(F.col("bytecount") > 0).select(*GEOMETRY).mapInArrow(run, ", ".join(COUNTS))


def decode_tiles(index: DataFrame) -> DataFrame:
    """The rows of an index that have bytes, with rows, columns, rgb (the pixels as one binary) and damaged."""
    src = index.where(F.col("bytecount") > 0).select(*GEOMETRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, g in decoded(rows_of(b)):
                px = jpeg.rgb(g.planes) if g.planes else None
                body = pa.array([None if g.damaged[j] else px[j].tobytes() for j in range(len(at))], pa.binary())
                size = [pa.array(np.full(len(at), 0 if px is None else px.shape[k], np.int32)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, *size, body, pa.array(g.damaged)], names=[*b.schema.names, "rows", "columns", "rgb", "damaged"])

    schema = StructType([src.schema[c] for c in GEOMETRY]).add("rows", "integer").add("columns", "integer").add("rgb", "binary").add("damaged", "boolean")
    return src.mapInArrow(run, schema)


def tile_coefficients(index: DataFrame) -> DataFrame:
    """(slide_id, tile_id, block, k, value): what entropy decoding gives before anything else, for the tiles that have bytes.

    block counts in scan order, k in natural order; zeros are left out, DC is a difference. Damaged tiles give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for r in rows_of(b) if r.bytecount > 0]
            for path in dict.fromkeys(r.path for r in rows):
                own, f = [r for r in rows if r.path == path], Files(path)
                try:
                    raw = [f.read(r.offset, r.bytecount) for r in own]
                finally:
                    f.close()
                for h, at in jpeg.grouped(raw, checked(directory(path)).jpegtables, (own[0].tile_w, own[0].tile_h)):
                    if h is None:
                        continue
                    coefs, bad = jpeg.coefficients([raw[i] for i in at], h)
                    coefs[bad] = 0
                    i, block, k = np.nonzero(coefs)
                    ids = np.array([own[a].tile_id for a in at])
                    cols = [pa.array([own[0].slide_id] * len(i), pa.string()), pa.array(ids[i]), pa.array(block), pa.array(jpeg.ZIGZAG[k].astype(np.int64)), pa.array(coefs[i, block, k].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["slide_id", "tile_id", "block", "k", "value"])

    return index.where(F.col("bytecount") > 0).select(*GEOMETRY).mapInArrow(run, "slide_id string, tile_id long, block long, k long, value long")


def starts(lo: int, n: int, size: int, patch: int, stride: int) -> range:
    """Where the candidates begin, along one axis of size, that take any of the n pixels from lo on."""
    last = (size - patch) // stride
    first = max(0, -(-(lo - patch + 1) // stride))
    return range(first * stride, (min(last, (lo + n - 1) // stride) + 1) * stride, stride)


PARTS = ["slide_id string", "path string", "x long", "y long", "white long", "black long", "damaged boolean"]


def _parts(rows: list[Tile], grays: Iterator[tuple[list[int], np.ndarray | None, np.ndarray]], patch: int, stride: int, white: int, black: int) -> Iterator[pa.RecordBatch]:
    """What each tile adds to each candidate that covers some of it. Empty tiles are black; a whole tile is counted once."""
    out: list[list] = [[] for _ in PARTS]

    def add(r: Tile, gray: np.ndarray | None, bad: bool) -> None:
        whole = None
        left, top = r.tile_col * r.tile_w, r.tile_row * r.tile_h
        for y in starts(top, r.tile_h, r.height, patch, stride):
            for x in starts(left, r.tile_w, r.width, patch, stride):
                y0, y1, x0, x1 = max(0, y - top), min(r.tile_h, y + patch - top), max(0, x - left), min(r.tile_w, x + patch - left)
                if bad:
                    got = (0, 0)
                elif gray is None:
                    got = (0, (y1 - y0) * (x1 - x0))
                elif (y0, x0, y1, x1) == (0, 0, r.tile_h, r.tile_w):
                    whole = got = whole or (np.count_nonzero(gray > white), np.count_nonzero(gray < black))
                else:
                    cut = gray[y0:y1, x0:x1]
                    got = (np.count_nonzero(cut > white), np.count_nonzero(cut < black))
                for column, v in zip(out, (r.slide_id, r.path, x, y, *got, bad), strict=True):
                    column.append(v)

    def flush() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in PARTS])
        for c in out:
            c.clear()
        return batch

    for r in rows:
        if r.bytecount <= 0:
            add(r, None, False)
    for at, gray, damaged in grays:
        for j, i in enumerate(at):
            add(rows[i], None if damaged[j] else gray[j], bool(damaged[j]))
        if len(out[0]) > 50_000:
            yield flush()
    yield flush()


def patch_counts(spark: SparkSession, path: str, patch: int = 1024, stride: int = 1024, white: int = WHITE, black: int = BLACK, precision: str = "luma", arrange: Callable[[DataFrame], DataFrame] = lambda index: index, fused: bool = True) -> DataFrame:
    """(slide_id, path, x, y, white, black, total, damaged) of every candidate. Tiles without bytes are black.

    The index is pruned to the tiles that a candidate covers, in partitions of neighbouring tiles cut by bytes. One function
    reads, decodes and counts them and says what each tile adds to each candidate; a tile is decoded once and, where a
    candidate takes all of it, counted once, however many candidates share it. What a partition knows of a candidate is
    summed before the only shuffle, of five numbers per candidate. Any mixture of tile shapes and geometries goes through
    the same plan.

    arrange: lays out the pruned index before tiles are read (partitions, order). fused=False decodes to pixels in one
    function and counts in another, for comparison.
    """
    index = arrange(index_of(spark, path).where(covered(patch, stride)).select(*GEOMETRY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = rows_of(b)
            grays = ((at, gray_of(g.planes, precision) if g.planes else None, g.damaged) for at, g in decoded(rows))
            yield from _parts(rows, grays, patch, stride, white, black)

    def of_pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, px = rows_of(b), b.column(b.schema.get_field_index("rgb")).to_pylist()
            grays = (([i], None if p is None else jpeg.luma_of(np.frombuffer(p, np.uint8).reshape(1, rows[i].tile_h, rows[i].tile_w, 3)), np.array([p is None])) for i, p in enumerate(px))
            yield from _parts(rows, grays, patch, stride, white, black)

    def empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _parts(rows_of(b), iter(()), patch, stride, white, black)

    schema = ", ".join(PARTS)
    if fused:
        parts = index.mapInArrow(run, schema)
    else:
        parts = decode_tiles(index).mapInArrow(of_pixels, schema).unionByName(index.where(F.col("bytecount") <= 0).mapInArrow(empty, schema))
    sums = parts.groupBy("slide_id", "path", "x", "y").agg(F.sum("white").alias("white"), F.sum("black").alias("black"), F.bool_or("damaged").alias("damaged"))
    return sums.select("slide_id", "path", "x", "y", "white", "black", F.lit(patch * patch).cast("long").alias("total"), "damaged")


def tissue(spark: SparkSession, path: str, patch: int = 1024, stride: int = 1024, white: int = WHITE, black: int = BLACK, reject: float = REJECT, precision: str = "luma") -> DataFrame:
    """The candidates that hold tissue; patches with a damaged tile are discarded, and the scan goes on."""
    counts = patch_counts(spark, path, patch, stride, white, black, precision)
    return counts.where(~F.col("damaged") & keeps(F.col("white"), F.col("black"), F.col("total"), reject))


def patch_pixels(kept: DataFrame, patch: int) -> DataFrame:
    """kept (with path, x, y) and rgb, the patch's patch x patch x 3 bytes; null if one of its tiles is damaged.

    Rows stay where they are, in their order. Those whose pixels fit PATCH_BYTES are made together, so a tile that several of
    them take is read and decoded once for all of them (see neighbours). Tiles without bytes are black.
    """
    at = [kept.columns.index(c) for c in ("path", "x", "y")]
    together = max(1, PATCH_BYTES // (3 * patch * patch))

    def pixels(rows: list[tuple[str, int, int]]) -> list[bytes | None]:
        tiles: dict[tuple[str, int], int] = {}
        found: list[Tile] = []
        users: list[list[int]] = []  # the rows that take a tile
        for i, (path, x, y) in enumerate(rows):
            d = checked(directory(path))
            for r in range(y // d.tile_h, -(-(y + patch) // d.tile_h)):
                for k in range(r * d.ntx + x // d.tile_w, r * d.ntx - (-(x + patch) // d.tile_w)):
                    t = tiles.setdefault((path, k), len(found))
                    if t == len(found):
                        found.append(Tile(d.slide_id, path, d.width, d.height, d.tile_w, d.tile_h, k, r, k - r * d.ntx, int(d.offsets[k]), int(d.bytecounts[k])))
                        users.append([])
                    users[t].append(i)
        out = np.zeros((len(rows), patch, patch, 3), np.uint8)
        bad = np.zeros(len(rows), bool)
        for some, g in decoded(found):
            px = jpeg.rgb(g.planes) if g.planes else None
            for k, t in enumerate(some):
                if g.damaged[k]:
                    bad[users[t]] = True
                    continue
                tile = found[t]
                for i in users[t]:
                    top, left = tile.tile_row * tile.tile_h - rows[i][2], tile.tile_col * tile.tile_w - rows[i][1]
                    y0, x0, y1, x1 = max(0, top), max(0, left), min(patch, top + tile.tile_h), min(patch, left + tile.tile_w)
                    out[i, y0:y1, x0:x1] = px[k, y0 - top : y1 - top, x0 - left : x1 - left]
        return [None if b else o.tobytes() for o, b in zip(out, bad, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, together):
                some = b.slice(i, together)
                body = pixels(list(zip(*(some.column(k).to_pylist() for k in at), strict=True)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(body, pa.binary())], names=[*some.schema.names, "rgb"])

    return kept.mapInArrow(run, StructType(list(kept.schema.fields)).add("rgb", "binary"))


def neighbours(kept: DataFrame) -> DataFrame:
    """kept (with path, x, y), the patches of a square of a slide in one task, slide by slide and row by row."""
    n = max(4 * kept.sparkSession.sparkContext.defaultParallelism, int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept.repartition(n, "path", F.floor(F.col("x") / SQUARE), F.floor(F.col("y") / SQUARE)).sortWithinPartitions("path", "y", "x")
