"""Tiled TIFF slides: directory parsing and the Spark data source "tiledtiff"."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLIDES = "slide_id string, path string, width int, height int, tile_w int, tile_h int, compression int, jpegtables binary, error string"
INDEX = "slide_id string, path string, width int, height int, tile_w int, tile_h int, tile_id bigint, tile_row int, tile_col int, ntx bigint, offset bigint, bytecount bigint"
TILES = INDEX + ", raw binary"
JPEG = 7
#: What a file weighs at least when small slides are packed into tasks, in bytes: opening one costs as much as reading so many.
FILE = 1 << 14

#: TIFF tag numbers that are read.
WIDTH, HEIGHT, COMPRESSION, TILE_WIDTH, TILE_HEIGHT, OFFSETS, BYTECOUNTS, JPEGTABLES = 256, 257, 259, 322, 323, 324, 325, 347
#: Bytes and struct codes of the field types that occur (byte, short, long, undefined).
TYPES = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 7: (1, "B")}


class Files:
    """Positional reads by path: local descriptors, or any file system that Arrow opens by URI."""

    def __init__(self, path: str) -> None:
        self.fd, self.file = -1, None
        try:
            if "://" in path and not path.startswith("file:"):
                fs, inner = pafs.FileSystem.from_uri(path)
                self.file = fs.open_input_file(inner)
            else:
                self.fd = os.open(path.removeprefix("file://").removeprefix("file:"), os.O_RDONLY)
        except (OSError, pa.ArrowException) as e:
            raise OSError(f"cannot open slide {path}: {e}") from e

    def read(self, offset: int, size: int) -> bytes:
        return os.pread(self.fd, size, offset) if self.file is None else self.file.read_at(size, offset)

    def close(self) -> None:
        if self.file is None:
            os.close(self.fd)
        else:
            self.file.close()


@dataclass(frozen=True)
class Directory:
    slide_id: str
    path: str
    width: int
    height: int
    tile_w: int
    tile_h: int
    compression: int
    jpegtables: bytes
    offsets: np.ndarray
    bytecounts: np.ndarray

    @property
    def ntx(self) -> int:
        return -(-self.width // self.tile_w)


def read_directory(path: str) -> Directory:
    """The first directory of a classic TIFF in either byte order. BigTIFF, untiled and cut files raise ValueError."""
    f = Files(path)
    try:
        head = f.read(0, 8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or len(head) < 8:
            raise ValueError(f"{path} is not a TIFF file")
        magic, first = struct.unpack(order + "HI", head[2:8])
        if magic != 42:
            raise ValueError(f"{path} is not a classic TIFF file (BigTIFF is not supported)")
        count = f.read(first, 2)
        if len(count) < 2:
            raise ValueError(f"{path} has no directory")
        n = struct.unpack(order + "H", count)[0]
        raw = f.read(first + 2, 12 * n)
        if len(raw) < 12 * n:
            raise ValueError(f"{path} has a cut directory")
        tags: dict[int, np.ndarray] = {}
        for k in range(n):
            tag, kind, how_many = struct.unpack_from(order + "HHI", raw, 12 * k)
            if kind not in TYPES:
                continue
            width, code = TYPES[kind]
            size = width * how_many
            body = raw[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else f.read(struct.unpack_from(order + "I", raw, 12 * k + 8)[0], size)
            if len(body) < size:
                raise ValueError(f"{path} has a cut directory")
            tags[tag] = np.frombuffer(body, order + {"B": "u1", "H": "u2", "I": "u4"}[code], how_many)
        missing = [t for t in (WIDTH, HEIGHT) if t not in tags]
        if missing or any(t not in tags for t in (TILE_WIDTH, TILE_HEIGHT, OFFSETS, BYTECOUNTS)):
            raise ValueError(f"{path} is not tiled")
        if any(len(tags[t]) and tags[t].min() < 1 for t in (WIDTH, HEIGHT, TILE_WIDTH, TILE_HEIGHT)):
            raise ValueError(f"{path} has an empty geometry")
        n_tiles = -(-int(tags[WIDTH][0]) // int(tags[TILE_WIDTH][0])) * -(-int(tags[HEIGHT][0]) // int(tags[TILE_HEIGHT][0]))
        if len(tags[OFFSETS]) < n_tiles or len(tags[BYTECOUNTS]) < n_tiles:
            raise ValueError(f"{path} has a cut tile index")
        one = lambda t, default=0: int(tags[t][0]) if t in tags else default
        tables = tags[JPEGTABLES].tobytes() if JPEGTABLES in tags else b""
        return Directory(stem(path), path, one(WIDTH), one(HEIGHT), one(TILE_WIDTH), one(TILE_HEIGHT), one(COMPRESSION, 1), tables, tags[OFFSETS][:n_tiles].astype(np.int64), tags[BYTECOUNTS][:n_tiles].astype(np.int64))
    finally:
        f.close()


def checked(d: Directory) -> Directory:
    if d.compression != JPEG:
        raise ValueError(f"{d.path}: compression {d.compression}; only JPEG tiles ({JPEG}) can be decoded")
    return d


@lru_cache(maxsize=64)
def directory(path: str) -> Directory:
    """As read_directory, remembered inside a task's process."""
    return read_directory(path)


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's .tif and .tiff files, or of several of either joined by commas. No file is opened."""
    out: list[tuple[str, int]] = []
    for p in filter(None, (x.strip() for x in path.split(","))):
        if "://" in p and not p.startswith("file:"):
            fs, inner = pafs.FileSystem.from_uri(p)
            info = fs.get_file_info(inner)
            if info.type == pafs.FileType.Directory:
                scheme = p.split("://", 1)[0] + "://"
                out += sorted((scheme + i.path, i.size or 0) for i in fs.get_file_info(pafs.FileSelector(inner)) if i.path.endswith((".tif", ".tiff")))
            else:
                out.append((p, info.size or 0))
            continue
        local = p.removeprefix("file://").removeprefix("file:")
        if os.path.isdir(local):
            with os.scandir(local) as entries:
                out += sorted((e.path, e.stat().st_size) for e in entries if e.name.endswith((".tif", ".tiff")))
        else:
            out.append((p, os.stat(local).st_size if os.path.exists(local) else 0))
    return out


def one_file(path: str) -> bool:
    """Whether the path names a single file, whose faults are raised; a folder's bad files are set aside."""
    got = listed(path)
    return len(got) == 1 and got[0][0] == path.strip()


@dataclass
class Part(InputPartition):
    """Slides by their headers, whole slides by their tiles, or part k of n of one slide's tiles, cut by their bytes."""

    paths: tuple[str, ...]
    k: int = 0
    n: int = 1


class TiffReader(DataSourceReader):
    """Planned from file sizes alone: directories are read in tasks.

    partitionbytes: bytes of slides per task; small slides share one, large ones are cut. onerror: "raise", or "skip" slides that cannot be read or decoded (in mode
    slides they are rows with an error).
    """

    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}  # Spark's own map ignores case and gives lower case back
        self.path = options.get("path", "")
        self.mode = options.get("mode", "tiles")
        self.bytes = max(1, int(options.get("partitionbytes", 8 << 20)))
        self.headers = max(1, int(options.get("headers", 32)))
        self.skip_empty = options.get("skipempty", "false").lower() == "true"
        self.skip = options.get("onerror", "raise").lower() == "skip"
        if self.mode not in ("slides", "index", "tiles"):
            raise ValueError("mode is slides, index or tiles")

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path)
        if self.mode == "slides":
            return [Part(tuple(p for p, _ in files[k : k + self.headers])) for k in range(0, len(files), self.headers)]
        out: list[InputPartition] = []
        some: list[str] = []
        held = 0
        for p, size in files:
            if some and held + max(FILE, size) > self.bytes:
                out.append(Part(tuple(some)))
                some, held = [], 0
            if size > self.bytes:
                n = -(-size // self.bytes)
                out += [Part((p,), k, n) for k in range(n)]
            else:
                some.append(p)
                held += max(FILE, size)
        return [*out, Part(tuple(some))] if some else out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if self.mode == "slides":
            yield self._headers(part.paths)
            return
        for path in part.paths:
            try:
                d = read_directory(path)
                if self.skip:
                    checked(d)
            except (ValueError, OSError):
                if self.skip:
                    continue
                raise
            yield from self._tiles(d, part)

    def _headers(self, paths: tuple[str, ...]) -> pa.RecordBatch:
        rows = []
        for path in paths:
            try:
                d = read_directory(path)
                if self.skip:
                    checked(d)
                rows.append((d.slide_id, d.path, d.width, d.height, d.tile_w, d.tile_h, d.compression, d.jpegtables, None))
            except (ValueError, OSError) as e:
                if not self.skip:
                    raise
                rows.append((stem(path), path, None, None, None, None, None, None, str(e).replace(path, stem(path))))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in SLIDES.split(", ")])

    def _tiles(self, d: Directory, part: Part) -> Iterator[pa.RecordBatch]:
        run = np.cumsum(d.bytecounts)  # tiles go to the part in which their last byte lies
        own = np.nonzero(np.maximum(0, run * part.n - 1) // max(1, int(run[-1]) if len(run) else 1) == part.k)[0]
        if self.skip_empty:
            own = own[d.bytecounts[own] > 0]
        f = Files(d.path) if self.mode == "tiles" else None
        step = 64 if f else 65_536
        try:
            for a in range(0, len(own), step):
                ids = own[a : a + step]
                same = lambda v, t: pa.array(np.full(len(ids), v), t)  # noqa: B023, E731
                cols = [pa.array([d.slide_id] * len(ids), pa.string()), pa.array([d.path] * len(ids), pa.string()), *[same(v, pa.int32()) for v in (d.width, d.height, d.tile_w, d.tile_h)], pa.array(ids), pa.array((ids // d.ntx).astype(np.int32)), pa.array((ids % d.ntx).astype(np.int32)), same(d.ntx, pa.int64()), pa.array(d.offsets[ids]), pa.array(d.bytecounts[ids])]
                names = [c.split()[0] for c in INDEX.split(", ")]
                if f:
                    cols.append(pa.array([f.read(int(d.offsets[i]), int(d.bytecounts[i])) if d.bytecounts[i] else None for i in ids], pa.binary()))
                    names.append("raw")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        finally:
            if f:
                f.close()


class TiledTiff(DataSource):
    """spark.read.format("tiledtiff").option("mode", "slides" | "index" | "tiles").load(path); more options: see TiffReader."""

    @classmethod
    def name(cls) -> str:
        return "tiledtiff"

    def schema(self) -> str:
        return {"slides": SLIDES, "index": INDEX}.get(self.options.get("mode", "tiles"), TILES)

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiledTiff)
