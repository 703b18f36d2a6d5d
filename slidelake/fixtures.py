"""Writer of small tiled TIFF slides for tests and trials.

Tiles come from pixels, by the JVM's own JPEG writer, or from given coefficients, by the entropy coder here.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import SparkSession

from .sources.tiff import BYTECOUNTS, COMPRESSION, HEIGHT, JPEG, JPEGTABLES, OFFSETS, TILE_HEIGHT, TILE_WIDTH, WIDTH


def encode(spark: SparkSession, pixels: np.ndarray) -> bytes:
    """A JPEG stream of (rows, columns, 3) uint8."""
    jvm = spark.sparkContext._jvm
    rows, columns = pixels.shape[:2]
    pitch = -(-columns * 3 // 4) * 4
    body = np.zeros((rows, pitch), np.uint8)
    body[:, : columns * 3] = pixels[::-1, :, ::-1].reshape(rows, -1)
    bmp = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, columns, rows, 1, 24, 0, body.size, 0, 0, 0, 0) + body.tobytes()
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bmp))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def parted(stream: bytes) -> tuple[bytes, bytes]:
    """The stream of the tables of a JPEG stream, and the abbreviated rest."""
    tables, rest, at = b"", b"", 2
    while True:
        size = struct.unpack_from(">H", stream, at + 2)[0] + 2
        if stream[at + 1] in (0xDB, 0xC4):
            tables += stream[at : at + size]
        elif stream[at + 1] == 0xDA:
            return b"\xff\xd8" + tables + b"\xff\xd9", b"\xff\xd8" + rest + stream[at:]
        else:
            rest += stream[at : at + size]
        at += size


def own_codes() -> dict[bool, tuple[bytes, bytes]]:
    """Huffman tables of the coder here, by whether they are for AC: code counts by length, and symbols.

    Any prefix code does: DC sizes have 4 bits, the end of a block 2, and every other pair of run and size 9.
    """
    dc = bytes([0, 0, 0, 12, *[0] * 12]), bytes(range(12))
    pairs = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0xF0]
    return {False: dc, True: (bytes([0, 1, *[0] * 6, len(pairs), *[0] * 7]), bytes([0, *pairs]))}


def code_of(lengths: bytes, symbols: bytes) -> dict[int, str]:
    """The code of each symbol as a string of bits."""
    out, code, k = {}, 0, 0
    for n, how_many in enumerate(lengths, start=1):
        for _ in range(how_many):
            out[symbols[k]] = format(code, f"0{n}b")
            code += 1
            k += 1
        code <<= 1
    return out


def segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def tables_of(quant: list[int]) -> bytes:
    """The segments of one quantisation table, in stored order, and of both Huffman tables."""
    codes = b"".join(segment(0xC4, bytes([int(ac) << 4]) + a + b) for ac, (a, b) in own_codes().items())
    return segment(0xDB, bytes([0, *quant])) + codes


def scan_bytes(coefs: np.ndarray) -> bytes:
    """The entropy-coded scan of (mcu, block, 64) coefficients in stored order, DC as differences."""
    dc, ac = (code_of(*own_codes()[k]) for k in (False, True))
    bits: list[str] = []

    def value(v: int, size: int) -> str:
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    for block in coefs.reshape(-1, 64).tolist():
        size = abs(block[0]).bit_length()
        bits.append(dc[size] + value(block[0], size))
        last = 0
        for k in [k for k in range(1, 64) if block[k]]:
            run = k - last - 1
            bits.append(ac[0xF0] * (run // 16))
            size = abs(block[k]).bit_length()
            bits.append(ac[run % 16 << 4 | size] + value(block[k], size))
            last = k
        if last < 63:
            bits.append(ac[0])
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    return int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00")


def many_scans(coefs: np.ndarray) -> list[bytes]:
    """As scan_bytes, for each of (tile, mcu, block, 64) coefficients, all tiles at once."""
    n = len(coefs)
    flat = coefs.reshape(-1, 64).astype(np.int64)
    per = len(flat) // max(1, n)
    size_of = lambda v: np.where(v == 0, 0, np.frexp(np.abs(v).astype(np.float64))[1])
    table = {}
    for ac, codes in ((k, code_of(*own_codes()[k])) for k in (False, True)):
        table[ac] = np.zeros((2, 256), np.int64)
        for symbol, bits in codes.items():
            table[ac][:, symbol] = int(bits, 2), len(bits)

    def emitted(block, place, ac: bool, symbol, v, size):
        """(block, place in it, bits, how many) of a symbol and the value behind it."""
        code, length = table[ac][:, symbol]
        return block, place, code << size | np.where(v > 0, v, v + (1 << size) - 1) & (1 << size) - 1, length + size

    blocks = np.arange(len(flat))
    dc = size_of(flat[:, 0])
    out = [emitted(blocks, 0 * blocks, False, dc, flat[:, 0], dc)]
    block, k = np.nonzero(flat[:, 1:])
    k += 1
    v = flat[block, k]
    before = np.zeros_like(k)
    before[1:] = np.where(block[1:] == block[:-1], k[:-1], 0)
    run = k - before - 1
    for skip in range(3):  # runs of 16 zeros
        some = np.nonzero(run >= 16 * (skip + 1))[0]
        none = 0 * some
        out.append(emitted(block[some], before[some] * 4 + 1 + skip, True, none + 0xF0, none, none))
    size = size_of(v)
    out.append(emitted(block, k * 4, True, run % 16 << 4 | size, v, size))
    last = np.zeros(len(flat), np.int64)
    last[block] = k  # the last of a block wins
    short = np.nonzero(last < 63)[0]
    none = 0 * short
    out.append(emitted(short, none + 256, True, none, none, none))
    block, place, bits, length = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(block * 512 + place, kind="stable")
    block, bits, length = block[order], bits[order], length[order]
    each = np.bincount(block // max(1, per), weights=length, minlength=n).astype(np.int64)
    padded = -(-each // 8) * 8
    start = np.cumsum(padded) - padded
    at = np.cumsum(length) - length + np.repeat(start - (np.cumsum(each) - each), np.bincount(block // max(1, per), minlength=n))
    stream = np.ones(int(padded.sum()), np.uint8)  # scans end in ones
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    stream[np.repeat(at, length) + within] = np.repeat(bits, length) >> (np.repeat(length, length) - 1 - within) & 1
    body = np.packbits(stream).tobytes()
    return [body[a // 8 : (a + b) // 8].replace(b"\xff", b"\xff\x00") for a, b in zip(start.tolist(), padded.tolist(), strict=True)]


def stream(coefs: np.ndarray, width: int, height: int, sampling: tuple[int, int], quant: list[int] | None = None, n_parts: int = 3) -> bytes:
    """A baseline stream of coefficients; without quant an abbreviated one, which needs tables_of. sampling: luma's (h, v)."""
    return stream_head(width, height, sampling, quant, n_parts) + scan_bytes(coefs) + b"\xff\xd9"


def stream_head(width: int, height: int, sampling: tuple[int, int], quant: list[int] | None = None, n_parts: int = 3) -> bytes:
    """What comes before the scan of a stream."""
    head = b"\xff\xd8" + (tables_of(quant) if quant else b"")
    parts = b"".join(bytes([i + 1, (sampling[0] << 4 | sampling[1]) if i == 0 else 0x11, 0]) for i in range(n_parts))
    frame = segment(0xC0, struct.pack(">BHHB", 8, height, width, n_parts) + parts)
    scan = segment(0xDA, bytes([n_parts]) + b"".join(bytes([i + 1, 0]) for i in range(n_parts)) + b"\0\x3f\0")
    return head + frame + scan


def tiff_bytes(width: int, height: int, tile: int, tiles: list[bytes | None], tables: bytes = b"", compression: int = JPEG, order: str = "<", magic: int = 42, tiled: bool = True) -> bytes:
    """A classic TIFF with one directory; a tile of None has no bytes."""
    body = bytearray(b"II" if order == "<" else b"MM") + struct.pack(order + "HI", magic, 0)
    offsets = []
    for t in tiles:
        offsets.append(len(body) if t else 0)
        body += t or b""
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (COMPRESSION, 3, [compression])]
    if tiled:
        fields += [(TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (OFFSETS, 4, offsets), (BYTECOUNTS, 4, [len(t or b"") for t in tiles])]
    if tables:
        fields.append((JPEGTABLES, 7, list(tables)))
    entries = b""
    for tag, kind, values in sorted(fields):
        packed = struct.pack(order + str(len(values)) + {3: "H", 4: "I", 7: "B"}[kind], *values)
        if len(packed) > 4:
            at = len(body)
            body += packed
            packed = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    body[4:8] = struct.pack(order + "I", len(body))
    return bytes(body + struct.pack(order + "H", len(fields)) + entries + b"\0\0\0\0")


def slide_bytes(spark: SparkSession, pixels: np.ndarray, tile: int = 512, empty: set[int] = frozenset(), cut: set[int] = frozenset(), **how) -> bytes:
    """A slide of an image: tiles in empty have no bytes, those in cut are broken off half-way."""
    rows, columns = pixels.shape[:2]
    nx, ny = -(-columns // tile), -(-rows // tile)
    padded = np.zeros((ny * tile, nx * tile, 3), np.uint8)
    padded[:rows, :columns] = pixels
    tiles, tables = [], b""
    for k in range(nx * ny):
        if k in empty:
            tiles.append(None)
            continue
        r, c = divmod(k, nx)
        tables, t = parted(encode(spark, padded[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]))
        tiles.append(t[: len(t) // 2] if k in cut else t)
    return tiff_bytes(columns, rows, tile, tiles, tables, **how)
