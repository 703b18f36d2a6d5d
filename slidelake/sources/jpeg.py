"""Baseline JPEG decoding after ITU-T T.81, vectorised across tiles.

Tiles that share tables and geometry are decoded in lock step: in each step every tile that is not done looks up one Huffman
symbol, or two if they fit, by its next 16 bits and moves on. A step only records where it stood and what it found; the values
behind the symbols are taken from the record in bulk, so a step is a dozen operations on one element per tile. Everything after that is matrix
work on all blocks at once, and blocks without AC coefficients skip it.

Supported: 8-bit baseline, no restart intervals, one component (grey), three, or four (the fourth, alpha, is dropped), any
whole-number sampling whose chroma is not finer than its luma. What a tile decodes to depends on the tile and its tables only,
never on its neighbours in the batch; a tile that cannot be decoded is reported as damaged and the others go on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from ..functions.pixels import BLUE_CB, GREEN_CB, GREEN_CR, LUMA_B, LUMA_BITS, LUMA_G, LUMA_HALF, LUMA_R, RED_CR

# Order in which the coefficients of a block are stored.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

#: Orthonormal 8-point cosine basis: basis[frequency, sample].
BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)


class JpegError(ValueError):
    pass


#: Steps between two looks at which tiles are done, at most, and the most compressed bytes that are decoded together.
STEPS, MOST_BYTES = 512, 12 << 20
#: Tiles that go in lock step, at most: so many, or as many more small ones as hold so many blocks.
MOST_TILES, MOST_BLOCKS = 256, 100_000
#: Tiles whose blocks are transformed together: so many, or as many more small ones as hold so many blocks.
PLANE_STEP, PLANE_BLOCKS = 4, 20_000


@dataclass
class Header:
    """What the marker segments before the scan say. Tables may come from one stream and the frame from another."""

    quant: dict[int, tuple[int, ...]] = field(default_factory=dict)  # in stored order
    huffman: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)  # code counts by length, symbols
    width: int = 0
    height: int = 0
    parts: tuple[tuple[int, int, int, int], ...] = ()  # id, h, v, quant table
    coding: dict[int, tuple[int, int]] = field(default_factory=dict)  # id -> DC, AC table
    scan: int = 0  # where the entropy-coded bytes begin

    def key(self) -> tuple:
        """Equal for tiles that can be decoded in lock step: the geometry and the tables in force, by content."""
        return (self.width, self.height, self.parts, tuple((self.quant[p[3]], self.huffman[0, self.coding[p[0]][0]], self.huffman[1, self.coding[p[0]][1]]) for p in self.parts))


# What the next 16 bits say, packed into 64: bits to move on (6), 63 if the block ends (6), size of the last value (4), size of
# the first value of two (4), bits of the first symbol of two (5), its run of zeros (4), and from bit 32 on the coefficients
# before the last one.
ENDS, LAST, FIRST, FIRST_BITS, FIRST_RUN, RUN = 6, 12, 16, 20, 25, 32


@lru_cache(maxsize=64)
def lookup(lengths: bytes, symbols: bytes, ac: bool) -> np.ndarray:
    """One symbol by the next 16 bits. No code or an impossible symbol moves on by 63 bits, which no valid symbol does."""
    out = np.full(1 << 16, 63, np.int64)
    at = k = 0
    for n, how_many in enumerate(lengths, start=1):
        for _ in range(how_many):
            span = 1 << (16 - n)
            if at + span > 1 << 16 or k >= len(symbols):
                raise JpegError("Huffman table is not a prefix code")
            run, size = (symbols[k] >> 4, symbols[k] & 15) if ac else (0, symbols[k])
            if ac and not size and run != 15:
                out[at : at + span] = n | 63 << ENDS
            elif size < 16:
                out[at : at + span] = n + size | size << LAST | run << RUN
            at += span
            k += 1
    return out


@lru_cache(maxsize=64)
def lookup_two(lengths: bytes, symbols: bytes) -> np.ndarray:
    """As lookup for AC codes, but two symbols at once where the code of the second lies within the 16 bits too.

    Only for coefficients so early in a block that the first of two cannot end it.
    """
    one = lookup(lengths, symbols, True)
    bits, size, run = one & 63, (one >> LAST) & 15, one >> RUN
    then = one[(np.arange(1 << 16) << np.minimum(bits, 16)) & 0xFFFF]
    code = (then & 63) - ((then >> LAST) & 15)
    fits = (bits < 16) & ((one >> ENDS) & 63 == 0) & ((then & 63) != 63) & (code <= 16 - bits)
    two = then + bits + (size << FIRST) + (bits << FIRST_BITS) + (run << FIRST_RUN) + (run + 1 << RUN)
    return np.where(fits, two, one)


def read_segments(data: bytes, into: Header) -> Header:
    """Walk the marker segments of a stream up to its scan or end."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError(f"marker expected at byte {at}")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                into.quant[name] = struct.unpack_from(">64H" if wide else ">64B", body, k + 1)
                k += 129 if wide else 65
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                into.huffman[body[k] >> 4, body[k] & 15] = body[k + 1 : k + 17], body[k + 17 : k + 17 + n]
                k += 17 + n
        elif kind == 0xC0:
            depth, into.height, into.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise JpegError("only 8-bit samples")
            into.parts = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n))
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8:
            raise JpegError("only baseline coding")
        elif kind == 0xDD and struct.unpack_from(">H", body)[0]:
            raise JpegError("restart intervals are not supported")
        elif kind == 0xDA:
            into.coding = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            into.scan = at + 2 + size
            return into
        at += 2 + size
    return into


@lru_cache(maxsize=16)
def shared_tables(tables: bytes) -> Header:
    """The tables that a slide's tiles share; unreadable ones are as good as none, and the tiles that need them are damaged."""
    try:
        return read_segments(tables, Header()) if tables else Header()
    except (JpegError, IndexError, struct.error):
        return Header()


def header_of(tile: bytes, shared: Header) -> Header | None:
    """The tile's header over the shared tables; None if it cannot be decoded."""
    try:
        h = read_segments(tile, Header(dict(shared.quant), dict(shared.huffman)))
        h.key()  # every table that the frame names is there
    except (JpegError, IndexError, KeyError, struct.error):
        return None
    ok = h.scan and h.width and h.height and len(h.parts) in (1, 3, 4) and all(1 <= p[1] <= 4 and 1 <= p[2] <= 4 for p in h.parts)
    return h if ok and all(h.parts[0][k] % p[k] == 0 for p in h.parts for k in (1, 2)) else None


def entropy_bytes(tile: bytes, start: int) -> tuple[bytes, bool]:
    """The scan's bytes without stuffing, up to the end of image; whether that end is there."""
    end = tile.find(b"\xff\xd9", start)
    return tile[start : end if end >= 0 else len(tile)].replace(b"\xff\x00", b"\xff"), end >= 0


@dataclass
class Group:
    """Tiles of one geometry: their positions in the batch, planes by component, and which of them are damaged."""

    at: np.ndarray
    planes: list[np.ndarray]  # (n, rows, columns) uint8, cut to the image; none if the tiles could not be read at all
    damaged: np.ndarray


def grouped(tiles: list[bytes], tables: bytes, size: tuple[int, int] | None) -> Iterator[tuple[Header | None, list[int]]]:
    """Tiles that go in lock step, by header; under None those that cannot be decoded or are not of size (width, height)."""
    shared = shared_tables(tables)
    known: dict[bytes, tuple[Header, tuple]] = {}  # by the bytes before the scan, which a header depends on alone
    lengths: list[int] = []
    heads: dict[tuple | None, Header | None] = {}
    groups: dict[tuple | None, list[int]] = {}
    for i, t in enumerate(tiles):
        met = next((m for n in lengths[:8] if (m := known.get(t[:n])) is not None), None)
        if met is None and (h := header_of(t, shared)) is not None:
            met = known[t[: h.scan]] = h, h.key() + (h.scan,)
            if h.scan not in lengths:
                lengths.append(h.scan)
        key = None if met is None or size not in (None, (met[0].width, met[0].height)) else met[1]
        heads.setdefault(key, None if key is None else met[0])
        groups.setdefault(key, []).append(i)
    for key, at in groups.items():
        head = heads[key]
        at.sort(key=lambda i: len(tiles[i]))  # tiles of like length are done at about the same step
        runs = max(1, -(-len(at) // at_once(head, MOST_TILES, MOST_BLOCKS)), -(-sum(len(tiles[i]) for i in at) // MOST_BYTES))
        for k in range(runs):
            part = at[k * len(at) // runs : (k + 1) * len(at) // runs]
            if part:
                yield head, part


def decode(tiles: list[bytes], tables: bytes = b"", size: tuple[int, int] | None = None) -> Iterator[Group]:
    """The tiles' planes, in groups of like tiles. A tile that breaks off or has an impossible code is damaged, and so is
    one that is not of size (width, height), if that is given."""
    for h, at in grouped(tiles, tables, size):
        got = None
        if h is not None:
            try:
                got = coefficients([tiles[i] for i in at], h)
            except JpegError:  # tables that are no prefix code
                pass
        if got is None:
            yield Group(np.array(at), [], np.ones(len(at), bool))
            continue
        step = at_once(h, PLANE_STEP, PLANE_BLOCKS)
        for k in range(0, len(at), step):
            yield Group(np.array(at[k : k + step]), _planes(got[0][k : k + step], h), got[1][k : k + step])


def shape_of(h: Header) -> tuple[int, int, list[int]]:
    """MCUs across and down, and the component of each block of an MCU."""
    hm, vm = h.parts[0][1], h.parts[0][2]
    return -(-h.width // (8 * hm)), -(-h.height // (8 * vm)), [c for c, p in enumerate(h.parts) for _ in range(p[1] * p[2])]


def at_once(h: Header | None, tiles: int, blocks: int) -> int:
    """How many tiles of a header go together: tiles of them, or as many more as hold so many blocks."""
    if h is None:
        return tiles
    across, down, pattern = shape_of(h)
    return max(tiles, blocks // (across * down * len(pattern)))


def coefficients(tiles: list[bytes], h: Header) -> tuple[np.ndarray, np.ndarray]:
    """(tile, block in scan order, 64) in stored order, DC as differences; and which tiles are damaged.

    State per tile: the next bit, and q, the next coefficient counted through all blocks of the tile.
    """
    across, down, pattern = shape_of(h)
    names = [[(*h.huffman[kind, h.coding[p[0]][kind]], how) for kind, how in ((0, 0), (1, 1), (1, 2))] for p in h.parts]
    kinds = sorted({n for x in names for n in x})
    lut = np.concatenate([lookup_two(*k[:2]) if k[2] == 2 else lookup(*k[:2], k[2] == 1) for k in kinds])
    how = [0 if k == 0 else 2 if k <= 47 else 1 for k in range(64)]  # a run of 15 zeros and a value end before 64
    of_mcu = np.array([kinds.index(names[c][how[k]]) << 16 for c in pattern for k in range(64)], np.int64)
    table_of = np.tile(of_mcu, across * down)
    n, total = len(tiles), len(table_of)
    scans, whole = zip(*(entropy_bytes(t, h.scan) for t in tiles), strict=True)
    sizes = np.array([len(s) for s in scans], np.int64)
    starts = np.cumsum(sizes + 4) - (sizes + 4)  # zeros after each scan
    blob = np.frombuffer(b"".join(s + b"\0\0\0\0" for s in scans), np.uint8)
    wide = np.zeros(len(blob), np.uint32)
    wide[:-2] = blob[:-2].astype(np.uint32) << 16 | blob[1:-1].astype(np.uint32) << 8 | blob[2:]
    view = np.empty((len(blob), 8), np.uint16)  # the 16 bits from each bit on
    for k in range(8):
        view[:, k] = (wide >> np.uint32(8 - k)) & np.uint32(0xFFFF)
    view = view.reshape(-1)
    coefs = np.zeros((n, total), np.int16)
    flat = coefs.reshape(-1)
    broken = ~np.array(whole)
    live, pos, q = np.arange(n), starts * 8, np.zeros(n, np.int64)
    stop = (starts + sizes) * 8
    while len(live):
        m = len(live)
        steps = min(STEPS, max(32, int((stop - pos).max()) >> 4))  # short scans are done sooner
        p_at, q_at, e_at = np.empty((steps + 1, m), np.int64), np.empty((steps + 1, m), np.int64), np.empty((steps, m), np.int64)
        p_at[0], q_at[0] = pos, q
        bits, a, b = np.empty(m, np.uint16), np.empty(m, np.int64), np.empty(m, np.int64)
        one, ends, runs, low = (np.full(m, c, np.int64) for c in (1, ENDS, RUN, 63))  # numpy is slower with Python's numbers
        for t in range(steps):
            p, k, e = p_at[t], q_at[t], e_at[t]
            view.take(p, out=bits, mode="clip")
            table_of.take(k, out=a, mode="clip")
            np.add(a, bits, out=a)
            lut.take(a, out=e, mode="clip")
            np.bitwise_and(e, low, out=a)
            np.add(p, a, out=p_at[t + 1])
            np.right_shift(e, runs, out=a)
            np.add(k, a, out=a)
            np.right_shift(e, ends, out=b)
            np.bitwise_and(b, low, out=b)
            np.bitwise_or(a, b, out=a)
            np.add(a, one, out=q_at[t + 1])
        e, p, k = e_at.reshape(-1), p_at[:-1].reshape(-1), q_at[:-1].reshape(-1)
        bad, done = np.zeros(m, bool), (q_at[-1] >= total).any()
        lanes = np.broadcast_to(np.arange(m), e_at.shape).reshape(-1)
        found = []
        for shift in (LAST, FIRST):
            some = np.flatnonzero(e & (15 << shift))  # symbols with a value
            own, at = e[some], k[some]
            size = (own >> shift) & 15
            to, end = (at + (own >> RUN), own & 63) if shift == LAST else (at + ((own >> FIRST_RUN) & 15), (own >> FIRST_BITS) & 31)
            lane = lanes[some]
            value = view[np.minimum(p[some] + end - size, len(view) - 1)].astype(np.int64) >> (16 - size)
            value -= np.where(value >> (size - 1), 0, (1 << size) - 1)
            wild = (to ^ at) > 63  # past the block's end
            if wild.any():
                bad[lane[wild & (at < total)]] = True
            found.append((lane, at, to, value))
        for j in np.nonzero((p_at[-1] > stop) | (e_at == 63).any(axis=0))[0]:  # was that before the tile was done?
            there = q_at[:-1, j] < total
            bad[j] |= bool((there & ((e_at[:, j] == 63) | (p_at[1:, j] > stop[j]))).any())
        for lane, at, to, value in found:
            put = (at < total) & ~bad[lane] if done or bad.any() else slice(None)  # a tile that is done goes on idly
            flat[live[lane[put]] * total + to[put]] = value[put]
        broken[live[bad]] = True
        on = ~bad & (q_at[-1] < total)
        live, pos, q, stop = live[on], p_at[-1][on], q_at[-1][on], stop[on]
    return coefs.reshape(n, -1, 64), broken


@lru_cache(maxsize=32)
def transform_of(quant: tuple[int, ...]) -> np.ndarray:
    """Dequantisation and inverse transform of a block's 64 stored coefficients as one matrix."""
    out = np.einsum("vy,ux->vuyx", BASIS.astype(np.float64), BASIS.astype(np.float64)).reshape(64, 64)[ZIGZAG]
    return (out * np.array(quant, np.float64)[:, None]).astype(np.float32)


def _planes(coefs: np.ndarray, h: Header) -> list[np.ndarray]:
    """Undo prediction and quantisation, transform back and lay the blocks out. Rounded half-even, clamped."""
    n, out, lead = len(coefs), [], 0
    across, down, pattern = shape_of(h)
    hm, vm = h.parts[0][1], h.parts[0][2]
    by_mcu = coefs.reshape(n, across * down, len(pattern), 64)
    for _, hs, vs, q in h.parts[:3]:
        own = np.ascontiguousarray(by_mcu[:, :, lead : lead + hs * vs]).reshape(-1, 64)
        lead += hs * vs
        dc = np.cumsum(own[:, 0].reshape(n, -1), axis=1, dtype=np.int32).reshape(-1).astype(np.float32)
        matrix = transform_of(h.quant[q])
        words = own.view(np.int64)
        rich = np.nonzero((words[:, 1:] != 0).any(axis=1) | own[:, 1:4].any(axis=1))[0]
        level = np.clip(np.rint(dc * matrix[0, 0]) + 128, 0, 255).astype(np.uint8)
        px = np.repeat(level, 64).reshape(-1, 64)  # blocks of DC only are flat
        if len(rich):
            some = own[rich].astype(np.float32)
            some[:, 0] = dc[rich]
            grid = some @ matrix
            np.rint(grid, out=grid)
            grid += 128
            np.clip(grid, 0, 255, out=grid)
            px[rich] = grid.astype(np.uint8)
        px = px.reshape(n, down, across, vs, hs, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(n, down * vs * 8, across * hs * 8)
        out.append(px[:, : -(-h.height * vs // vm), : -(-h.width * hs // hm)])
    return out


def upsample(plane: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Nearest-neighbour upsampling to the luma size."""
    v, h = -(-rows // plane.shape[1]), -(-columns // plane.shape[2])
    if v == h == 1:
        return plane
    out = np.empty((len(plane), plane.shape[1] * v, plane.shape[2] * h), plane.dtype)
    for i in range(v):
        for j in range(h):
            out[:, i::v, j::h] = plane
    return out[:, :rows, :columns]


def _near(x: np.ndarray) -> np.ndarray:
    """Rounded half up, as the relational form does."""
    return np.floor(x + 0.5).astype(np.int16)


#: What chroma adds to luma for each channel. Luma is whole, so rounding the sum is rounding the summand.
_CHROMA = np.arange(256) - 128.0
_RED, _BLUE = _near(RED_CR * _CHROMA), _near(BLUE_CB * _CHROMA)
_GREEN = _near(-GREEN_CB * _CHROMA[:, None] - GREEN_CR * _CHROMA[None])


def channels(planes: list[np.ndarray]) -> list[np.ndarray]:
    """Red, green and blue (n, rows, columns) int16, clamped, of full-range YCbCr planes; grey for a single plane."""
    y = planes[0].astype(np.int16)
    if len(planes) == 1:
        return [y, y, y]
    cb, cr = planes[1], planes[2]
    parts = (_RED[cr], _GREEN[cb, cr] if cb.shape == cr.shape else _GREEN[upsample(cb, *y.shape[1:]), upsample(cr, *y.shape[1:])], _BLUE[cb])
    return [np.clip(y + upsample(p, *y.shape[1:]), 0, 255) for p in parts]


def rgb(planes: list[np.ndarray]) -> np.ndarray:
    """(n, rows, columns, 3) uint8."""
    return np.stack([c.astype(np.uint8) for c in channels(planes)], axis=-1)


def luma(planes: list[np.ndarray]) -> np.ndarray:
    """Integer luma of the planes' RGB, (n, rows, columns) uint8, without laying the pixels out."""
    if len(planes) == 1:
        return planes[0]
    r, g, b = (c.astype(np.int32) for c in channels(planes))
    r *= LUMA_R
    g *= LUMA_G
    b *= LUMA_B
    r += g
    r += b
    r += LUMA_HALF
    r >>= LUMA_BITS
    return r.astype(np.uint8)


def luma_of(pixels: np.ndarray) -> np.ndarray:
    p = pixels.astype(np.int32)
    return ((p[..., 0] * LUMA_R + p[..., 1] * LUMA_G + p[..., 2] * LUMA_B + LUMA_HALF) >> LUMA_BITS).astype(np.uint8)
