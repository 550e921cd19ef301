"""Images from their bytes: grey rows of PNG and BMP files, and vectors of what they show, which need no model.

An image is read a band of rows at a time, so a task holds little of it however large it is (an interlaced one is held as grey bytes).
What can't be read raises ValueError with the reason.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np

#: Pixels in a band; the longest row, in bytes; pixels that an interlaced image may have.
BAND, MOST_ROW, MOST_INTERLACED = 1 << 18, 1 << 24, 1 << 26
#: Bytes of an anti-diagonal from which on its bytes are found at once.
DIAGONAL = 128
#: Cells of a descriptor to a side, and sums of a cell.
GRID, SUMS = 4, 4
#: First bytes of a PNG; samples of a pixel by its colour type; first column, first row and steps of the passes of an interlaced image.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class Grey(NamedTuple):
    width: int
    height: int
    bands: Iterator[np.ndarray]


def guesses(kinds: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What the filters of PNG rows (0 to 4, broadcast to the pixels) expect of a byte from its neighbours."""
    by_left, by_up = np.abs(up - corner), np.abs(left - corner)
    by_corner = np.abs(left + up - 2 * corner)
    nearest = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
    return np.select([kinds == 1, kinds == 2, kinds == 3, kinds == 4], [left, up, (left + up) >> 1, nearest], 0)


def unfiltered(raw: np.ndarray, step: int, above: np.ndarray) -> np.ndarray:
    """The bytes of filtered rows (the first of each is its filter), given the row above; ``step`` bytes are a pixel.

    Rows whose filter looks to one side only are summed at once. For the others a byte waits for the one to its left and the ones above. Where
    anti-diagonals are long, all bytes of one are found at once, whatever the filters of their rows; where they are short, a byte at a time.
    """
    kinds, n, width = raw[:, 0], len(raw), raw.shape[1] - 1
    if kinds.max(initial=0) > 4:
        raise ValueError("a row has an unknown filter")
    out = np.zeros((n + 1, width + step), np.int16)
    out[0, step:], out[1:, step:] = above, raw[:, 1:]
    hard = np.flatnonzero(kinds > 2)
    begin, end = (hard[0], hard[-1] + 1) if hard.size else (n, n)
    if min((end - begin) * step, width) < DIAGONAL:
        begin, end, hard = n, n, hard[:0]
    for y in chain(range(begin), range(end, n)):
        if y == end:
            _diagonals(out.reshape(n + 1, -1, step), kinds, begin, end)
        row = out[y + 1, step:]
        if kinds[y] == 1:
            row[:] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kinds[y] == 2:
            row[:] = (row + out[y, step:]) & 255
        elif kinds[y] > 2:
            row[:] = _bytewise(int(kinds[y]), row.tolist(), out[y].tolist(), step)
    if end == n and hard.size:
        _diagonals(out.reshape(n + 1, -1, step), kinds, begin, end)
    return out[1:, step:].astype(np.uint8)


def _bytewise(kind: int, row: list[int], above: list[int], step: int) -> list[int]:
    """A row of filter 3 or 4; ``above`` begins with a pixel of zeros."""
    out = [0] * step
    if kind == 3:
        for x, left, up in zip(row, out, above[step:], strict=False):  # ``out`` grows while it is read
            out.append((x + ((left + up) >> 1)) & 255)
        return out[step:]
    for x, left, up, corner in zip(row, out, above[step:], above, strict=False):
        by_left, by_up = abs(up - corner), abs(left - corner)
        by_corner = abs(left + up - 2 * corner)
        out.append((x + (left if by_left <= by_up and by_left <= by_corner else up if by_up <= by_corner else corner)) & 255)
    return out[step:]


def _diagonals(out: np.ndarray, kinds: np.ndarray, begin: int, end: int) -> None:
    across, n = out.shape[1] - 1, end - begin
    for t in range(n + across - 1):
        y = np.arange(max(0, t - across + 1), min(n, t + 1))
        x, y = t - y, y + begin
        guess = guesses(kinds[y][:, None], out[y + 1, x], out[y, x + 1], out[y, x])
        out[y + 1, x + 1] = (out[y + 1, x + 1] + guess) & 255


def _brightness(colours: np.ndarray) -> np.ndarray:
    """Grey of (..., 3) red, green and blue."""
    c = colours.astype(np.int32)
    return (299 * c[..., 0] + 587 * c[..., 1] + 114 * c[..., 2] + 500) // 1000


def _on_white(grey: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    a = alpha.astype(np.int32)
    return (grey.astype(np.int32) * a + 255 * (255 - a) + 127) // 255


def _chunks(content: bytes) -> Iterator[tuple[bytes, memoryview]]:
    at, view = len(SIGNATURE), memoryview(content)
    while at + 12 <= len(content):
        size = int.from_bytes(view[at : at + 4], "big")
        name, data = bytes(view[at + 4 : at + 8]), view[at + 8 : at + 8 + size]
        if zlib.crc32(view[at + 4 : at + 8 + size]) != int.from_bytes(view[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk is damaged")
        yield name, data
        at += 12 + size
        if name == b"IEND":
            break


class _Inflated:
    """The pixels' bytes, taken as they are asked for."""

    def __init__(self, parts: list[memoryview]) -> None:
        self.parts, self.zip, self.rest = iter(parts), zlib.decompressobj(), b""

    def take(self, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            data = self.rest or next(self.parts, None)
            try:
                new = self.zip.decompress(data or b"", n - len(out))
            except zlib.error as e:
                raise ValueError("pixels are damaged") from e
            if not new and (data is None or self.zip.eof):
                raise ValueError("pixels are missing")
            out += new
            self.rest = self.zip.unconsumed_tail
        return bytes(out)


def _png(content: bytes) -> Grey:
    head = palette = alphas = None
    pixels: list[memoryview] = []
    for name, data in _chunks(content):
        if name == b"IHDR" and len(data) == 13:
            head = struct.unpack(">IIBBBBB", data)
        elif name == b"PLTE":
            palette = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alphas = np.frombuffer(data, np.uint8)
        elif name == b"IDAT":
            pixels.append(data)
    if head is None:
        raise ValueError("there is no header")
    width, height, depth, colour, _, _, interlaced = head
    samples = SAMPLES.get(colour, 0)
    if not width or not height or not samples or depth not in (1, 2, 4, 8, 16) or depth < 8 and samples > 1 or (colour == 3 and (palette is None or depth > 8)):
        raise ValueError("the header makes no sense")
    if colour == 3:  # the grey of each entry; numbers beyond the palette are black
        shades = np.zeros(256, np.int32)
        shades[: len(palette)] = _brightness(palette)
        if alphas is not None:
            n = min(len(alphas), 256)
            shades[:n] = _on_white(shades[:n], alphas[:n])
    step, source = max(1, samples * depth // 8), _Inflated(pixels)

    def grey(data: np.ndarray, across: int) -> np.ndarray:
        if depth == 16:
            data = data[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(data, axis=1)[:, : across * depth].reshape(len(data), across, depth)
            data = bits @ (1 << np.arange(depth - 1, -1, -1, dtype=np.int32))
            data = data if colour == 3 else data * 255 // ((1 << depth) - 1)
        each = data.reshape(len(data), across, samples)
        if colour == 3:
            return shades[each[..., 0]].astype(np.uint8)
        out = _brightness(each) if samples > 2 else each[..., 0]
        return (_on_white(out, each[..., -1]) if samples in (2, 4) else out).astype(np.uint8)

    def rows(across: int, down: int) -> Iterator[np.ndarray]:
        stride = -(-across * samples * depth // 8)
        if stride > MOST_ROW:
            raise ValueError(f"a row has over {MOST_ROW} bytes")
        above, each = np.zeros(stride, np.uint8), max(1, BAND // across)
        for y in range(0, down, each):
            n = min(each, down - y)
            raw = np.frombuffer(source.take(n * (stride + 1)), np.uint8).reshape(n, stride + 1)
            data = unfiltered(raw, step, above)
            above = data[-1]
            yield grey(data, across)

    def woven() -> Iterator[np.ndarray]:
        if width * height > MOST_INTERLACED:
            raise ValueError(f"an interlaced image has over {MOST_INTERLACED} pixels")
        whole = np.zeros((height, width), np.uint8)
        for x, y, dx, dy in PASSES:
            part = whole[y::dy, x::dx]
            if part.size:
                at = 0
                for band in rows(part.shape[1], part.shape[0]):
                    part[at : at + len(band)] = band
                    at += len(band)
        yield whole

    return Grey(width, height, woven() if interlaced else rows(width, height))


def _bmp(content: bytes) -> Grey:
    try:
        at, size, width, height, _, depth, packing = struct.unpack_from("<I", content, 10) + struct.unpack_from("<IiiHHI", content, 14)
        used = struct.unpack_from("<I", content, 46)[0]
    except struct.error as e:
        raise ValueError("there is no header") from e
    down = abs(height)
    if width <= 0 or not down or packing or depth not in (8, 24, 32):
        raise ValueError("bitmaps of this kind are not read")
    stride = (width * depth + 31) // 32 * 4
    if stride > MOST_ROW or len(content) < at + stride * down:
        raise ValueError("pixels are missing")
    if depth == 8:
        table = np.frombuffer(content, np.uint8, 4 * min(used or 256, 256, (len(content) - 14 - size) // 4), 14 + size).reshape(-1, 4)
        shades = np.zeros(256, np.int32)
        shades[: len(table)] = _brightness(table[:, 2::-1])

    def rows() -> Iterator[np.ndarray]:
        each = max(1, BAND // width)
        for y in range(0, down, each):
            n = min(each, down - y)
            first = y if height < 0 else down - y - n
            data = np.frombuffer(content, np.uint8, n * stride, at + first * stride).reshape(n, stride)[:: 1 if height < 0 else -1]
            if depth == 8:
                yield shades[data[:, :width]].astype(np.uint8)
            else:
                yield _brightness(data[:, : width * depth // 8].reshape(n, width, -1)[..., 2::-1]).astype(np.uint8)

    return Grey(width, down, rows())


def grey(content: bytes) -> Grey:
    """Size and grey rows of a PNG (all kinds, on white) or an unpacked BMP."""
    if content[:8] == SIGNATURE:
        return _png(content)
    if content[:2] == b"BM":
        return _bmp(content)
    raise ValueError("not a PNG or BMP image")


def sums(image: Grey) -> np.ndarray:
    """(GRID * GRID, SUMS) whole numbers: of each cell of the grid the brightness (from 1) and the slopes along, across and between, all summed over pixels.

    A pixel's slope is the difference of the pixels to its sides plus that of the ones above and below (the edge stands for what is beyond it);
    it counts as along or across if that part is twice the other or more.
    """
    width, height = image.width, image.height
    out = np.zeros(GRID * GRID * SUMS, np.int64)
    column = np.arange(width, dtype=np.int64) * GRID // width
    held, y = None, 0

    def add(rows: np.ndarray, first: int) -> None:
        mid = rows[1:-1]
        sides = np.pad(mid, ((0, 0), (1, 1)), mode="edge")
        along, across = np.abs(sides[:, 2:] - sides[:, :-2]), np.abs(rows[2:] - rows[:-2])
        kind = np.where(along >= 2 * across, 1, np.where(across >= 2 * along, 2, 3))
        cell = ((np.arange(first, first + len(mid), dtype=np.int64) * GRID // height)[:, None] * GRID + column) * SUMS
        out[:] += np.bincount(cell.ravel(), (mid + 1).ravel(), out.size).astype(np.int64)
        out[:] += np.bincount((cell + kind).ravel(), (along + across).ravel(), out.size).astype(np.int64)

    for band in image.bands:
        band = band.astype(np.int32)
        held = np.concatenate([band[:1], band] if held is None else [held, band])
        if len(held) > 2:
            add(held, y)
            y, held = y + len(held) - 2, held[-2:]
    add(np.concatenate([held, held[-1:]]), y)
    return out.reshape(GRID * GRID, SUMS)


def describe(images: list[bytes]) -> np.ndarray:
    """A vector of length 1, of 64 numbers, for each image: its sums, divided by their length. No image has the zero vector."""
    flat = np.array([sums(grey(x)).ravel() for x in images], np.float64).reshape(len(images), GRID * GRID * SUMS)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def to_png(rows: np.ndarray, filters: tuple[int, ...] = (2,)) -> bytes:
    """A PNG of grey bytes (height, width); its rows have ``filters`` in turn."""
    height, width = rows.shape
    padded = np.zeros((height + 1, width + 1), np.int16)
    padded[1:, 1:] = rows
    kinds = np.resize(np.array(filters, np.uint8), height)[:, None]
    data = (padded[1:, 1:] - guesses(kinds, padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1])).astype(np.uint8)
    chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(np.concatenate([kinds, data], 1).tobytes(), 1)) + chunk(b"IEND", b"")
