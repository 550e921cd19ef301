"""Images from their bytes: decoding against a plain restatement, descriptors, and a knowledge base that is searched by image."""

import random
import struct
import zlib

import numpy as np
import pytest

from tesserae.functions import image
from tesserae.operators.ingest import Config, KnowledgeBase
from tesserae.sources import files


def plain_rows(raw, width_bytes, height, step):
    """Filters undone a byte at a time, as the format's description says."""
    out, above = [], [0] * width_bytes
    for y in range(height):
        kind, *line = raw[y * (width_bytes + 1) : (y + 1) * (width_bytes + 1)]
        for i in range(width_bytes):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[i] = (line[i] + (0, a, b, (a + b) // 2, nearest)[kind]) % 256
        out.append(line)
        above = line
    return out


def file_of(width, height, depth, colour, raw, interlaced=0, extra=()):
    chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    packed = zlib.compress(raw)
    halves = chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:])
    return image.SIGNATURE + head + b"".join(chunk(n, x) for n, x in extra) + halves + chunk(b"IEND", b"")


def decoded(content):
    found = image.grey(content)
    out = np.concatenate(list(found.bands))
    assert out.shape == (found.height, found.width)
    return out


@pytest.mark.parametrize("diagonal", [1, 30, 10**9])
def test_filters_against_a_plain_decoder(monkeypatch, diagonal):
    monkeypatch.setattr(image, "BAND", 40)  # several bands an image
    monkeypatch.setattr(image, "DIAGONAL", diagonal)
    rng = random.Random(1)
    for colour, depth in [(0, 8), (0, 16), (2, 8), (2, 16), (4, 8), (6, 8), (6, 16)]:
        for height, width in [(1, 1), (7, 5), (23, 9), (5, 60)]:
            samples = image.SAMPLES[colour]
            step = samples * depth // 8
            raw = b"".join(bytes([rng.randrange(5)]) + rng.randbytes(width * step) for _ in range(height))
            lines = plain_rows(raw, width * step, height, step)
            want = np.zeros((height, width), int)
            for y, line in enumerate(lines):
                for x in range(width):
                    s = line[x * step : (x + 1) * step : depth // 8]
                    g = (299 * s[0] + 587 * s[1] + 114 * s[2] + 500) // 1000 if samples > 2 else s[0]
                    want[y, x] = (g * s[-1] + 255 * (255 - s[-1]) + 127) // 255 if samples in (2, 4) else g
            assert (decoded(file_of(width, height, depth, colour, raw)) == want).all()


def test_few_bits_palettes_and_interlacing():
    raw = bytes([0, 0b10110000, 0, 0b01000000])
    assert decoded(file_of(4, 2, 1, 0, raw)).tolist() == [[255, 0, 255, 255], [0, 255, 0, 0]]
    assert decoded(file_of(3, 1, 2, 0, bytes([0, 0b00011011]))).tolist() == [[0, 85, 170]]
    palette = (b"PLTE", bytes([255, 0, 0, 0, 0, 255])), (b"tRNS", bytes([255, 0]))
    assert decoded(file_of(4, 1, 4, 3, bytes([0, 0x01, 0x1F]), extra=palette)).tolist() == [[76, 255, 255, 0]]
    whole = np.arange(99, dtype=np.uint8).reshape(9, 11)
    parts = b"".join(bytes([0]) + bytes(line) for x, y, dx, dy in image.PASSES for line in whole[y::dy, x::dx])
    assert (decoded(file_of(11, 9, 8, 0, parts, interlaced=1)) == whole).all()
    assert decoded(file_of(1, 1, 8, 0, bytes([0, 9]), interlaced=1)).tolist() == [[9]]


def test_bitmaps():
    head = lambda w, h, depth, used=0: b"BM" + bytes(8) + struct.pack("<I", 54 + 4 * used) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, 0, 0, 0, 0, used, 0)
    bottom_up = bytes([0, 0, 255, 255, 0, 0, 0, 0]) + bytes([9, 9, 9, 255, 255, 255, 0, 0])
    assert decoded(head(2, 2, 24) + bottom_up).tolist() == [[9, 255], [76, 29]]
    assert decoded(head(2, -2, 24) + bottom_up).tolist() == [[76, 29], [9, 255]]
    assert decoded(head(1, 1, 32) + bytes([5, 5, 5, 0])).tolist() == [[5]]
    assert decoded(head(3, 1, 8, 2) + bytes([7, 7, 7, 0, 8, 8, 8, 0]) + bytes([1, 0, 9, 0])).tolist() == [[8, 7, 0]]


def plain_sums(p):
    h, w = p.shape
    out = np.zeros((16, 4), int)
    at = lambda y, x: int(p[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    for y in range(h):
        for x in range(w):
            a, b = abs(at(y, x + 1) - at(y, x - 1)), abs(at(y + 1, x) - at(y - 1, x))
            cell = out[y * 4 // h * 4 + x * 4 // w]
            cell[0] += at(y, x) + 1
            cell[1 if a >= 2 * b else 2 if b >= 2 * a else 3] += a + b
    return out


def test_descriptors(monkeypatch):
    rng = np.random.default_rng(2)
    for shape in [(1, 1), (3, 2), (17, 30), (40, 9)]:
        p = rng.integers(0, 256, shape, dtype=np.uint8)
        for band in (1 << 18, 20, 1):
            monkeypatch.setattr(image, "BAND", band)
            for filters in [(0,), (1, 2), (4, 3, 0, 1, 2)]:
                content = image.to_png(p, filters)
                assert (decoded(content) == p).all() and (image.sums(image.grey(content)) == plain_sums(p)).all()
    v = image.describe([image.to_png(np.full((8, 8), g, np.uint8)) for g in (0, 255)])
    assert v.shape == (2, 64) and np.allclose((v * v).sum(1), 1)
    assert image.describe([]).shape[0] == 0


@pytest.mark.parametrize("content", [
    b"", b"GIF89a", image.SIGNATURE, b"BM", image.to_png(np.zeros((9, 9), np.uint8))[:-30], file_of(2, 2, 8, 0, bytes([0, 1, 2])), file_of(1, 1, 8, 0, bytes([7, 1])),
    file_of(0, 2, 8, 0, b""), file_of(1, 1, 3, 0, bytes(2)), file_of(1 << 30, 1, 8, 0, bytes(9)), file_of(1 << 14, 1 << 14, 8, 0, bytes(9), interlaced=1),
    file_of(1, 1, 8, 3, bytes(2)), image.to_png(np.zeros((2, 2), np.uint8)).replace(b"IHDR\x00", b"IHDR\x01"),
])
def test_unreadable(content):
    with pytest.raises(ValueError):
        image.describe([content])


def test_searched_by_image(spark, tmp_path):
    rng = np.random.default_rng(3)
    top = tmp_path / "in"
    top.mkdir()
    shown = {f"{n}.png": np.kron(rng.integers(0, 256, (6, 6)), np.ones((5, 5))).astype(np.uint8) for n in range(9)}
    for name, p in shown.items():
        (top / name).write_bytes(image.to_png(p, (4, 1)))
    (top / "broken.png").write_bytes(image.to_png(shown["0.png"])[:60])
    (top / "note.txt").write_text("A note on pictures.")
    found = files.documents(files.discover(spark, str(top), mode="multimodal"), data=True).where("error IS NULL").drop("error")
    base = KnowledgeBase(spark, str(tmp_path / "kb"), Config(mode="multimodal"))
    skipped = base.ingest(found, images=image.describe).collect()
    assert [(r["source"].rsplit("/", 1)[1], r["reason"].split(":")[0]) for r in skipped] == [("broken.png", "ValueError")]
    assert "data" not in base.table("documents").columns + base.table("chunks").columns
    for again in (False, True):
        if again:
            base.rebuild(images=image.describe, data=found)
        for name, p in shown.items():
            dimmed = image.describe([image.to_png((p * 0.97).astype(np.uint8))])[0].tolist()
            best = base.search_vector(dimmed, k=3, content_type="image").orderBy("rank").collect()
            assert len(best) == 3 and best[0]["title"].startswith(name.split(".")[0]) and best[0]["score"] > 0.999
    base.rebuild(images=image.describe, data=found.where("source LIKE '%0.png'"))  # images whose bytes aren't given have no vector
    assert base.table("vectors").where("content_type = 'image'").count() == 1
