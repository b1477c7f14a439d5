import hashlib
import struct
import zlib

import numpy as np
import pytest

from tripleweave.llm import media


def png(rows, kinds, width):
    """An image with given filters, made by the format's rules sample by sample."""
    out, above = b"", [0] * width
    for row, kind in zip(rows, kinds):
        line = []
        for x, v in enumerate(row):
            a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda q: (abs(p - q), (a, b, c).index(q)))
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind, *line])
        above = row
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return media.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_all_filters():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (40, 17)).tolist()
    kinds = rng.integers(0, 5, 40).tolist()
    assert media.decode_png(png(rows, kinds, 17)).tolist() == rows


def test_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 575, 576, 577, 5000, 300_000):
        payload = media.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert len(payload) % 576 == 0 and len(payload) >= 576 and media.decode_png(media.encode_png(payload)).tobytes() == payload
    smooth = bytes(range(64)) * 900
    assert media.decode_png(media.encode_png(smooth, part=100)).tobytes() == smooth


@pytest.mark.parametrize("at", [3, 20, 30, 60, -6])
def test_a_changed_byte_is_noticed(at):
    data = bytearray(media.encode_png(media.padded(b"hello" * 300)))
    data[at] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(data))
    with pytest.raises(ValueError):
        media.decode_png(bytes(data[:50]))


def test_cosine_transform_is_the_definition():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (70, 576)).astype(np.uint8)
    small = media.shrunk(x)
    assert np.isclose(small[0, 0], x[0:2, 0:18].mean()) and small.shape == (32, 32)
    low = np.array([[sum(small[i, j] * np.cos(np.pi * u * (i + 0.5) / 32) * np.cos(np.pi * v * (j + 0.5) / 32) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)])
    flat = np.round(low.ravel(), 6)
    flat[0] = 0
    assert np.packbits(flat > np.median(flat[1:])).tobytes() == media.cosine_hash(x)


def test_operator(spark, table, edge_rows):
    df = table(edge_rows)
    stored = media.to_png(df)
    out = {}
    for r in media.read_png(stored).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(edge_rows)
    for k, text, *_ in edge_rows:
        want = media.padded((text or "").encode())
        assert any(bytes(r["payload"]) == want and r["n_bytes"] == len((text or "").encode()) and len(r["phash"]) == 8 for r in out[k])
    assert len({hashlib.sha256(bytes(out[k][0]["media"])).digest() for k in (6, 7)}) == 1
    assert media.read_png(media.to_png(table([]))).count() == 0
    broken = spark.createDataFrame([(1, b"no image"), (2, None)], "id int, media binary")
    assert [(r["payload"], r["phash"]) for r in media.read_png(broken).collect()] == [(None, None)] * 2
