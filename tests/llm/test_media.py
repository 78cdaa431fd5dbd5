import hashlib
import os
import struct
import zlib

import numpy as np
import pytest

from pagelattice.llm import media


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1024, 1025, 4096, 100_001])
def test_payload_round_trip(size):
    for data in (os.urandom(size), b"\xff" * size, b"\0" * size):
        padded = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        frames, fps = media.read_avi(media.write_avi(media.encode_frames(padded)))
        images = media.decode_frames(frames)
        assert b"".join(x.tobytes() for x in images) == padded
        assert fps == 25 and all(x.shape[1] == 64 for x in images)


def test_any_huffman_table():
    """A frame with another table and a width that is not a multiple of eight."""
    counts, symbols = [0, 1, 5, 1, 1, 1] + [0] * 10, [0, 1, 2, 3, 4, 5, 6, 7, 8]
    code = {s: (n, c) for (n, c), s in media._codes(counts, symbols).items()}
    image = np.random.default_rng(1).integers(0, 256, (5, 7))
    bits = ""
    for y in range(5):
        for x in range(7):
            near = 128 if x == y == 0 else image[y - 1, 0] if x == 0 else image[y, x - 1]
            d = int(image[y, x]) - int(near)
            s = abs(d).bit_length()
            n, c = code[s]
            bits += f"{c:0{n}b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "")
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + media._segment(0xC4, b"\x00" + bytes(counts) + bytes(symbols)) + media._segment(0xC3, bytes([8, 0, 5, 0, 7, 1, 1, 0x11, 0])) + media._SCAN
    assert (media.decode_frames([head + data + b"\xff\xd9"])[0] == image).all()


def _baseline(coefficients, high, wide, factors, restart=0):
    """A baseline frame: quantised ``coefficients[component]`` by blocks (down, across, 64) in coded order."""
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15)]
    tables = bytes([0]) + bytes([0] * 3 + [12] + [0] * 12) + bytes(dc) + bytes([16]) + bytes([0] * 7 + [len(ac)] + [0] * 8) + bytes(ac)
    quant = [1 + k // 4 for k in range(64)]
    bits, out, before = [], [], {}

    def put(value, n):
        bits.extend(value >> (n - 1 - k) & 1 for k in range(n))

    def number(v):
        s = abs(v).bit_length()
        return s, (v if v > 0 else v + (1 << s) - 1)

    def close():
        bits.extend([1] * (-len(bits) % 8))
        out.append(np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00"))
        bits.clear()
        before.clear()

    across = coefficients[0].shape[1] // factors[0][0]
    units = across * (coefficients[0].shape[0] // factors[0][1])
    for unit in range(units):
        for c, (h, v) in enumerate(factors):
            for b in range(h * v):
                block = coefficients[c][unit // across * v + b // h, unit % across * h + b % h]
                s, extra = number(int(block[0]) - before.get(c, 0))
                before[c] = int(block[0])
                put(dc.index(s), 4)
                put(extra, s)
                zeros = 0
                for x in block[1:]:
                    if not x:
                        zeros += 1
                        continue
                    for _ in range(zeros // 16):
                        put(ac.index(0xF0), 8)
                    s, extra = number(int(x))
                    put(ac.index(zeros % 16 << 4 | s), 8)
                    put(extra, s)
                    zeros = 0
                if zeros:
                    put(ac.index(0), 8)
        if restart and (unit + 1) % restart == 0 and unit + 1 < units:
            close()
            out.append(bytes([0xFF, 0xD0 + (unit + 1) // restart % 8 - 1 & 0xD7]))
    close()
    size = struct.pack(">BHHB", 8, high, wide, len(factors)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    scan = bytes([len(factors)]) + b"".join(bytes([i + 1, 0]) for i in range(len(factors))) + b"\x00\x3f\x00"
    head = media._segment(0xDB, b"\x00" + bytes(quant)) + media._segment(0xC4, tables) + media._segment(0xC0, size)
    head += media._segment(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + head + media._segment(0xDA, scan) + b"".join(out) + b"\xff\xd9", quant


def _samples(blocks, quant):
    """The cosine sums of the definition, term by term."""
    down, across = blocks.shape[:2]
    image = np.zeros((down * 8, across * 8))
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else -(i // 8)))
    c = [8**-0.5] + [0.5] * 7
    wave = [[c[u] * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]
    for r in range(down):
        for k in range(across):
            for n, place in enumerate(order):
                if blocks[r, k, n]:
                    image[8 * r : 8 * r + 8, 8 * k : 8 * k + 8] += blocks[r, k, n] * quant[n] * np.outer(wave[place // 8], wave[place % 8])
    return np.clip(np.rint(image + 128), 0, 255)


@pytest.mark.parametrize(("factors", "restart"), [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 3), ([(1, 1)] * 3, 2)])
def test_baseline_frames(factors, restart):
    rng = np.random.default_rng(1)
    units = 3, 4
    coefficients = []
    for h, v in factors:
        x = rng.integers(-9, 10, (units[0] * v, units[1] * h, 64)) * (rng.random((units[0] * v, units[1] * h, 64)) < 0.2)
        x[..., 0] = rng.integers(-300, 300, x.shape[:2])
        coefficients.append(x)
    high, wide = units[0] * 8 * factors[0][1] - 3, units[1] * 8 * factors[0][0] - 5
    frame, quant = _baseline(coefficients, high, wide, factors, restart)
    found = media.decode_baseline(frame)
    want = _samples(coefficients[0], quant)[:high, :wide]
    assert found.shape == (high, wide) and np.abs(found - want).max() <= 1 and (found == want).mean() > 0.999
    lossless = media.encode_frames(bytes(64 * 16))
    assert [x.shape for x in media.decode_frames([frame, *lossless])] == [(high, wide), (16, 64)]
    clips = media.clips(media.write_avi([frame] * 3, wide, high))
    assert clips == [(0, 0.0, 3 / 25, 3)]
    for cut in range(0, len(frame) - 3, 7):
        try:
            media.decode_baseline(frame[:cut])
        except ValueError:
            pass


def test_broken_media_give_an_error_row(spark):
    avi = media.store("some text " * 300)
    frames, _ = media.read_avi(avi)
    progressive = frames[0].replace(b"\xff\xc3", b"\xff\xc2", 1)
    rows = [(1, avi), (2, b"no media"), (3, avi[:-40]), (4, None), (5, media.write_avi([])), (6, media.write_avi([frames[0][:200]])), (7, media.write_avi([progressive]))]
    got = media.clip_rows(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {r.doc_id for r in got if r.error is None} == {1}
    assert sorted(r.doc_id for r in got if r.error) == [2, 3, 6, 7] and all(r.clip is None and r.frames is None for r in got if r.error)


def test_parse_without_index_and_errors():
    avi = media.store("some text " * 300)
    frames, _ = media.read_avi(avi)
    at = avi.rfind(b"idx1")
    bare = avi[:4] + (at - 8).to_bytes(4, "little") + avi[8:at]
    assert media.read_avi(bare)[0] == frames
    for broken in (b"", b"RIFFxxxx", avi[:300], b"RIFF" + avi[4:8] + b"WAVE" + avi[12:]):
        with pytest.raises(ValueError):
            media.read_avi(broken)


def test_shots():
    dark, light = np.full((16, 64), 20, np.uint8), np.full((16, 64), 200, np.uint8)
    assert media.cuts([dark] * 4 + [light] * 5 + [dark] * 3) == [4, 9]
    assert media.cuts([dark] * 9) == [] == media.cuts([dark]) == media.cuts([])
    payload = b"\x14" * 4096 + b"\xc8" * 4096
    clips = media.clips(media.write_avi(media.encode_frames(payload)))
    assert clips == [(0, 0.0, 4 / 25, 4), (1, 4 / 25, 8 / 25, 4)]
    assert media.clips(None) == []


def _check(docs, rows):
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        want.append((r.doc_id, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    got = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows(spark, sf, odd_docs, no_docs):
    _check(spark.read.parquet(f"{sf}/documents.parquet"), media.op8_media(spark, sf).collect())
    rows = media.digest_rows(odd_docs).collect()
    _check(odd_docs, rows)
    equal = {}
    for r in rows:
        equal.setdefault(r.payload_sha256, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in equal.values())
    assert media.digest_rows(no_docs).collect() == []


def test_columns(odd_docs):
    stored = media.store_rows(odd_docs)
    clips = media.clip_rows(stored).collect()
    assert {r.doc_id for r in clips} == {r.doc_id for r in odd_docs.collect()}
    one = sorted((r.clip, r.start_s, r.end_s) for r in clips if r.doc_id == 5)
    assert one[0][1] == 0 and all(a[2] == b[1] for a, b in zip(one, one[1:]))
