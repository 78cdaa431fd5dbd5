"""Media columns: AVI files of motion JPEG frames, written, parsed and cut into clips.

Frames are lossless JPEG (ITU-T T.81 process 14, predictor 1, 8-bit grey samples). The
writer's Huffman table gives the category of a difference with s extra bits a code of
9 - s bits, so a sample takes nine bits exactly and a frame decodes by table look-up
and running sums over whole arrays; any other table is decoded bit by bit. Files of other
writers hold frames of the baseline process (discrete cosine transform); these are decoded
to their luminance.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, FPS = 64, 16, 25
BINS = 16
#: A cut needs a histogram difference above the running mean by this factor, and above the least one.
CUT_FACTOR, CUT_LEAST = 1.5, 0.25
_FIXED = 9  # bits a sample with the writer's table


def _codes(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a canonical Huffman table."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


#: Lengths 1 to 9 have one code each, for the categories 8 down to 0.
_COUNTS, _SYMBOLS = [1] * 9 + [0] * 7, list(range(8, -1, -1))


def _difference_words() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit word of each difference + 255, and the difference of each word."""
    words, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for (n, code), s in _codes(_COUNTS, _SYMBOLS).items():
        for extra in range(1 << s):
            diff = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
            word = code << s | extra
            back[word] = diff
            if abs(diff) <= 255:
                words[diff + 255] = word
    return words, back


_WORDS, _BACK = _difference_words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLE = _segment(0xC4, b"\x00" + bytes(_COUNTS) + bytes(_SYMBOLS))
_SCAN = _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")


def _predicted(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences from the left sample, in column 0 from the one above; ``first`` marks frame starts."""
    diff = np.empty_like(rows)
    diff[:, 1:] = rows[:, 1:] - rows[:, :-1]
    diff[1:, 0] = rows[1:, 0] - rows[:-1, 0]
    diff[first, 0] = rows[first, 0] - 128
    return diff


def encode_frames(payload: bytes) -> list[bytes]:
    """Lossless JPEG frames of a payload whose size is a positive multiple of the width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int16)
    words = _WORDS[_predicted(rows, np.arange(0, len(rows), HEIGHT)) + 255].reshape(-1, 8)
    packed = np.empty((len(words), 9), np.uint8)
    packed[:, 0] = words[:, 0] >> 1
    for k in range(1, 8):
        packed[:, k] = (words[:, k - 1] << (8 - k) | words[:, k] >> (k + 1)) & 255
    packed[:, 8] = words[:, 7] & 255
    data, step, out = packed.tobytes(), WIDTH * _FIXED // 8, []
    for top in range(0, len(rows), HEIGHT):
        high = min(HEIGHT, len(rows) - top)
        head = b"\xff\xd8" + _TABLE + _segment(0xC3, struct.pack(">BHHBBBB", 8, high, WIDTH, 1, 1, 0x11, 0)) + _SCAN
        out.append(head + data[top * step : (top + high) * step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def _segments(frame: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, body, place after it) of the segments before and at the scan's head."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = frame[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        n = int.from_bytes(frame[at + 2 : at + 4], "big")
        if n < 2 or at + 2 + n > len(frame):
            raise ValueError("a segment is cut off")
        at += 2 + n
        yield marker, frame[at - n + 2 : at], at
        if marker == 0xDA:
            return
    raise ValueError("the frame is incomplete")


def _process(frame: bytes) -> int:
    """The start-of-frame marker, which names the coding process."""
    for marker, _, _ in _segments(frame):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return marker
    raise ValueError("the frame has no size")


def _parse_frame(frame: bytes) -> tuple[int, int, list[int], list[int], bytes]:
    """(height, width, code counts, symbols, entropy-coded bytes) of a lossless grey frame."""
    size = table = None
    for marker, body, at in _segments(frame):
        if marker == 0xC4:
            counts = list(body[1:17])
            table = counts, list(body[17 : 17 + sum(counts)])
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            if len(body) < 6:
                raise ValueError("a segment is cut off")
            precision, high, wide, parts = struct.unpack(">BHHB", body[:6])
            if marker != 0xC3 or precision != 8 or parts != 1:
                raise ValueError("of lossless frames only 8-bit grey ones are decoded")
            size = high, wide
        elif marker == 0xDA:
            if len(body) < 3 or body[-3] != 1:
                raise ValueError("only the left predictor is decoded")
            end = frame.rfind(b"\xff\xd9")
            if size is None or table is None or end < at:
                raise ValueError("the frame is incomplete")
            return *size, *table, frame[at:end].replace(b"\xff\x00", b"\xff")
    raise ValueError("the frame is incomplete")


class _Bits:
    """Reads codes and extra bits of one restart interval; past the end come zeros, then an error."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            if self.at > len(self.data) + 8:
                raise ValueError("the frame is incomplete")
            self.held = (self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & 0xFFFFFFFF
            self.at, self.n = self.at + 1, self.n + 8

    def symbol(self, table: list[int]) -> int:
        self.need(16)
        found = table[self.held >> (self.n - 16) & 0xFFFF]
        if not found:
            raise ValueError("a code is unknown")
        self.n -= found >> 8
        return found & 0xFF

    def signed(self, size: int) -> int:
        if not size:
            return 0
        self.need(size)
        self.n -= size
        extra = self.held >> self.n & ((1 << size) - 1)
        return extra if extra >> (size - 1) else extra - (1 << size) + 1


def _lookup(counts: list[int], symbols: list[int]) -> list[int]:
    """length * 256 + symbol for every 16 bits that may come; 0 where no code fits."""
    if len(symbols) < sum(counts):
        raise ValueError("a segment is cut off")
    out = [0] * (1 << 16)
    for (n, code), s in _codes(counts, symbols).items():
        if code >> n:
            raise ValueError("a code table is overfull")
        out[code << (16 - n) : (code + 1) << (16 - n)] = [n << 8 | s] * (1 << (16 - n))
    return out


def _zigzag() -> list[int]:
    """Places of the 64 coefficients in the order in which they are coded."""
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    return order


_ZIGZAG = _zigzag()
_COSINE = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def decode_baseline(frame: bytes) -> np.ndarray:
    """The luminance of a baseline frame of one or three components, by Huffman codes and inverse cosine transform."""
    quant: dict[int, list[int]] = {}
    tables: dict[int, list[int]] = {}
    restart, parts, size = 0, [], (0, 0)
    for marker, body, at in _segments(frame):
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = body[k + 1 : k + 65 + 64 * wide]
                if len(values) < 64 << wide:
                    raise ValueError("a segment is cut off")
                quant[body[k] & 15] = list(struct.unpack(">64H", values)) if wide else list(values)
                k += 65 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k + 17 <= len(body):
                counts = list(body[k + 1 : k + 17])
                tables[body[k]] = _lookup(counts, list(body[k + 17 : k + 17 + sum(counts)]))
                k += 17 + sum(counts)
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise ValueError("only 8-bit frames are decoded")
            size = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xDA:
            coded = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])} if body and len(body) >= 1 + 2 * body[0] else {}
            start = at
    high, wide = size
    if not parts or not high or not wide or any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in parts) or {p[0] for p in parts} != set(coded):
        raise ValueError("only frames of one scan with all components are decoded")
    if len(parts) == 1:  # blocks of a single component stand row by row whatever its factors
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    try:
        dc = {c: tables[coded[c] >> 4] for c, *_ in parts}
        ac = {c: tables[16 | coded[c] & 15] for c, *_ in parts}
        scale = np.zeros(64)
        scale[_ZIGZAG] = quant[parts[0][3]]
    except KeyError:
        raise ValueError("the frame lacks a table") from None
    end = frame.rfind(b"\xff\xd9")
    runs = re.split(rb"\xff[\xd0-\xd7]", frame[start : end if end >= start else len(frame)])
    first, h0, v0 = parts[0][:3]
    luma = np.zeros((down * v0, across * h0, 64))
    units, step = across * down, restart or across * down
    for k, run in enumerate(runs):
        bits, before = _Bits(run.replace(b"\xff\x00", b"\xff")), dict.fromkeys(dc, 0)
        for unit in range(k * step, min(units, (k + 1) * step)):
            for c, h, v, _ in parts:
                for b in range(h * v):
                    before[c] += bits.signed(bits.symbol(dc[c]))
                    found, i = [(0, before[c])], 1
                    while i < 64:
                        s = bits.symbol(ac[c])
                        if not s & 15 and s != 0xF0:
                            break
                        i += s >> 4
                        if s & 15:
                            value = bits.signed(s & 15)
                            if i > 63:
                                raise ValueError("a block has too many coefficients")
                            found.append((_ZIGZAG[i], value))
                        i += 1
                    if c == first:
                        block = luma[unit // across * v0 + b // h, unit % across * h0 + b % h]
                        for place, value in found:
                            block[place] = value
    if units > len(runs) * step:
        raise ValueError("the frame is incomplete")
    samples = _COSINE.T @ (luma * scale).reshape(-1, 8, 8) @ _COSINE + 128
    image = samples.reshape(down * v0, across * h0, 8, 8).swapaxes(1, 2).reshape(down * v0 * 8, across * h0 * 8)
    high, wide = -(-high * v0 // most_v), -(-wide * h0 // most_h)
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)[:high, :wide]


def _differences(data: bytes, samples: int, counts: list[int], symbols: list[int]) -> np.ndarray:
    if counts == _COUNTS and symbols == _SYMBOLS and samples % 8 == 0:
        if len(data) < samples * _FIXED // 8:
            raise ValueError("the frame is incomplete")
        packed = np.frombuffer(data, np.uint8, samples * _FIXED // 8).reshape(-1, 9).astype(np.uint16)
        words = np.empty((len(packed), 8), np.uint16)
        for k in range(8):
            words[:, k] = (packed[:, k] << (k + 1) | packed[:, k + 1] >> (7 - k)) & 511
        return _BACK[words].reshape(-1)
    codes, bits, out = _codes(counts, symbols), np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), []
    at = 0
    for _ in range(samples):
        n = code = 0
        while (n, code) not in codes or not n:
            if at >= len(bits) or n > 16:
                raise ValueError("the frame is incomplete")
            code, n, at = code << 1 | bits[at], n + 1, at + 1
        s = codes[n, code]
        extra = int("".join(map(str, bits[at : at + s])) or "0", 2)
        at += s
        out.append(extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1)
    return np.array(out, np.int16)


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The sample arrays of frames; runs of lossless frames with one table are decoded together.

    Raises ``ValueError`` for broken frames and other processes than the lossless and the baseline one.
    """
    out: list[np.ndarray] = []
    try:
        parsed = [_parse_frame(f) for f in frames]
    except ValueError:
        dct = [_process(f) in (0xC0, 0xC1) for f in frames]
        if not any(dct):
            raise
        return [decode_baseline(f) if yes else decode_frames([f])[0] for f, yes in zip(frames, dct)]
    at = 0
    while at < len(parsed):
        _, wide, counts, symbols, _ = parsed[at]
        to = at + 1
        fixed = counts == _COUNTS and wide % 8 == 0
        while fixed and to < len(parsed) and parsed[to][1:4] == parsed[at][1:4]:
            to += 1
        run = parsed[at:to]
        heights = np.array([p[0] for p in run])
        data = b"".join(p[4][: p[0] * wide * _FIXED // 8] if fixed else p[4] for p in run)
        diff = _differences(data, int(heights.sum()) * wide, counts, symbols).reshape(-1, wide).astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(heights)])
        for a, b in zip(starts[:-1], starts[1:]):
            diff[a:b, 0] = np.cumsum(diff[a:b, 0]) + 128
        rows = np.cumsum(diff, axis=1).astype(np.uint8)  # modulo 256
        out += [rows[a:b] for a, b in zip(starts[:-1], starts[1:])]
        at = to
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    """An AVI file with one motion-JPEG stream and an idx1 index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    at, movi, index = 4, [b"movi"], []
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > end:
            raise ValueError("a chunk is cut off")
        yield name, at + 8, n
        at += 8 + n + (n & 1)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """(frames of the first video stream, frames a second): by the index, or else by the chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, fps = None, None, float(FPS)
    for name, at, n in _chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for sub, s, _ in _chunks(data, at + 4, at + n):
                if sub == b"avih":
                    fps = 1_000_000 / max(1, int.from_bytes(data[s : s + 4], "little"))
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = at, n
        elif name == b"idx1":
            index = data[at : at + n]
    if movi is None:
        raise ValueError("the file has no frames list")
    at, n = movi
    if index is not None:
        out = []
        if len(index) % 16:
            raise ValueError("the index is cut off")
        for name, _, offset, size in struct.iter_unpack("<4sIII", index):
            if name[2:] in (b"dc", b"db"):
                start = at + offset + 8
                if data[start - 8 : start - 4] != name:
                    raise ValueError("the index does not fit the frames")
                out.append(data[start : start + size])
        return out, fps
    return [data[s : s + k] for name, s, k in _chunks(data, at + 4, at + n) if name[2:] in (b"dc", b"db")], fps


def cuts(frames: list[np.ndarray]) -> list[int]:
    """First frames of the shots after the first: where the difference of neighbouring
    histograms exceeds both the least one and its running mean within the shot by the factor."""
    if len(frames) < 2:
        return []
    sizes = np.array([f.size for f in frames])
    flat = np.concatenate([f.reshape(-1) for f in frames])
    cell = (flat >> 4).astype(np.int64) + BINS * np.repeat(np.arange(len(frames)), sizes)
    hist = np.bincount(cell, minlength=BINS * len(frames)).reshape(-1, BINS) / sizes[:, None]
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1).tolist()
    out, total, n = [], 0.0, 0
    for k, d in enumerate(diff, 1):
        if d > CUT_LEAST and n and d > CUT_FACTOR * total / n:
            out.append(k)
            total, n = 0.0, 0
        else:
            total, n = total + d, n + 1
    return out


def clips(media: bytes | None) -> list[tuple[int, float, float, int]]:
    """``(clip, start second, end second, frames)`` of each shot of an AVI file; null: none."""
    if media is None:
        return []
    frames, fps = read_avi(media)
    bounds = [0, *cuts(decode_frames(frames)), len(frames)] if frames else [0]
    return [(i, a / fps, b / fps, b - a) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(UTF-8 bytes of the text, these bytes with zeros up to a positive multiple of 64)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (-len(data) % WIDTH or WIDTH * (not data))


def store(text: str | None) -> bytes:
    return write_avi(encode_frames(payload_of(text)[1]))


def _digest(text: str | None) -> tuple:
    n_bytes, _ = payload_of(text)
    media = store(text)
    frames, fps = read_avi(media)
    images = decode_frames(frames)
    payload = b"".join(x.tobytes() for x in images)
    found = cuts(images)
    feature = f"frames={len(frames)};fps={fps:g};shots={len(found) + 1};cuts={'|'.join(map(str, found))}"
    return (
        n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
        len(media), hashlib.sha256(media).hexdigest(), feature,
    )


def store_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, media)``: each text's payload as an AVI file. Null and empty texts store 64 zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                media = pa.array([store(x.as_py()) for x in batch.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), media], names=["doc_id", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, media binary")


def clips_or_error(media: bytes | None) -> list[tuple]:
    """``clips`` with a null error each; broken media give one row that has only the error."""
    try:
        return [(*c, None) for c in clips(media)]
    except ValueError as e:
        return [(None, None, None, None, str(e))]


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``(doc_id, clip, start_s, end_s, frames, error)``: one row per shot of each AVI file; null media have none.

    Files that cannot be read give no clips but one row whose ``error`` says why; a file without frames gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i.as_py(), *c) for i, m in zip(*batch.columns) for c in clips_or_error(m.as_py())]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols, kinds)), names=["doc_id", "clip", "start_s", "end_s", "frames", "error"])

    rows = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, "doc_id long, clip long, start_s double, end_s double, frames long, error string")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back and returns
    ``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)``.

    Null and empty texts store 64 zeros. Null ids and repeated rows pass through; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            cols = list(zip(*[_digest(x.as_py()) for x in batch.column(1)])) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )


def op8_media(spark, sf_dir: str) -> DataFrame:
    return digest_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
