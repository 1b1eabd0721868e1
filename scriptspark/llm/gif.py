"""GIF columns: encode bytes as palette indices, decode code streams to timed frames with histograms.

The decoder is array work: a code's string is one symbol longer than the string it refers to, and its
symbols are copies of earlier output, so lengths and copies are both resolved by pointer doubling
over the codes between two clear codes. Frames are then placed on the canvas under their palette,
transparency and disposal rules. Damaged media give a row with an error instead of a failed job.

Null text counts as empty: one row of 192 spaces. Equal texts give equal media and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW, ROWS_PER_FRAME, DELAY_CS = 192, 128, 4
CODES_AT_MOST = 4096
HISTOGRAM_BINS = 8


# Encoding ------------------------------------------------------------------


@cache
def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the i-th code after a clear code, and its bit offset. Beyond the table all are 12 bits wide."""
    free = (1 << bits) + 2 + np.maximum(np.arange(CODES_AT_MOST) - 1, 0)
    width = np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(free)).astype(np.int64) + 1))
    return width, np.concatenate([[0], np.cumsum(width)])


def compress(pixels: bytes, bits: int = 8) -> bytes:
    """A GIF code stream: greedy matches, the table cleared when it is full."""
    clear = 1 << bits
    codes = [clear]
    table: dict[int, int] = {}
    found, free = table.get, clear + 2
    add = codes.append
    word = pixels[0] if pixels else -1
    starts = [1]
    for symbol in pixels[1:]:
        pair = word << 8 | symbol
        code = found(pair)
        if code is not None:
            word = code
            continue
        add(word)
        word = symbol
        if free < CODES_AT_MOST:
            table[pair] = free
            free += 1
        else:
            add(clear)
            starts.append(len(codes))
            table = {}
            found, free = table.get, clear + 2
    if word >= 0:
        add(word)
    add(clear + 1)
    stream = np.array(codes, np.int64)
    begin = np.zeros(len(codes), np.int64)
    begin[starts] = np.diff([0, *starts])
    since = np.arange(len(codes)) - np.cumsum(begin)  # codes since the last clear code
    width = _schedule(bits)[0][np.minimum(since, CODES_AT_MOST - 1)]
    at = np.cumsum(width) - width
    shifted, byte = stream << (at & 7), at >> 3
    size = int(at[-1] + width[-1] + 7) >> 3
    out = sum(np.bincount(byte + k, (shifted >> 8 * k) & 255, size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes, note: str = "") -> bytes:
    """A grey 192-pixel-wide animation whose palette indices, frame by frame, are the payload."""
    if len(payload) % ROW or not payload:
        raise ValueError(f"a payload is a positive multiple of {ROW} bytes")
    rows = len(payload) // ROW
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, ROWS_PER_FRAME), 0xF7, 0, 0), np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()]
    if note:
        out += [b"\x21\xfe", _blocks(note.encode())]
    for top in range(0, rows, ROWS_PER_FRAME):
        part = payload[top * ROW : (top + ROWS_PER_FRAME) * ROW]
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, ROW, len(part) // ROW, 0), b"\x08", _blocks(compress(part))]
    return b"".join([*out, b"\x3b"])


# Decoding ------------------------------------------------------------------


def decompress(stream: bytes, bits: int, n_pixels: int) -> np.ndarray:
    """The symbols of a code stream, at most n_pixels of them."""
    clear = 1 << bits
    width, offset = _schedule(bits)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int32)
    end, at, out, got, codes, ended = 8 * len(stream), 0, [], 0, [], False
    while not ended:
        met = sum(map(len, codes))
        if met < CODES_AT_MOST:
            w, p = width[met:], at + offset[met:-1] - offset[met]
        else:
            w = np.full(CODES_AT_MOST, 12)
            p = at + 12 * np.arange(CODES_AT_MOST)
        fits = p + w <= end
        w, p = w[fits], p[fits]
        byte = p >> 3
        v = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (p & 7)) & ((1 << w) - 1)
        stops = np.flatnonzero((v == clear) | (v == clear + 1))
        n = int(stops[0]) if len(stops) else len(v)
        codes.append(v[:n])
        if len(stops):
            at = int(p[n] + w[n])
            ended = v[n] == clear + 1
        else:
            ended = len(v) < CODES_AT_MOST - (met if met < CODES_AT_MOST else 0)
            at = int(p[-1] + w[-1]) if len(p) else at
        if len(stops) or ended:
            out.append(_strings(np.concatenate(codes), clear))
            got += len(out[-1])
            codes = []
            ended = ended or got >= n_pixels
    return np.concatenate(out)[:n_pixels] if out else np.zeros(0, np.uint8)


def _strings(codes: np.ndarray, clear: int) -> np.ndarray:
    """What the codes between two clear codes stand for."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    refers = codes > clear
    parent = np.where(refers, codes - clear - 2, np.arange(n))
    if (parent[refers] >= np.flatnonzero(refers)).any():
        raise ValueError("a code before its string")
    length = _depths(parent, refers) + 1
    start = np.cumsum(length) - length
    total = int(start[-1] + length[-1])
    source = (np.arange(total) - np.repeat(start - start[parent], length)).astype(np.int32)
    for _ in range(int(2 * length.max()).bit_length()):  # a symbol is at most two longest strings of copies away
        source = source[source]
    symbols = np.zeros(total, np.uint8)
    symbols[start[~refers]] = codes[~refers]
    return symbols[source]


def _depths(parent: np.ndarray, refers: np.ndarray) -> np.ndarray:
    depth, up = refers.astype(np.int64), parent
    while True:
        step = depth[up]
        if not step.any():
            return depth
        depth, up = depth + step, up[up]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int
    palette: np.ndarray = field(repr=False)
    indices: np.ndarray = field(repr=False)


@dataclass
class Media:
    width: int
    height: int
    background: int
    palette: np.ndarray = field(repr=False)
    frames: list[Frame]
    note: str


def _colours(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    if not flags & 0x80:
        return np.zeros((0, 3), np.uint8), at
    n = 3 << (flags & 7) + 1
    if at + n > len(data):
        raise ValueError("a palette is cut off")
    return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _rows_in_order(height: int) -> np.ndarray:
    """For an interlaced frame: the row that each stored row belongs to."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def parse(data: bytes) -> Media:
    """Reads a GIF87a or GIF89a file. ValueError or IndexError: it is damaged."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    palette, at = _colours(data, 13, flags)
    media = Media(width, height, background, palette, [], "")
    delay, disposal, transparent = 0, 0, -1
    while (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            body, at = _unblock(data, at + 1)
            if label == 0xF9:
                bits, cs, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = 10 * cs, bits >> 2 & 7, index if bits & 1 else -1
            elif label == 0xFE:
                media.note += body.decode("utf-8", "replace")
        elif kind == 0x2C:
            left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at)
            own, at = _colours(data, at + 9, bits)
            least = data[at]
            if not 1 <= least <= 8:
                raise ValueError("a code size out of range")
            stream, at = _unblock(data, at + 1)
            pixels = decompress(stream, least, w * h)
            if len(pixels) < w * h:
                raise ValueError("a frame is cut off")
            pixels = pixels.reshape(h, w)
            if bits & 0x40:
                pixels = pixels[np.argsort(_rows_in_order(h))]
            media.frames.append(Frame(left, top, w, h, delay, disposal, transparent, own if len(own) else palette, pixels))
            delay, disposal, transparent = 0, 0, -1
        else:
            raise ValueError("an unknown block")
    return media


def rendered(media: Media) -> Iterator[np.ndarray]:
    """The RGBA canvas as each frame shows it: transparent pixels let the canvas through, then the frame is disposed of."""
    canvas = np.zeros((media.height, media.width, 4), np.uint8)
    for f in media.frames:
        area = (slice(f.top, min(f.top + f.height, media.height)), slice(f.left, min(f.left + f.width, media.width)))
        before = canvas.copy() if f.disposal == 3 else None
        part = f.indices[: max(0, area[0].stop - f.top), : max(0, area[1].stop - f.left)]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3], colours[:, 3] = f.palette, 255
        if f.transparent < 0:
            canvas[area] = colours[part]
        else:
            shown = part != f.transparent
            canvas[area][shown] = colours[part][shown]
        yield canvas
        if f.disposal == 2:
            canvas[area] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of visible pixels in 8 bins for each of red, green and blue."""
    seen = canvas.reshape(-1, 4)
    if not (full := seen[:, 3] == 255).all():
        seen = seen[full]
    return np.stack([np.bincount(seen[:, c] >> 5, minlength=HISTOGRAM_BINS) for c in range(3)])


# Tables --------------------------------------------------------------------


def encode_column(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, media): the text's UTF-8 bytes, filled up with spaces, as a GIF; its own length goes into the comment."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                small, out = batch.slice(at, 512), []
                for x in small.column(1):
                    raw = (x.as_py() or "").encode()
                    out.append(encode(raw + b" " * (-len(raw) % ROW or ROW * (not raw)), f"n_bytes={len(raw)}"))
                yield pa.RecordBatch.from_arrays([small.column(0), pa.array(out, pa.binary())], ["key", "media"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, media binary").withColumnRenamed("key", key)


def decode_frames(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per frame, or one with an error for damaged or null media."""
    kind = df.schema[key].dataType.simpleString()
    numbers = ["frame", "start_ms", "delay_ms", "disposal", "transparent", "left", "top", "width", "height"]
    schema = pa.schema([*((n, pa.int64()) for n in numbers), *((f"hist_{c}", pa.list_(pa.int64())) for c in "rgb"), ("indices", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                small, row, rows = batch.slice(at, 64), [], []
                for i, x in enumerate(small.column(1)):
                    try:
                        m, start = parse(x.as_py() or b""), 0
                        found = []
                        for k, (f, canvas) in enumerate(zip(m.frames, rendered(m), strict=True)):
                            found.append((k, start, f.delay_ms, f.disposal, f.transparent, f.left, f.top, f.width, f.height, *histogram(canvas).tolist(), f.indices.tobytes(), None))
                            start += f.delay_ms
                    except (ValueError, IndexError, struct.error) as wrong:
                        found = [(*[None] * 13, str(wrong))]
                    row += [i] * len(found)
                    rows += found
                columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([small.column(0).take(pa.array(row, pa.int64())), *(pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True))], ["key", *schema.names])

    ddl = ", ".join([f"key {kind}", *(f"{n} long" for n in numbers), *(f"hist_{c} array<long>" for c in "rgb"), "indices binary", "error string"])
    return df.select(F.col(key), F.col(media)).mapInArrow(run, ddl).withColumnRenamed("key", key)


def digest_media(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per media: what its frames hold, put together in order, and a feature of what they show."""
    kind = df.schema[key].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                raw = x.as_py()
                m = parse(raw)
                shown = sum((histogram(canvas) for canvas in rendered(m)), np.zeros((3, HISTOGRAM_BINS), np.int64))
                payload = b"".join(f.indices.tobytes() for f in m.frames)
                feature = f"{m.width}x{m.height}x{len(m.frames)}@{sum(f.delay_ms for f in m.frames)}ms:" + ";".join(",".join(map(str, c)) for c in shown.tolist())
                rows.append((int(m.note.removeprefix("n_bytes=")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["key", *names])

    ddl = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(key), F.col(media)).mapInArrow(run, ddl).withColumnRenamed("key", key)


def op1_gif_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest_media(encode_column(docs, "doc_id", "text"), "doc_id", "media")
