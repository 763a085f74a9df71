"""Image files as rasters and back: PNG of 8 and 16 bits, OpenEXR of 32-bit floats.

Files are read with Spark's ``binaryFile`` source and decoded where they
lie, one task a file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.world import ImageError

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_EXR = struct.pack("<I", 20000630)
PNG_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """Rows x columns x channels in 0..1."""
    if raw[:8] != PNG_SIGNATURE:
        raise ImageError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if colour not in PNG_CHANNELS or depth not in (8, 16) or interlaced:
        raise ImageError("only plain PNG files of 8 or 16 bits are read")
    step = PNG_CHANNELS[colour] * depth // 8
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int32)
    for j in range(height):
        line, how = rows[j, 1:].astype(np.int32), rows[j, 0]
        if how == 2:
            line = (line + above) & 255
        elif how == 1:
            line = (line.reshape(width, step).cumsum(0) & 255).ravel()
        elif how in (3, 4):
            for k in range(len(line)):
                left, up, corner = (line[k - step] if k >= step else 0), above[k], (above[k - step] if k >= step else 0)
                if how == 3:
                    line[k] = (line[k] + (left + up) // 2) & 255
                else:
                    p = left + up - corner
                    near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))
                    line[k] = (line[k] + near[2]) & 255
        out[j] = above = line
    values = out.view(">u2").astype(np.float64) / 65535 if depth == 16 else out.astype(np.float64) / 255
    return values.reshape(height, width, PNG_CHANNELS[colour])


def png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_lines(values: np.ndarray, bits: int) -> bytes:
    """Unfiltered rows of 0..1 as floor(v * most + 0.5)."""
    most = (1 << bits) - 1
    whole = np.floor(np.clip(values, 0, 1) * most + 0.5).astype(">u2" if bits == 16 else np.uint8)
    return np.concatenate([np.zeros((len(whole), 1), np.uint8), whole.reshape(len(whole), -1).view(np.uint8)], 1).tobytes()


def encode_png(values: np.ndarray, bits: int = 16) -> bytes:
    """0..1, grey or RGBA."""
    if values.ndim == 2:
        values = values[:, :, None]
    height, width, channels = values.shape
    head = struct.pack(">IIBBBBB", width, height, bits, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return PNG_SIGNATURE + png_chunk(b"IHDR", head) + png_chunk(b"IDAT", zlib.compress(png_lines(values, bits), 6)) + png_chunk(b"IEND", b"")


def exr_head(names: list[str], width: int, height: int) -> bytes:
    """Everything before the offsets of the blocks."""
    box = struct.pack("<4i", 0, 0, width - 1, height - 1)
    listed = b"".join(n.encode() + b"\0" + struct.pack("<iB3xii", 2, 0, 1, 1) for n in sorted(names)) + b"\0"
    fields = [("channels", "chlist", listed), ("compression", "compression", b"\x03"), ("dataWindow", "box2i", box), ("displayWindow", "box2i", box), ("lineOrder", "lineOrder", b"\0"), ("pixelAspectRatio", "float", struct.pack("<f", 1)), ("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)), ("screenWindowWidth", "float", struct.pack("<f", 1))]
    return _EXR + struct.pack("<I", 2) + b"".join(n.encode() + b"\0" + t.encode() + b"\0" + struct.pack("<i", len(v)) + v for n, t, v in fields) + b"\0"


def exr_blocks(channels: dict[str, np.ndarray], first: int = 0) -> list[bytes]:
    """Blocks of 16 scan lines, compressed, of rows that begin at ``first``."""
    names = sorted(channels)
    height, blocks = len(channels[names[0]]), []
    for a in range(0, height, 16):
        raw = np.concatenate([np.ascontiguousarray(channels[n][j], "<f4").view(np.uint8) for j in range(a, min(a + 16, height)) for n in names])
        halves = np.concatenate([raw[0::2], raw[1::2]]).astype(np.int16)
        delta = np.concatenate([halves[:1], (halves[1:] - halves[:-1] + 384) & 255]).astype(np.uint8)
        packed = zlib.compress(delta.tobytes())
        packed = packed if len(packed) < len(raw) else raw.tobytes()
        blocks.append(struct.pack("<ii", first + a, len(packed)) + packed)
    return blocks


def encode_exr(channels: dict[str, np.ndarray]) -> bytes:
    """Scan lines of 32-bit floats in blocks of 16, compressed."""
    height, width = next(iter(channels.values())).shape
    head, blocks = exr_head(list(channels), width, height), exr_blocks(channels)
    starts = np.cumsum([len(head) + 8 * len(blocks), *(len(b) for b in blocks[:-1])])
    return head + struct.pack(f"<{len(blocks)}Q", *starts.tolist()) + b"".join(blocks)


def decode_exr(raw: bytes) -> dict[str, np.ndarray]:
    """Channels of a file of scan lines of 32-bit floats, uncompressed or zipped."""
    if raw[:4] != _EXR:
        raise ImageError("not an EXR file")
    at, fields = 8, {}
    word = lambda p: (raw[p : raw.index(b"\0", p)].decode(), raw.index(b"\0", p) + 1)
    while raw[at]:
        name, at = word(at)
        _, at = word(at)
        size = struct.unpack_from("<i", raw, at)[0]
        fields[name], at = raw[at + 4 : at + 4 + size], at + 4 + size
    at += 1
    names, p = [], 0
    while fields["channels"][p]:
        end = fields["channels"].index(b"\0", p)
        if struct.unpack_from("<i", fields["channels"], end + 1)[0] != 2:
            raise ImageError("only 32-bit floats are read")
        names.append(fields["channels"][p:end].decode())
        p = end + 17
    how = fields["compression"][0]
    if how not in (0, 2, 3):
        raise ImageError("only plain and zipped scan lines are read")
    x0, y0, x1, y1 = struct.unpack("<4i", fields["dataWindow"])
    width, height, lines = x1 - x0 + 1, y1 - y0 + 1, 16 if how == 3 else 1
    out = {n: np.zeros((height, width), np.float32) for n in names}
    for start in struct.unpack_from(f"<{-(-height // lines)}Q", raw, at):
        y, size = struct.unpack_from("<ii", raw, start)
        body, rows = raw[start + 8 : start + 8 + size], min(lines, height - (y - y0))
        full = rows * width * 4 * len(names)
        if how and size < full:
            d = np.frombuffer(zlib.decompress(body), np.uint8).astype(np.int64)
            d[1:] -= 128
            d = (np.cumsum(d) & 255).astype(np.uint8)
            half = (len(d) + 1) // 2
            body = np.empty(len(d), np.uint8)
            body[0::2], body[1::2] = d[:half], d[half:]
        px = np.frombuffer(bytes(body), "<f4").reshape(rows, len(names), width)
        for k, n in enumerate(names):
            out[n][y - y0 : y - y0 + rows] = px[:, k]
    return out


def decode(raw: bytes) -> tuple[np.ndarray, bool]:
    """(rows x columns x channels, whether values are metres) of a PNG or EXR file; JPEG where Pillow is installed."""
    if raw[:8] == PNG_SIGNATURE:
        return decode_png(raw), False
    if raw[:4] == _EXR:
        ch = decode_exr(raw)
        if {"R", "G", "B"} & set(ch):
            some = next(iter(ch.values()))
            return np.stack([ch.get(n, np.full_like(some, n == "A")) for n in "RGBA"], 2).astype(np.float64), True
        return ch.get("Y", next(iter(ch.values())))[:, :, None].astype(np.float64), True
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise ImageError("this image format needs Pillow") from e
    return np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"), np.float64) / 255, False


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, j, i, metres, r, g, b, a) of every pixel; grey images repeat their value, a missing alpha is 1."""
    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                px, metres = decode(raw)
                if min(px.shape[:2]) < 2:
                    raise ImageError("an image has at least 2 x 2 pixels")
                if px.shape[2] < 3:
                    alpha = px[:, :, 1:2] if px.shape[2] == 2 else np.ones_like(px[:, :, :1])
                    px = np.concatenate([px[:, :, :1]] * 3 + [alpha], 2)
                elif px.shape[2] == 3:
                    px = np.concatenate([px, np.ones_like(px[:, :, :1])], 2)
                j, i = np.divmod(np.arange(px.shape[0] * px.shape[1]), px.shape[1])
                yield pa.record_batch([pa.array([name] * len(j)), pa.array(j.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array([metres] * len(j)), *(pa.array(px[:, :, k].ravel()) for k in range(4))], ["path", "j", "i", "metres", "r", "g", "b", "a"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, j int, i int, metres boolean, r double, g double, b double, a double")


def image_files(cells: DataFrame, keys: list[str], channels: list[str], width: int, height: int, kind: str = "png16") -> DataFrame:
    """(keys..., content): one encoded file per group of cells, e.g. per tile; ``width`` and ``height`` in cells."""
    def run(key, table):
        j, i = table["j"].to_numpy(), table["i"].to_numpy()
        px = np.zeros((height, width, len(channels)))
        for k, c in enumerate(channels):
            px[j - j.min(), i - i.min(), k] = table[c].to_numpy()
        if kind == "exr32":
            names = ["Y"] if len(channels) == 1 else list("RGBA")[: len(channels)]
            raw = encode_exr({n: px[:, :, k] for k, n in enumerate(names)})
        else:
            raw = encode_png(px, 16 if kind == "png16" else 8)
        return pa.table([*(pa.array([v.as_py()], v.type) for v in key), pa.array([raw], pa.binary())], [*keys, "content"])

    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    wanted = cells.select(*keys, "j", "i", *(F.col(c).cast("double").alias(c) for c in channels))
    return wanted.groupBy(*keys).applyInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", content binary")
