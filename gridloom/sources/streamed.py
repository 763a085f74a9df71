"""Whole images larger than any task: bands of rows are encoded where they lie and written one after the other.

Bands meet in a ``groupBy`` on their number; the writer holds one encoded
band at a time. A PNG's bands are parts of one deflate stream that end on
byte borders; an EXR file's are its blocks of 16 scan lines.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import HEIGHT, Raster
from ..plans.staging import staged
from .images import PNG_SIGNATURE, exr_blocks, exr_head, png_chunk, png_lines

BAND = 64  # rows; whole blocks of an EXR file
ADLER = 65521


def joined_adler(first: int, second: int, length: int) -> int:
    """The Adler-32 of two texts in a row by theirs and the second one's length."""
    a = (first & 0xFFFF) + (second & 0xFFFF) - 1
    b = (first >> 16) + (second >> 16) + length * ((first & 0xFFFF) - 1)
    return (b % ADLER) << 16 | a % ADLER


class _Out:
    """A file of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        self.stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()

    def write(self, data: bytes) -> None:
        for a in range(0, len(data), 1 << 22):
            self.stream.write(bytearray(data[a : a + (1 << 22)]))


def _bands(r: Raster, encode) -> DataFrame:
    """(band, parts, adler, length) of every band; ``encode`` gives the last three from rows x columns x channels."""
    a, b, c, d = r.spec.bounds
    columns, width = list(r.columns), c - a

    def run(key, table):
        band = key[0].as_py()
        rows = min(BAND, d - b - band * BAND)
        px = np.zeros((rows, width, len(columns)))
        j, i = table["j"].to_numpy() - b - band * BAND, table["i"].to_numpy() - a
        for k, name in enumerate(columns):
            px[j, i, k] = table[name].to_numpy()
        parts, adler, length = encode(px, band, band * BAND + rows == d - b)
        return pa.table({"band": pa.array([band], pa.int32()), "parts": pa.array([parts], pa.list_(pa.binary())), "adler": pa.array([adler], pa.int64()), "length": pa.array([length], pa.int64())})

    cells = r.df.select(F.floor((F.col("j") - b) / BAND).cast("int").alias("band"), "j", "i", *(F.col(n).cast("double").alias(n) for n in columns))
    return staged(cells.groupBy("band").applyInArrow(run, "band int, parts array<binary>, adler long, length long"), "bands")


def write_png(r: Raster, path: str, bits: int = 16) -> None:
    """One PNG file of the whole grid: masks and colours as 0..1, heights over the world's range."""
    m = r.to("mask") if r.kind == HEIGHT else r
    a, b, c, d = m.spec.bounds

    def encode(px: np.ndarray, band: int, last: bool):
        lines = png_lines(px, bits)
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        return [packer.compress(lines) + packer.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)], zlib.adler32(lines), len(lines)

    bands, total = _bands(m, encode), 1
    head = struct.pack(">IIBBBBB", c - a, d - b, bits, {1: 0, 3: 2, 4: 6}[len(m.columns)], 0, 0, 0)
    with _Out(r.spark, path) as out:
        out.write(PNG_SIGNATURE + png_chunk(b"IHDR", head) + png_chunk(b"IDAT", b"\x78\x9c"))
        for band in bands.orderBy("band").toLocalIterator():
            total = joined_adler(total, band.adler, band.length)
            out.write(png_chunk(b"IDAT", bytes(band.parts[0])))
        out.write(png_chunk(b"IDAT", struct.pack(">I", total)) + png_chunk(b"IEND", b""))


def write_exr(r: Raster, path: str) -> None:
    """One EXR file of 32-bit floats of the whole grid, in its own units."""
    names = ["Y"] if len(r.columns) == 1 else list("RGBA")[: len(r.columns)]
    a, b, c, d = r.spec.bounds

    def encode(px: np.ndarray, band: int, last: bool):
        parts = exr_blocks({n: px[:, :, k] for k, n in enumerate(names)}, band * BAND)
        return parts, 0, sum(map(len, parts))

    bands = _bands(r, encode)
    sizes = [n for row in bands.orderBy("band").select(F.transform("parts", lambda x: F.length(x)).alias("n")).toLocalIterator() for n in row.n]
    head = exr_head(names, c - a, d - b)
    starts = len(head) + 8 * len(sizes) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    with _Out(r.spark, path) as out:
        out.write(head + struct.pack(f"<{len(sizes)}Q", *starts.astype(int).tolist()))
        for band in bands.orderBy("band").toLocalIterator():
            for part in band.parts:
                out.write(bytes(part))
