"""Media columns: texts' bytes as 8-bit audio, and features of audio.

``encode`` stores each payload as a WAV file in a binary column. ``features``
reads the stored bytes back, halves the rate with a polyphase filter, takes
overlapped log-mel frames and marks energetic spans with two thresholds
(hysteresis). Frames come in blocks of one fixed shape with time spans. They
are stored as fixed-shape Arrow tensors: Spark's types have none, so a file's
tensors are a binary column that holds an Arrow stream, which any Arrow
reader opens without a copy (``read_tensors``).

Rows are independent: no shuffle, memory bounded by an Arrow batch and the
longest text. Defined results: a null text counts as empty and becomes one
block of padding; equal texts have equal values; repeated rows keep a result
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import small_batches

RATE = 8000
UNIT = 576
PAD = 255
FRAME, HOP, MELS = 256, 128, 16
BLOCK = 16  # frames of a tensor: shape (BLOCK, MELS)
CHUNK_FRAMES = 512


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of 8-bit unsigned mono samples."""
    body = payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + body


def samples(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a RIFF file; raises ValueError unless it is 8-bit mono PCM."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def low_pass(up: int, down: int, taps: int = 16) -> np.ndarray:
    """A windowed sinc for a change of the rate by ``up / down``; ``taps`` for each sample of the slower rate."""
    wide = max(up, down)
    t = np.arange(taps * wide) - (taps * wide - 1) / 2
    h = np.sinc(0.9 * t / wide) * np.hamming(taps * wide)
    return up * h / h.sum()


_WINDOW = np.hanning(FRAME + 1)[:-1]


def _mel_bank(rate: int) -> np.ndarray:
    """Triangles evenly spaced in mel, FRAME // 2 + 1 x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    bank = np.clip(np.minimum(up, down), 0, None)
    bank[np.abs(f[:, 0][:, None] - edges[1:-1]).argmin(0), np.arange(MELS)] += 1e-3
    return bank


_BANK = _mel_bank(RATE // 2)


def _every(x: np.ndarray, g: np.ndarray, step: int, shift: int, count: int) -> np.ndarray:
    """sum over k of g[k] x[q step + shift - k] for q from 0, from the filter's phases on the signal's phases; nothing else is computed."""
    out = np.zeros(count)
    for r in range(min(step, len(g))):
        part, ahead = x[(shift - r) % step :: step], (shift - r) // step
        if len(part):
            y = np.convolve(part, g[r::step])[max(ahead, 0) :][: count + min(ahead, 0)]
            out[max(-ahead, 0) : max(-ahead, 0) + len(y)] += y
    return out


def resample(x: np.ndarray, up: int, down: int, taps: np.ndarray | None = None) -> np.ndarray:
    """The signal at ``up / down`` times its rate: each of ``up`` output phases has its own part of the filter."""
    h = low_pass(up, down) if taps is None else taps
    n = -(-len(x) * up // down)
    out = np.zeros(n)
    for s in range(min(up, n)):
        at = s * down + len(h) // 2
        out[s::up] = _every(x, h[at % up :: up], down, at // up, len(out[s::up]))
    return out


_HALF = low_pass(1, 2)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x MELS in tenths of a decibel-like log unit, rounded, so that equal signals give equal numbers."""
    count = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    padded = np.concatenate([x, np.zeros(max(0, (count - 1) * HOP + FRAME - len(x)))])
    out = np.empty((count, MELS), np.float32)
    for at in range(0, count, CHUNK_FRAMES):
        m = min(CHUNK_FRAMES, count - at)
        frames = np.lib.stride_tricks.as_strided(padded[at * HOP :], (m, FRAME), (HOP * 8, 8))
        power = np.abs(np.fft.rfft(frames * _WINDOW)) ** 2
        out[at : at + m] = np.round(10 * np.log10(power @ _BANK + 1e-6), 1)
    return out


def spans(level: np.ndarray, high: float = 1.0, low: float = -1.0) -> list[tuple[int, int]]:
    """Runs of frames that begin above mean + ``high`` and last until below mean + ``low`` (end exclusive)."""
    over, under = level >= level.mean() + high, level < level.mean() + low
    mark = np.where(over, 1, np.where(under, -1, 0))
    known = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(known >= 0, mark[known], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return [(int(a), int(z)) for a, z in edge.reshape(-1, 2)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of every row: UTF-8 bytes, padded with 255 to a positive multiple of 576, in a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tv.texts(batch.column(1))
            for a, z in tv.slices(column, 8 << 20):
                data, offs = tv.buffers(column.slice(a, z - a))
                raw, ends = data.tobytes(), offs.tolist()
                media = []
                for s, e in zip(ends, ends[1:], strict=False):
                    size = max(UNIT, -(-(e - s) // UNIT) * UNIT)
                    media.append(wav(raw[s:e].ljust(size, bytes([PAD]))))
                yield pa.record_batch([batch.column(0).slice(a, z - a), pa.array(np.diff(offs)), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tv.freeing(run), f"`{id_col}` {kind}, n_bytes long, media binary")


SEGMENTS = "array<struct<t_start:double,t_end:double>>"
TENSOR = pa.schema([("t_start", pa.float64()), ("t_end", pa.float64()), ("frames", pa.int32()), ("logmel", pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS)))])


def _stream(mel: np.ndarray, step: float) -> bytes:
    """An Arrow stream of the frames in tensors of (BLOCK, MELS) with their seconds; the last one is filled with -60."""
    n = len(mel)
    full = np.full((-(-n // BLOCK) * BLOCK, MELS), -60, np.float32)
    full[:n] = mel
    first = np.arange(0, len(full), BLOCK)
    used = np.minimum(BLOCK, n - first)
    tensor = pa.ExtensionArray.from_storage(TENSOR.field("logmel").type, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), BLOCK * MELS))
    begin = first * step
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR) as out:
        out.write_batch(pa.record_batch([pa.array(begin), pa.array(begin + ((used - 1) * HOP + FRAME) / (RATE / 2)), pa.array(used.astype(np.int32)), tensor], schema=TENSOR))
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """(t_start, t_end, frames, logmel) of a file's blocks; ``logmel`` is a fixed-shape tensor."""
    return pa.ipc.open_stream(stored).read_all()


def features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Every file's digests, its log-mel blocks as an Arrow stream of fixed-shape tensors, and energetic spans in seconds."""
    keep = [c for c in media.columns if c not in (id_col, media_col)]
    step = HOP / (RATE / 2)
    own = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_blocks", "tensors", "segments"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.struct([("t_start", pa.float64()), ("t_end", pa.float64())]))]

    def one(stored: bytes) -> tuple:
        _, payload = samples(stored)
        x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
        mel = log_mel(resample(x - x.mean(), 1, 2, _HALF))
        loud = [{"t_start": a * step, "t_end": ((z - 1) * HOP + FRAME) / (RATE / 2)} for a, z in spans(mel.mean(1))]
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), -(-len(mel) // BLOCK), _stream(mel, step), loud

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for a in range(0, batch.num_rows, 256):
                rows = [one(m.as_py()) for m in at[media_col].slice(a, 256)]
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.record_batch([at[id_col].slice(a, 256), *(at[c].slice(a, 256) for c in keep), *made], [id_col, *keep, *own])

    small_batches(media.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in media.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in (id_col, *keep)])
    return media.mapInArrow(tv.freeing(run), f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_blocks int, tensors binary, segments {SEGMENTS}")


def op6_audio(spark, sf_dir: str) -> DataFrame:
    made = features(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digest = F.sha2(F.concat("tensors", F.to_json("segments").cast("binary")), 256)
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", F.col("n_blocks").cast("string"), F.size("segments").cast("string"), digest).alias("feature"))
