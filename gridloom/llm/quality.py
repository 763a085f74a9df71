"""Quality classifier: a factorisation machine over hashed words, structure statistics and text size.

The score is ``sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))``,
so a document costs time linear in its words. Training runs on the driver
over at most ``sample`` labelled rows and ``values`` numbers (the bounds are
parameters); every document is scored, whole, where it lies: no shuffle of
texts.

Defined results: null and empty texts have no words and get the score of the
statistics alone; labels that are null or without a document teach nothing;
a document with several label rows teaches once per different label, one of
several texts under one id once per text, repeated rows once; without any
label every score is 0.5. Repeated rows keep their own result each. Ids may
be of any type. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import small_batches, smallest, staged

BUCKETS = 1 << 15
BINS = 16
SAMPLE = 4000
VALUES = 8_000_000


def _class_of_bytes() -> np.ndarray:
    table = np.zeros((6, 256), np.float32)
    b = np.arange(256)
    table[0] = (b >= 65) & (b <= 90)
    table[1] = (b >= 97) & (b <= 122)
    table[2] = (b >= 48) & (b <= 57)
    table[3] = np.isin(b, np.frombuffer(b".,;:'\"-?()", np.uint8))
    table[4] = (b > 32) & (b < 127) & ~np.isin(b, np.frombuffer(b".,;:'\"-?()", np.uint8)) & (table[0] + table[1] + table[2] == 0)
    table[5] = b == 10
    return table


_CLASSES = _class_of_bytes()
STATS = 12
FEATURES = BUCKETS + STATS * BINS


def _sizes(ratio: np.ndarray) -> np.ndarray:
    return np.clip(np.sqrt(np.clip(ratio, 0, 1)) * BINS, 0, BINS - 1).astype(np.int64)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (bound, index, value): words scaled to unit length, then one bin of each statistic."""
    w = tv.words(column)
    n = len(column)
    data, offs = tv.buffers(column)
    size = np.maximum(np.diff(offs), 1).astype(np.float32)
    count = w.count
    many = np.maximum(count, 1).astype(np.float32)
    h = w.hashes()
    owner = w.owner()
    bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
    key, tf = np.unique(owner * BUCKETS + bucket, return_counts=True)
    row, index = key // BUCKETS, key % BUCKETS
    value = np.log1p(tf).astype(np.float32)
    norm = np.sqrt(np.maximum(np.bincount(row, value * value, n), 1e-9)).astype(np.float32)
    value = value / norm[row]

    share = [tv.fold(c[data], offs) / size for c in _CLASSES]
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    length = (w.end - w.start).astype(np.float32)
    odd_end = _CLASSES[4][last]
    solo = ((length == 1) & (odd_end > 0)).astype(np.float32)
    distinct = np.bincount(row, minlength=n).astype(np.float32) / many
    stats = [
        *share,
        tv.fold(odd_end, w.bound) / many,
        tv.fold(solo, w.bound) / many,
        tv.fold(length, w.bound) / many / 24,
        distinct,
        np.log1p(count) / 14,
        np.log1p(size) / 16,
    ]
    bins = np.stack([BUCKETS + k * BINS + _sizes(s) for k, s in enumerate(stats)], 1)
    all_rows = np.concatenate([row, np.repeat(np.arange(n), STATS)])
    order = np.argsort(all_rows, kind="stable")
    index = np.concatenate([index, bins.ravel()])[order]
    value = np.concatenate([value, np.full(n * STATS, 0.5, np.float32)])[order]
    bound = np.concatenate([[0], np.cumsum(np.bincount(all_rows, minlength=n))])
    return bound, index, value


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # FEATURES
    factors: np.ndarray  # FEATURES x rank

    def margin(self, bound: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        starts = bound[:-1]
        if not len(starts):
            return np.zeros(0)
        vx = self.factors[index] * value[:, None]
        s = np.add.reduceat(vx, starts)
        sq = np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * (s * s - sq).sum(1)


def train(bound: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, rank: int = 8, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> Machine:
    """Adaptive gradient steps on the logistic loss, in a fixed order of rows for equal input."""
    rng = np.random.default_rng(seed)
    n = len(label)
    w, v = np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, rank)).astype(np.float32)
    if not n:
        return Machine(0.0, w, np.zeros_like(v))
    mean = min(max(float(label.mean()), 1e-3), 1 - 1e-3)
    m = Machine(float(np.log(mean / (1 - mean))), w, v)
    gw, gv, gb = np.full(FEATURES, 1e-4, np.float32), np.full((FEATURES, rank), 1e-4, np.float32), 1e-4
    weight = np.where(label > 0, 0.5 / mean, 0.5 / (1 - mean)).clip(0.2, 5).astype(np.float32)
    m.bias = 0.0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            size = bound[rows + 1] - bound[rows]
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            take = np.repeat(bound[rows] - starts, size) + np.arange(size.sum())
            i, x = index[take], value[take]
            vx = m.factors[i] * x[:, None]
            s = np.add.reduceat(vx, starts)
            out = m.bias + np.add.reduceat(m.linear[i] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)
            err = (1 / (1 + np.exp(-out)) - label[rows]) * weight[rows] / len(rows)
            e = np.repeat(err, size).astype(np.float32)
            g_w, g_v = e * x, (e * x)[:, None] * (np.repeat(s, size, 0) - vx)
            by = np.argsort(i, kind="stable")
            u, first = np.unique(i[by], return_index=True)
            g_w = np.add.reduceat(g_w[by], first) + decay * m.linear[u]
            g_v = np.add.reduceat(g_v[by], first) + decay * m.factors[u]
            gw[u] += g_w * g_w
            gv[u] += g_v * g_v
            gb += float(err.sum()) ** 2
            m.linear[u] -= rate * g_w / np.sqrt(gw[u])
            m.factors[u] -= 0.5 * rate * g_v / np.sqrt(gv[u])
            m.bias -= rate * float(err.sum()) / gb**0.5
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, values: int = VALUES) -> Machine:
    """Learns from the ``sample`` labelled rows with the smallest hashes of id and text, as far as their features make up ``values`` numbers.

    Rows whose crc32(id as text) mod 3 is 1 are held out. First only ids,
    labels and lengths of at most ``2 * sample`` labels' documents are seen,
    then the features of the chosen texts; texts are never gathered.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = F.col(id_col).cast("string")
    taught = labels.where(F.col(label_col).isNotNull() & key.isNotNull() & (F.crc32(key) % 3 != 1)).select(key.alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    asked = smallest(taught, F.xxhash64("id", F.lit(11)), ["id", "label"], sample).collect()
    if not asked:
        none = np.zeros(0, np.int64)
        return train(np.zeros(1, np.int64), none, none, none)
    few = F.broadcast(spark.createDataFrame(asked, "id string, label int"))
    lit = docs.select(key.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(few, "id").withColumn("same", F.xxhash64("text"))
    light = staged(lit.groupBy("id", "label", "same").agg(F.max(F.length("text")).alias("n")), "light")
    chosen, held = [], 0
    for r in smallest(light, F.xxhash64("id", "same", F.lit(11)), ["id", "label", "same"], sample).collect():
        held += min(r.n // 2 + 1, BUCKETS) + STATS
        if held > values and chosen:
            break
        chosen.append((r.id, r.label, r.same))
    if not chosen:
        none = np.zeros(0, np.int64)
        return train(np.zeros(1, np.int64), none, none, none)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tv.texts(batch.column("text"))
            for a, z in tv.slices(column):
                bound, index, value = features(column.slice(a, z - a))
                yield pa.record_batch([*(batch.column(c).slice(a, z - a) for c in ("id", "label", "same")), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(index, pa.int32())), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(value, pa.float32()))], ["id", "label", "same", "at", "x"])

    these = F.broadcast(spark.createDataFrame(chosen, "id string, label int, same long"))
    once = lit.drop("label").join(these, ["id", "same"]).groupBy("id", "label", "same").agg(F.first("text").alias("text"))
    learnt = once.select("id", "label", "same", "text").mapInArrow(tv.freeing(rows), "id string, label int, same long, at array<int>, x array<float>").toArrow()
    learnt = learnt.sort_by([("id", "ascending"), ("label", "ascending"), ("same", "ascending")])
    size = np.concatenate([[0], *(c.value_lengths().to_numpy() for c in learnt["at"].chunks)]).astype(np.int64)
    flat = lambda c, t: np.concatenate([np.zeros(0, t), *(x.flatten().to_numpy() for x in learnt[c].chunks)]).astype(t)
    index, value, label = flat("at", np.int64), flat("x", np.float32), learnt["label"].to_numpy().astype(np.float32)
    del learnt
    machine = train(np.cumsum(size), index, value, label)
    del index, value
    tv.release()  # the driver lives on
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's (id, score): the share of belief that the label is 1. Null and empty texts have a score too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tv.texts(batch.column(1))
            for a, z in tv.slices(column):
                margin = machine.margin(*features(column.slice(a, z - a)))
                out = np.round(1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30))), 6)
                yield pa.record_batch([batch.column(0).slice(a, z - a), pa.array(out, pa.float64())], [id_col, "score"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tv.freeing(rows), f"`{id_col}` {kind}, score double")


def keep(docs: DataFrame, machine: Machine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is at least ``least``; texts stay where they lie."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tv.texts(batch.column(at))
            for a, z in tv.slices(column):
                margin = machine.margin(*features(column.slice(a, z - a)))
                good = np.round(1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30))), 6) >= least
                yield batch.slice(a, z - a).filter(pa.array(good))

    return docs.mapInArrow(tv.freeing(rows), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Fits on the labelled rows that aren't held out and scores every document."""
    scored = score(docs, fit(docs, labels, id_col, text_col, label_col, sample), id_col, text_col)
    return scored.select(id_col, (F.crc32(F.col(id_col).cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
