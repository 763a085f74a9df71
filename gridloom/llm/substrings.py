"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` words in a row. A word goes if a window over it also
starts in a document with a smaller id. Instead of sorting every window:

1. Anchors, runs of ``WINDOW - PERIOD + 1`` words, are hashed only at
   positions that are in a difference cover modulo ``PERIOD``. For any two
   positions some shift below the period brings both onto the cover, so two
   equal windows always share an aligned anchor.
2. Anchors that two documents hold are extended: only windows around them
   are hashed, over all their words, and the smallest document of each is
   found.
3. Words under windows whose smallest document is smaller than their own go.

Exact copies are one class: only the smallest id goes through the steps, so
a text that a third of all rows hold costs no more than any other. Texts are
shuffled once, into a table bucketed by groups of ``GROUP_BYTES``; after that
only packed hashes move. A group sends each different hash once, with the
smallest and the largest id that hold it there, so a passage that a third of
all documents share is one entry a group, and gets back what the others hold.
Blocks of hashes are cut by how many words there are.

Windows are told apart by 128 bits: two sums over words that are hashed in
two ways. Anchors have 64; a chance meeting there only adds windows to look at.

Defined results: a null or empty text has no words; a row with a null id
loses nothing and takes nothing from others; rows with one id, repeated or
not, take nothing from each other; texts of fewer than ``WINDOW`` words stay
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import small_batches, staged

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)  # differences 1 to 6 modulo 7, each once
GROUP_BYTES = 4 << 20
BLOCK_HASHES = 1 << 20
OTHER = np.uint64(0xA0761D6478BD642F)
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(h: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs at cover positions of their text, and the index of their first word."""
    run, at = tv.runs(h, bound, WINDOW - PERIOD + 1)
    within = at - np.repeat(bound[:-1], np.diff(bound))[at]
    on = np.isin(np.arange(PERIOD), COVER)[within % PERIOD]
    return run[on], at[on]


def _check(h: np.ndarray) -> np.ndarray:
    """The words' hashes in another way, for the second half of a window's key."""
    return tv.mix(h + OTHER)


def _merged(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different rows of ``keys`` in order, with the smallest and the largest id of each."""
    if not len(keys):
        return keys, low, high
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    return keys[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


PACKED = "b int, g int, keys binary, ids binary, lows binary, more binary, highs binary"
FOUND = "b int, keys binary, lows binary"


def _sent(group: int, blocks: int, keys: np.ndarray, ids: np.ndarray) -> pa.Table:
    """What a group of texts holds, one binary row for each block of hashes.

    Smallest ids are places in the row's list of ids; largest ones are given,
    with the key's place, only where they differ.
    """
    keys, low, high = _merged(keys, ids, ids)
    block = (keys[:, 0] >> np.uint64(33)).astype(np.int64) % blocks
    order = np.argsort(block, kind="stable")
    keys, low, high, block = keys[order], low[order], high[order], block[order]
    rows = []
    for a, z in _spans(block):
        known, place = np.unique(np.concatenate([low[a:z], high[a:z]]), return_inverse=True)
        place = place.astype("<u4")
        more = np.flatnonzero(low[a:z] != high[a:z]).astype("<u4")
        rows.append((int(block[a]), group, keys[a:z].tobytes(), known.astype("<i8").tobytes(), place[: z - a].tobytes(), more.tobytes(), place[z - a :][more].tobytes()))
    return _table(rows, PACKED)


def _spans(number: np.ndarray) -> list[tuple[int, int]]:
    """Ends of the runs of equal numbers."""
    cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(number)], strict=False))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = [(f.split()[0], {"int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)})


def _numbers(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def _received(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, key, smallest id, largest id) of everything that was sent to a block."""
    group, low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g, ids, at, more, tops in zip(*(table[n].to_pylist() for n in ("g", "ids", "lows", "more", "highs")), strict=True):
        known, at = np.frombuffer(ids, "<i8"), np.frombuffer(at, "<u4")
        low.append(known[at])
        high.append(low[-1].copy())
        high[-1][np.frombuffer(more, "<u4")] = known[np.frombuffer(tops, "<u4")]
        group.append(np.full(len(at), g, np.int64))
    return np.concatenate(group), _numbers(table, "keys", "<u8").reshape(-1, width), np.concatenate(low), np.concatenate(high)


def _shared(width: int, smaller_only: bool):
    """Per block of hashes, for each group its keys that other ids hold too (``smaller_only``: smaller ids), with the smallest id."""

    def run(table):
        group, keys, low, high = _received(table, width)
        order = np.lexsort(keys.T[::-1])
        keys, low, high, group = keys[order], low[order], high[order], group[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(keys)]]))
        least = np.repeat(np.minimum.reduceat(low, first), size) if len(first) else low
        hit = high > least if smaller_only else np.repeat(np.maximum.reduceat(high, first), size) > least if len(first) else np.zeros(0, bool)
        order = np.flatnonzero(hit)[np.argsort(group[hit], kind="stable")]
        group, keys, least = group[order], keys[order], least[order]
        return _table([(int(group[a]), keys[a:z].tobytes(), least[a:z].tobytes()) for a, z in _spans(group)], FOUND)

    return run


def _rows(table: pa.Table) -> Iterator[tuple[np.ndarray, pa.Array]]:
    column, ids = tv.texts(table["text"]), table["id"].combine_chunks().to_numpy()
    for a, z in tv.slices(column):
        yield ids[a:z], column.slice(a, z - a)


def _gathered(parts: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros((0, width), np.uint64), *(k for k, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(i for _, i in parts)])


def _anchor_pass(blocks: int):
    def run(key, texts):
        parts = []
        for ids, column in _rows(texts):
            w = tv.words(column)
            anchor, at = anchors(w.hashes(), w.bound)
            parts.append((anchor[:, None], ids[w.owner()[at]]))
        return _sent(key[0].as_py(), blocks, *_gathered(parts, 1))

    return run


def _window_pass(blocks: int):
    def run(key, texts, marks):
        wanted, parts = np.sort(_numbers(marks, "keys", "<u8")), []
        for ids, column in _rows(texts) if len(wanted) else ():
            w = tv.words(column)
            h, owner = w.hashes(), w.owner()
            anchor, at = anchors(h, w.bound)
            hit = at[_within(wanted, anchor)]
            window, start = tv.runs(h, w.bound, WINDOW)
            # a window holds the anchors that begin at its first PERIOD words
            marked = np.zeros(len(h) + 1, np.int64)
            marked[hit + 1] = 1
            marked = np.cumsum(marked)
            near = marked[start + PERIOD] > marked[start]
            parts.append((np.stack([window[near], tv.runs_at(_check(h), start[near], WINDOW)], 1), ids[owner[start[near]]]))
        return _sent(key[0].as_py() if key[0].is_valid else 0, blocks, *_gathered(parts, 2))

    return run


def _within(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


class _Gone:
    """The smallest id of each key (hash, check) that a group was told."""

    def __init__(self, table: pa.Table):
        keys, low = _numbers(table, "keys", "<u8").reshape(-1, 2), _numbers(table, "lows", "<i8")
        order = np.lexsort(keys.T[::-1])
        self.hash, self.check, self.low = keys[order, 0], keys[order, 1], low[order]
        same = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], self.hash[1:] != self.hash[:-1]])), [len(order)]])) if len(order) else np.zeros(0, np.int64)
        self.alike = int(same.max(initial=0))  # keys with one hash: 1 but for chance

    def takes(self, h: np.ndarray, window: np.ndarray, start: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Starts of the windows that a smaller id holds."""
        some = np.flatnonzero(_within(self.hash, window))
        at, check = np.searchsorted(self.hash, window[some]), tv.runs_at(_check(h), start[some], WINDOW)
        out = np.zeros(len(some), bool)
        for k in range(self.alike):
            slot = np.minimum(at + k, len(self.hash) - 1)
            out |= (self.hash[slot] == window[some]) & (self.check[slot] == check) & (ids[some] > self.low[slot])
        return start[some[out]]


def kept_words(w: tv.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words joined by single spaces, and their bounds between texts."""
    n = len(w.data)
    start, end, owner = w.start[keep], w.end[keep], w.owner()[keep]
    edge = np.zeros(n + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    take = np.cumsum(edge[:n]).astype(bool)
    last = np.ones(len(end), bool)
    last[:-1] = owner[1:] != owner[:-1]
    gap = end[~last]
    take[gap] = True
    data = w.data.copy()
    data[gap] = 32
    size = np.bincount(owner, end - start + ~last, len(w.bound) - 1).astype(np.int64)
    return data[take], np.concatenate([[0], np.cumsum(size)])


def _digest_pass(with_text: bool):
    def run(texts, gone):
        removed, out = _Gone(gone), []
        pairs = list(zip(texts["id"].to_pylist(), texts["content"].to_pylist(), strict=True))
        texts = texts.take(pa.array(sorted({p: i for i, p in enumerate(pairs)}.values()), pa.int64()))  # a repeated row once
        content = texts["content"].combine_chunks()
        for ids, column in _rows(texts):
            w = tv.words(column)
            h, owner = w.hashes(), w.owner()
            window, start = tv.runs(h, w.bound, WINDOW)
            hit = removed.takes(h, window, start, ids[owner[start]])
            cover = np.zeros(len(w.start) + 1, np.int64)
            cover[hit] += 1
            cover[hit + WINDOW] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            data, bound = kept_words(w, keep)
            raw, ends = data.tobytes(), bound.tolist()
            parts = [raw[a:z] for a, z in zip(ends, ends[1:], strict=False)]
            lost = np.bincount(owner[~keep], minlength=len(ids))
            out.append(pa.table({"id": pa.array(ids), "n_removed": pa.array(lost.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts]), **({"kept": pa.array([p.decode() for p in parts])} if with_text else {})}))
        if not out:
            return pa.table({c: pa.array([], t) for c, t in (("id", pa.int64()), ("content", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else []))})
        return pa.concat_tables(out).add_column(1, "content", content)

    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, content, n_words, n_bytes, kept_sha256, kept) of every row; the last two where no window can take words."""
    for batch in batches:
        column = tv.texts(batch.column(1))
        for a, z in tv.slices(column):
            w = tv.words(column.slice(a, z - a))
            count = w.count
            ids = batch.column(0).slice(a, z - a)
            whole = (count < WINDOW) | np.array(ids.is_null())
            data, bound = kept_words(w, np.repeat(whole, count))
            raw, ends = data.tobytes(), bound.tolist()
            parts = [raw[s:e] if x else None for s, e, x in zip(ends, ends[1:], whole.tolist(), strict=False)]
            _, offs = tv.buffers(column.slice(a, z - a))
            text, edge = w.data.tobytes(), offs.tolist()
            content = [hashlib.md5(text[s:e]).digest() for s, e in zip(edge, edge[1:], strict=False)]
            yield pa.record_batch([ids, pa.array(content, pa.binary()), pa.array(count), pa.array(np.diff(offs)), pa.array([p if p is None else hashlib.sha256(p).hexdigest() for p in parts], pa.string()), pa.array([p if p is None else p.decode() for p in parts], pa.string())], ["id", "content", "n_words", "n_bytes", "kept_sha256", "kept"])


_tables: list = []


def _forget() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may be over
            return


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` as a table bucketed by ``b`` in the warehouse, so that joins on ``b`` read it without a shuffle."""
    spark = df.sparkSession
    name = f"gridloom_texts_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "b").sortBy("b").saveAsTable(name)
    if not _tables:
        atexit.register(_forget)
    _tables.append((spark, name))
    return spark.table(name)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of every row; ``kept`` is the text that is left, words joined by spaces."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = staged(rows.mapInArrow(tv.freeing(_summary), "id long, content binary, n_words long, n_bytes long, kept_sha256 string, kept string"), "summary")
    first = seen.where(F.col("id").isNotNull() & (F.col("n_words") >= WINDOW)).groupBy("content").agg(F.min("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.max("n_words").alias("n_words"))
    first = staged(first, "classes")
    total, words = (x or 0 for x in first.agg(F.sum("n_bytes"), F.sum("n_words")).first())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-total // GROUP_BYTES))
    blocks = max(partitions, -(-words * len(COVER) // (PERIOD * BLOCK_HASHES)))

    held = min(groups, partitions)
    dealt = lambda df, key: df.withColumn("b", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).repartition(held, "b")
    own = dealt(first.select(F.col("id").alias("_id"), F.col("content").alias("_content")), "_id").withColumnRenamed("b", "_b").hint("shuffle_hash")
    same = (F.col("b") == F.col("_b")) & (F.col("id") == F.col("_id")) & (F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("_content"))
    one = dealt(rows.where(F.col("id").isNotNull()), "id").join(own, same).select("b", "id", F.col("_content").alias("content"), "text")
    every = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(every)
    spark.conf.set(every, "false")  # both sides are dealt by "b" already: one shuffle of the texts serves the join and the table
    try:
        texts = _bucketed(one, held)
    finally:
        spark.conf.set(every, before)

    found = texts.select("b", "id", "text").groupBy("b").applyInArrow(_anchor_pass(blocks), PACKED).groupBy("b").applyInArrow(_shared(1, False), FOUND)
    windows = texts.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(_window_pass(blocks), PACKED)
    gone = windows.groupBy("b").applyInArrow(_shared(2, True), FOUND)
    schema = "id long, content binary, n_removed long, kept_sha256 string" + ", kept string" * with_text
    done = texts.groupBy("b").cogroup(gone.groupBy("b")).applyInArrow(_digest_pass(with_text), schema)
    return _joined(seen, first, done, id_col, with_text)


def _joined(seen: DataFrame, first: DataFrame, done: DataFrame, id_col: str, with_text: bool) -> DataFrame:
    """Rows of a class beyond its smallest id lose every word; the others have their own result."""
    result = done.select(F.col("id").alias("_id"), F.col("content").alias("_of"), F.col("n_removed").alias("_removed"), F.col("kept_sha256").alias("_sha"), *([F.col("kept").alias("_kept")] if with_text else []))
    own = first.select(F.col("id").alias("_own"), F.col("content").alias("_content"))
    out = seen.join(own, (F.col("id") == F.col("_own")) & (F.col("content") == F.col("_content")), "left").join(result, (F.col("_own") == F.col("_id")) & (F.col("_content") == F.col("_of")), "left")
    short = F.col("kept_sha256").isNotNull()
    columns = [F.col("id").alias(id_col), "n_words", F.when(short, F.lit(0)).when(F.col("_own").isNull(), F.col("n_words")).otherwise(F.col("_removed")).cast("long").alias("n_removed"), F.when(short, F.col("kept_sha256")).when(F.col("_own").isNull(), F.lit(EMPTY)).otherwise(F.col("_sha")).alias("kept_sha256")]
    if with_text:
        columns.append(F.when(short, F.col("kept")).when(F.col("_own").isNull(), F.lit("")).otherwise(F.col("_kept")).alias("kept"))
    return out.select(*columns)


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
