"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents become pieces: the ids of the text and an end id, cut only where a
document is longer than a sequence. Full pieces fill sequences of their own.
The others are packed by bulk-synchronous best-fit sweeps:

* full pieces fill sequences of their own and are numbered without a shuffle;
* documents and gaps are range-sorted by size. A size is an integer of at
  most ``capacity``, so each sorted list is held run-length encoded, as runs
  of equal size with an interval of ranks: at most ``capacity`` runs,
  whatever the corpus. Counting the runs and ranking the rows is distributed
  (salted, so that one hot size is no hot task);
* a sweep gives every run of documents, longest first, its successor: the
  runs of gaps of at least its size, smallest first. Many documents that
  want one run of gaps are resolved by rank: the k-th document takes the
  k-th gap, the rest go on to the next run, or open new sequences;
* gaps are updated, and the sweep repeats with the documents that are left,
  until none is.

The plan, a table of rank intervals, has a bounded size (runs times runs at
most) and is applied to the rows by a binary search on the rank.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import small_batches, staged

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 250_000
END_OF_WORD = "</w>"
TOGETHER = 256
SALTS = (64, 1024)
PROBES = ("Ab c", "x!y (z)", "Word. it's", "ÉA b1-2", "a,,b\tC\n\nd!?", "don't. 3.5%")

_encoders: dict[str, _Encoder] = {}


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.zeros(256, bool)  # ASCII marks but the apostrophe, which can begin a contraction
_TAIL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


def _parts(w: tv.Words) -> tv.Words:
    """Words in lower case with the marks at their ends apart, so that fewer of them differ.

    Exact for a tokenizer that lower-cases, splits at white space and takes a
    run of letters and a run of marks apart. Words that hold "<", which may
    begin a special token, stay as they are.
    """
    if not len(w.start):
        return w
    odd = np.add.reduceat((w.data == 60).astype(np.int32), w.start) > 0 if (w.data == 60).any() else np.zeros(len(w.start), bool)
    data = _LOWER[w.data]
    for s, e in zip(w.start[odd].tolist(), w.end[odd].tolist(), strict=True):
        data[s:e] = w.data[s:e]
    body = np.maximum.accumulate(np.where(_TAIL[data], 0, np.arange(1, len(data) + 1)))
    tail = body[w.end - 1]  # where the marks at the end begin
    split = (tail > w.start) & (tail < w.end) & ~odd
    split &= _ASCII_LETTER[data[np.maximum(tail, 1) - 1]]
    count = 1 + split
    at = np.cumsum(count) - count
    start, end = np.repeat(w.start, count), np.repeat(w.end, count)
    end[at[split]] = tail[split]
    start[at[split] + 1] = tail[split]
    return tv.Words(data, start, end, np.concatenate([[0], np.cumsum(count)])[w.bound])


class _Encoder:
    """Ids of white-space separated words, each distinct part encoded once and kept by its hash.

    Two sorted tables, one of what came lately, merged when it has grown. The
    cache is emptied at ``CACHE_WORDS`` parts.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        by_id = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(by_id.values()) + 1, bool)
        self.ends[[i for t, i in by_id.items() if t.endswith(END_OF_WORD)]] = True
        self.empty()
        whole = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in PROBES]
        #: whether texts may be encoded part by part
        self.splits = bool(self.ends.any()) and np.concatenate(whole).tolist() == self.encode(tv.words(pa.array(PROBES)))[0].tolist()
        self.empty()

    def empty(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.old, self.new = none, none
        self.place, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.words, self.ids, self.used = 0, np.zeros(1 << 18, np.uint32), 0

    def _find(self, distinct: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if unknown."""
        out = np.full(len(distinct), -1, np.int64)
        for keys, number in (self.old, self.new):
            if len(keys):
                slot = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = keys[slot] == distinct
                out[hit] = number[slot[hit]]
        return out

    def _fresh(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, sizes, ids): the ids of ``texts`` taken in ``order``.

        A word of letters alone is one run of ids that ends at an id with the
        end-of-word mark, so many of them are encoded as one text and told
        apart by these ends.
        """
        plain = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        order, sizes, ids = [np.flatnonzero(~plain)], [], []
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in order[0].tolist()], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        ids.append(np.fromiter((i for x in lists for i in x), np.uint32, int(sizes[0].sum())))
        alone = np.flatnonzero(plain)
        groups = [alone[i : i + TOGETHER] for i in range(0, len(alone), TOGETHER)]
        joined = [" ".join([texts[i] for i in g.tolist()]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[got]) + 1
            if len(ends) == len(g) and ends[-1] == len(got):
                size = np.diff(np.concatenate([[0], ends]))
            else:  # a letter that lower case turns into more than letters
                lists = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in g.tolist()], add_special_tokens=False)]
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                got = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
            order.append(g)
            sizes.append(size)
            ids.append(got)
        return np.concatenate(order), np.concatenate(sizes), np.concatenate(ids)

    def _learn(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.ids = _room(self.ids, self.used, len(flat))
        self.place, self.size = (_room(a, self.words, len(keys)) for a in (self.place, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        number = self.words + np.arange(len(keys))
        self.place[number], self.size[number] = self.used + np.cumsum(size) - size, size
        self.used += len(flat)
        self.words += len(keys)
        self.new = _merged(self.new, (keys, number))
        if 8 * len(self.new[0]) > len(self.old[0]):
            self.old, self.new = _merged(self.old, self.new), (keys[:0], number[:0])

    def encode(self, words: tv.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the words in order, how many each part has, and the bounds of parts between texts."""
        w = _parts(words)
        distinct, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if self.words > CACHE_WORDS:
            self.empty()
        number = self._find(distinct)
        new = np.flatnonzero(number < 0)
        if len(new):
            texts = tv.as_strings(w.data, w.start[first[new]], w.end[first[new]])
            order, size, ids = self._fresh(texts)
            self._learn(distinct[new[order]], size, ids)
            number = self._find(distinct)
        count = self.size[number][inverse]
        ends = np.cumsum(count)
        take = np.repeat(self.place[number][inverse] - (ends - count), count)
        take += np.arange(len(take))
        return self.ids[take], count, w.bound


def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    return a if used + more <= len(a) else np.concatenate([a[:used], np.zeros(max(more, used) + 1024, a.dtype)])


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, number = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    return keys[order], number[order]


def _encoder(vocabulary: str) -> _Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = _Encoder(vocabulary)
    return _encoders[vocabulary]


def token_ids(column: pa.Array, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end_id``, and the bounds between texts. A tokenizer whose parts don't add up gets whole texts."""
    encoder = _encoder(vocabulary)
    if encoder.splits:
        ids, count, parts = encoder.encode(tv.words(column))
    else:
        lists = [e.ids for e in encoder.tokenizer.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        count, parts = np.fromiter(map(len, lists), np.int64, len(lists)), np.arange(len(lists) + 1)
        ids = np.fromiter((i for x in lists for i in x), np.uint32, int(count.sum()))
    size = tv.fold(count, parts)
    bound = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(bound[-1], end_id, np.uint32)
    inside = np.ones(bound[-1], bool)
    inside[bound[1:] - 1] = False
    out[inside] = ids
    return out, bound


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every row, cut only at ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            if n % 4 == 3:
                tv.release()  # the tokenizer leaves much behind
            column = tv.texts(batch.column(1))
            for a, z in tv.slices(column):
                ids, bound = token_ids(column.slice(a, z - a), vocabulary, end_id)
                count = -(-np.diff(bound) // capacity)
                row = np.repeat(np.arange(z - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                lo = bound[row] + start
                hi = np.minimum(lo + capacity, bound[row + 1])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64, len(row))
                columns = [batch.column(0).slice(a, z - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(hi - lo), pa.array(crc)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bound_of(hi - lo), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(columns, names)

    small_batches(docs.sparkSession)
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tv.freeing(run, _encoders.clear), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def bound_of(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)])


class _Gaps:
    """Open sequences, sorted by gap, run-length encoded: per gap the intervals (first sequence, how many)."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, gap: int, first: int, many: int) -> None:
        if not self.runs[gap]:
            insort(self.sizes, gap)
        self.runs[gap].append((first, many))

    def take(self, gap: int, many: int) -> tuple[int, int]:
        """An interval of at most ``many`` sequences with this gap."""
        first, have = self.runs[gap].pop()
        if have > many:
            self.runs[gap].append((first, have - many))
            have = many
            first += self.runs[gap][-1][1]
        if not self.runs[gap]:
            self.sizes.remove(gap)
        return first, have


def sweep_plan(histogram: dict[int, int], capacity: int = CAPACITY, first_sequence: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, how many, first sequence, offset) that place every document.

    Runs of documents are swept from the longest. In a sweep the run takes its
    successor run of gaps, k-th document to k-th gap; gaps are updated and the
    sweep repeats for what is left of the run, which opens new sequences when
    no gap is large enough.
    """
    plan, gaps, opened = [], _Gaps(), first_sequence
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        rank, n = 0, histogram[length]
        while n:
            i = bisect_left(gaps.sizes, length)
            if i < len(gaps.sizes):
                gap = gaps.sizes[i]
                first, many = gaps.take(gap, n)
            else:  # no gap is large enough: open what this run needs by itself; the rest of it sees the new gaps
                gap, first, many = capacity, opened, -(-n // (capacity // length))
                opened += many
            plan.append((length, rank, many, first, capacity - gap))
            if gap > length:
                gaps.add(gap - length, first, many)
            rank, n = rank + many, n - many
    return plan


def place(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``cut`` (a staged table of pieces) with sequence_id and offset of every row.

    Full pieces are sequences by themselves and are numbered where they lie.
    The ranks of the others within their length are counted in salted parts,
    at least ``SALTS[0]`` and one for each million rows up to ``SALTS[1]``.
    """
    spark = cut.sparkSession
    salts = min(max(cut.count() >> 20, SALTS[0]), SALTS[1])
    salted = cut.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count().orderBy("length", "salt").toArrow()  # at most capacity x salts rows of numbers
    length, salt, many = (counts[c].to_numpy() for c in ("length", "salt", "count"))
    base = np.zeros((capacity + 1, salts), np.int64)
    ends = np.cumsum(many)
    base[length, salt] = ends - many - np.concatenate([[0], ends])[np.searchsorted(length, length)]
    total = np.bincount(length, many, capacity + 1).astype(np.int64)
    plan = sorted(sweep_plan({int(k): int(total[k]) for k in np.flatnonzero(total)}, capacity))
    length, rank, many, sequence, offset = (np.array(c, np.int64) for c in (zip(*plan, strict=True) if plan else [()] * 5))
    opened = int((sequence + many).max(initial=0))
    key = length << 46 | rank
    held = spark.sparkContext.broadcast((base, key, rank, sequence, offset))  # bounded by capacity and salts, not by rows

    kept = list(cut.columns)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "piece")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, key, rank, sequence, offset = held.value
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            size = at["length"].to_numpy()
            mine = base[size, at["salt"].to_numpy()] + at["rank"].to_numpy()
            slot = np.searchsorted(key, size << 46 | mine, "right") - 1
            yield pa.record_batch([*(at[c] for c in kept), pa.array(sequence[slot] + mine - rank[slot]), pa.array(offset[slot])], [*kept, "sequence_id", "offset"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    full = cut.where(F.col("length") == capacity).select(*kept, (F.monotonically_increasing_id() + F.lit(opened)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(tv.freeing(run), f"{types}, sequence_id long, offset long").unionByName(full)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs every row; tokenising happens once, into a table in the shared folder."""
    return place(staged(pieces(docs, capacity, id_col, text_col, vocabulary, end_id, with_ids), "pieces"), capacity, id_col)


def op2_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
