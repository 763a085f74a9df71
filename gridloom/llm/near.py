"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is at least 0.8. Equal texts, told apart by 128 bits, are one node
with a number of its own. Nodes that share a band
of MinHash values are candidates (32 bands of 4: a pair at 0.8 shares none
with probability 5e-8). Candidates compare their MinHash values 16 at a
time; with a uniform prior the similarity's posterior after m of n matches is
Beta(m + 1, n - m + 1), and a pair is dropped once P(similarity >= 0.8) falls
below 1e-6. The rest is verified exactly on the sets of shingles.

Pairs never become rows. Members of bands meet in buckets whose number
follows that of the nodes; a band that may have ``HOT`` members or more is
found beforehand, by counting inside each partition, and never grouped: its
members find their blocks by hashes. A band with many members is dealt into
cells of two blocks of about ``BLOCK`` members, each pair met in one cell; a cell
returns only edges that span what it has linked. Verification does the same
within the clusters that these edges make: each cell of two blocks compares
all its pairs (band, posterior, exact) and returns, per node, how many
documents it is linked to there and one spanning edge.

Texts are shuffled once, for the members of clusters of two or more; all
else that moves is signatures of ``2 * BANDS * ROWS`` bytes and ids.

Defined results: words are separated by ASCII white space and unchanged; a
text of one to four words has one shingle, all its words; a null or empty
text has none and no links, and is a class of its own by its row id; equal
rows are linked like any copies, each counted once; rows with a null id keep a result each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import components
from . import textvec as tv
from .scratch import small_batches, staged

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
HOT = 1 << 20
BUCKET_KEYS = 1 << 20
PAIRS_AT_ONCE = 1 << 15

_random = np.random.default_rng(97)
_A = (_random.integers(1, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order (a text of one to four words has one), and bounds between texts."""
    w = tv.words(column)
    h = w.hashes()
    runs, at = tv.runs(h, w.bound, SHINGLE)
    for k in range(1, SHINGLE):
        few = np.flatnonzero(w.count == k)
        if len(few):
            r, a = tv.runs(h, w.bound, k)
            mine = np.isin(a, w.bound[few])
            runs, at = np.concatenate([runs, tv.mix(r[mine] + np.uint64(k))]), np.concatenate([at, a[mine]])
    order = np.argsort(at, kind="stable")
    runs, at = runs[order], at[order]
    return runs, np.searchsorted(at, w.bound)


def signature(runs: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits."""
    s = (runs >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(s), 1024):
        np.minimum(low, (s[a : a + 1024, None] * _A + _B).min(0), out=low)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(16)).astype("<u2")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = STEP, 2 STEP, ...: fewest matches m with P(similarity >= threshold | m of n) >= tolerance.

    Under a uniform prior this is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


_LEAST = least_matches()


def likely(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray = _LEAST) -> np.ndarray:
    """Indices of the pairs whose posterior stays within tolerance after every step of comparisons."""
    left = np.arange(len(i))
    m = np.zeros(len(i), np.int32)
    for step, need in enumerate(least):
        cut = slice(step * STEP, (step + 1) * STEP)
        m = m + (sig[i[left], cut] == sig[j[left], cut]).sum(1)
        ok = m >= need
        left, m = left[ok], m[ok]
    return left


def first_band(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first band that each pair shares, BANDS if none."""
    same = (sig[i] == sig[j]).reshape(-1, BANDS, ROWS).all(2)
    return np.where(same.any(1), same.argmax(1), BANDS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS keys; the band is in the lowest bits."""
    v = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = v[:, :, 0] | v[:, :, 1] << np.uint64(16) | v[:, :, 2] << np.uint64(32) | v[:, :, 3] << np.uint64(48)
    key = tv.mix(key + tv.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)))
    return (key & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)


def _sigs(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), HASHES)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = tv.texts(batch.column(2))
        for a, z in tv.slices(column):
            runs, bound = shingles(column.slice(a, z - a))
            sig = [signature(runs[s:e]).tobytes() for s, e in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), pa.array(sig, pa.binary())], ["id", "digest", "sig"])


def _known(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ``hot`` ones."""
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys if len(hot) else np.zeros(len(keys), bool)


def _count(least: int, most: int = 1 << 21):
    """Keys that a partition holds at least about ``least`` times; beyond ``most`` keys the rarer half is forgotten, with what it may have missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, missed = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            new, many = np.unique(band_keys(_sigs(batch.column(1))).ravel(), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, many])).astype(np.int64)
            if len(keys) > most:
                low = int(np.partition(counts, len(counts) // 2)[len(counts) // 2])
                keys, counts, missed = keys[counts > low], counts[counts > low] - low, missed + low
        keep = counts + missed >= least
        yield pa.record_batch([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep] + missed)], ["key", "n"])

    return run


def _hot_keys(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, blocks) of every band that ``2 * HOT`` nodes share, and of some that fewer do. One for each ``HOT / 2`` postings at most."""
    parts = nodes.rdd.getNumPartitions()
    counted = nodes.mapInArrow(tv.freeing(_count(max(2, HOT // parts))), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT // 2)
    got = sorted((int(np.int64(r.key).view(np.uint64)), -(-(r.n + HOT) // BLOCK)) for r in counted.collect())
    return np.array([k for k, _ in got], np.uint64), np.array([m for _, m in got], np.int64)


MEMBERS = "key long, node long, block int, many int"


def _spread(hot: np.ndarray, many: np.ndarray):
    """Members of hot bands, each with its block by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = band_keys(_sigs(batch.column(1))).ravel()
            mine = np.flatnonzero(_known(key, hot))
            node, count = batch.column(0).to_numpy()[mine // BANDS], many[np.searchsorted(hot, key[mine])]
            block = (tv.mix(node.astype(np.uint64)) % count.astype(np.uint64)).astype(np.int32)
            yield pa.record_batch([pa.array(key[mine].view(np.int64)), pa.array(node), pa.array(block), pa.array(count.astype(np.int32))], ["key", "node", "block", "many"])

    return run


def _post(buckets: int, hot: np.ndarray):
    """Signatures to packed postings, a binary row for each bucket of keys; hot keys are left to ``_spread``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                node = part.column(0).to_numpy()
                key = band_keys(_sigs(part.column(1))).ravel()
                owner = np.repeat(node, BANDS)
                if len(hot):
                    cold = ~_known(key, hot)
                    key, owner = key[cold], owner[cold]
                bucket = (tv.mix(key) >> np.uint64(20)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                bucket, key, owner = bucket[order], key[order], owner[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.concatenate([cut[1:], [len(bucket)]])
                yield pa.record_batch([pa.array(bucket[cut].astype(np.int32)), pa.array([key[s:e].tobytes() for s, e in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.array([owner[s:e].tobytes() for s, e in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())], ["b", "keys", "nodes"])

    return run


def _deal(table):
    """Members of keys that two nodes or more share, with their block and how many there are."""
    key = np.frombuffer(b"".join(table["keys"].to_pylist()), "<u8")
    node = np.frombuffer(b"".join(table["nodes"].to_pylist()), "<i8")
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(key)]]))
    each = np.repeat(size, size)
    block = (np.arange(len(key)) - np.repeat(first, size)) // BLOCK
    keep = each > 1
    return pa.table({"key": pa.array(key[keep].view(np.int64)), "node": pa.array(node[keep]), "block": pa.array(block[keep].astype(np.int32)), "many": pa.array((-(-each // BLOCK))[keep].astype(np.int32))})


class _Sets:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))], np.int64)


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[pa.Table]:
    """Whole cells (rows with equal ``keys``, sorted by them) in tables of about ``limit`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for a in range(0, batch.num_rows, limit):
            held.append(batch.slice(a, limit))
            if sum(b.num_rows for b in held) >= limit:
                table = pa.Table.from_batches(held)
                last = np.ones(table.num_rows, bool)
                for k in keys:
                    v = table[k].to_numpy()
                    last &= v == v[-1]
                at = int(np.argmin(last[::-1])) if not last.all() else table.num_rows
                at = table.num_rows - at
                if at:
                    yield table.slice(0, at)
                held = table.slice(at).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _once(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without those whose ``keys`` equal the row's before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        new[0] = last != tuple(c[0] for c in columns)
        last = tuple(c[-1] for c in columns)
        yield batch if new.all() else batch.filter(pa.array(new))


def _pairs(cell: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell; in a cell of two blocks, one row of each."""
    n = len(cell)
    end = np.searchsorted(cell, cell, "right")
    count = end - np.arange(n) - 1
    total = np.cumsum(count)
    at = 0
    while at < n:
        done = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")), at + 1)
        c = count[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        ok = (lo[i] == hi[i]) | (block[i] != block[j])
        yield i[ok], j[ok]
        at = to


def _cell_ids(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    for k in keys:
        v = table[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that span the likely pairs of each cell, met in the first band that they share."""
    for table in _cells(batches, ["key", "lo", "hi"], 1 << 14):
        cell = _cell_ids(table, ["key", "lo", "hi"])
        band = (table["key"].to_numpy().view(np.uint64) & np.uint64(BANDS - 1)).astype(np.int64)
        sig, node = _sigs(table["sig"]), table["node"].to_numpy()
        ids, place = np.unique(node, return_inverse=True)
        sets = _Sets(len(ids))
        for i, j in _pairs(cell, table["block"].to_numpy(), table["lo"].to_numpy(), table["hi"].to_numpy()):
            ok = likely(sig, i, j)
            i, j = i[ok], j[ok]
            mine = first_band(sig, i, j) == band[i]
            sets.join(place[i[mine]], place[j[mine]])
        root = sets.roots()
        out = np.flatnonzero(root != np.arange(len(root)))
        yield pa.record_batch([pa.array(ids[out]), pa.array(ids[root[out]])], ["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell and node with a link there: one spanning edge and the documents that it is linked to."""
    for table in _cells(_once(batches, ["cluster", "lo", "hi", "node"]), ["cluster", "lo", "hi"], 512):
        cell = _cell_ids(table, ["cluster", "lo", "hi"])
        sig, node, copies = _sigs(table["sig"]), table["node"].to_numpy(), table["copies"].to_numpy()
        runs, bound = shingles(tv.texts(table["text"]))
        own = [np.unique(runs[a:z]) for a, z in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        size = np.array([len(s) for s in own])
        links = np.zeros(len(node), np.int64)
        sets = _Sets(len(node))
        for i, j in _pairs(cell, table["block"].to_numpy(), table["lo"].to_numpy(), table["hi"].to_numpy()):
            ok = likely(sig, i, j)
            i, j = i[ok], j[ok]
            ok = (first_band(sig, i, j) < BANDS) & (np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j]))
            i, j = i[ok], j[ok]
            both = np.fromiter((_common(own[a], own[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))
            ok = 5 * both >= 4 * (size[i] + size[j] - both)  # both / either >= 0.8 in whole numbers
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            sets.join(i, j)
        root = sets.roots()
        out = np.flatnonzero(links)
        yield pa.record_batch([pa.array(node[out]), pa.array(node[root[out]]), pa.array(links[out])], ["node", "root", "links"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, links) of every row: the class's smallest id, and how many other rows it is linked to."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    some = rows.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    ids = staged(rows.select("id", F.when(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.col("digest")).alias("digest")), "ids")
    classes = ids.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    key = classes.select(F.col("digest").alias("_digest"), F.col("first").alias("_first"), "node").hint("shuffle_hash")
    own = (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_first"))
    nodes = staged(some.mapInArrow(tv.freeing(_sign), "id long, digest binary, sig binary").join(key, own).select("node", "sig").dropDuplicates(["node"]), "nodes")

    partitions, many = int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count()
    hot, blocks = _hot_keys(nodes) if many >= HOT else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    buckets = max(partitions, -(-many * BANDS // BUCKET_KEYS))
    dealt = nodes.mapInArrow(tv.freeing(_post(buckets, hot)), "b int, keys binary, nodes binary").groupBy("b").applyInArrow(_deal, MEMBERS)
    if len(hot):
        dealt = dealt.unionByName(nodes.mapInArrow(tv.freeing(_spread(hot, blocks)), MEMBERS))
    # a member goes to a cell for each block of its band: dealt out first, so that no task makes all cells of a band
    dealt = dealt.repartition(partitions, "key", "block").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node")
    sigs = nodes.select(F.col("node").alias("_n"), "sig").hint("shuffle_hash")
    cells = dealt.join(sigs, F.col("node") == F.col("_n")).drop("_n").repartition(partitions, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    clusters = components(cells.mapInArrow(tv.freeing(_link), "u long, v long"))

    size = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK // 2)).cast("int").alias("blocks"))
    member = clusters.join(size, "root").select("node", F.col("root").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    member = member.join(classes, "node").join(nodes, "node")
    member = member.select("node", F.col("digest").alias("_digest"), F.col("first").alias("_first"), "cluster", "blocks", "block", "copies", "sig").hint("shuffle_hash")
    whole = some.join(member, own)
    paired = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "copies", "sig", "text")
    found = staged(paired.repartition(partitions, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node").mapInArrow(tv.freeing(_verify), "node long, root long, links long"), "links")
    final = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    least = final.join(classes, "node").groupBy("root").agg(F.min("first").alias("class_id"))
    info = classes.join(final, "node", "left").join(least, "root", "left").join(links, "node", "left")
    info = info.select(F.col("digest").alias("_digest"), F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return ids.join(info, F.col("digest") == F.col("_digest"), "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def op4_near(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
