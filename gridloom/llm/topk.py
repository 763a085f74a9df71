"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks; in each block every dimension has a list
sorted by value. A query goes down all lists at once, from the end that its
sign favours, scores each row it meets for the first time exactly, and stops
when the bound (the query times the values now reached) cannot beat its k-th
score. Blocks of queries meet blocks of candidates in an equi-join on the
block number, so no list, and no result but k rows per query and block, is
larger than a block. The join is sorted and never broadcast: a packed block
looks small by its file but not in memory, and a block of queries is dealt to
every block of candidates.

What a query has found elsewhere counts everywhere: each block of queries
first meets one block of candidates, whose k-th scores are floors for all
other blocks. A block whose bound is below the floor at the top of its lists
is left at once, the others stop as soon as their bound falls below it.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part; shorter vectors count as filled with zeros; ties go
to the smaller id; rows with the query's own id are no candidates; repeated
candidate rows count each, repeated equal queries once; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .scratch import small_batches, staged

BLOCK = 4096
QUERY_BLOCK = 512
FIRST_DEPTH = 64
NO_FLOOR = -(1 << 62)


def quantised(vector: Column, scale: float = 64) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


class SortedLists:
    """Rows of a block with, per dimension, their order by value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by], rows[by]
        order = np.argsort(self.rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.rows, order, 0)
        self.rank = np.empty(order.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(rows), dtype=np.int32)[:, None], 0)
        self.size = max(1, rows.shape[1]) * int(np.abs(rows).max(initial=0))

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best rows of every query, best first; none below a query's ``floor``.

        All queries go down their lists together, in rounds of growing depth;
        a query whose bound can't beat its k-th score or its floor leaves.
        """
        n = len(self.ids)
        # products as floats where every sum is a whole number that they hold exactly
        largest = self.size * int(np.abs(queries).max(initial=0))
        kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
        rows, asked = self.rows.astype(kind), queries.astype(kind)
        up = queries >= 0
        least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        found: list = [(self.ids[:0], np.zeros(0, np.int64))] * len(queries)
        floor = np.full(len(queries), least) if floor is None else floor.astype(kind)
        best = np.where(up, self.sorted[-1], self.sorted[0]) * queries
        active, depth = np.flatnonzero(best.sum(1) >= floor), min(FIRST_DEPTH, n)
        while len(active):
            from_top, from_bottom = (n - 1 - self.rank < depth), (self.rank < depth)
            down = up[active]
            met = (down.astype(np.float32) @ from_top.T.astype(np.float32) + (~down).astype(np.float32) @ from_bottom.T.astype(np.float32)) > 0
            met &= self.ids != own[active, None]
            some = np.flatnonzero(met.any(0))
            score = np.where(met[:, some], asked[active] @ rows[some].T, least)
            edge = np.where(down, self.sorted[n - depth], self.sorted[depth - 1])
            bound = (edge * queries[active]).sum(1)
            have = met.sum(1) >= k
            kth = np.partition(score, len(some) - k, axis=1)[:, len(some) - k] if len(some) >= k else np.full(len(active), least)
            done = (have & (kth > bound)) | (floor[active] > bound) | (depth >= n)
            for i in np.flatnonzero(done):
                best = np.flatnonzero((score[i] >= max(kth[i], floor[active[i]])) & met[i, some])
                best = best[np.lexsort((best, -score[i, best]))[:k]]  # rows are in the order of their ids
                found[active[i]] = self.ids[some[best]], score[i, best].astype(np.int64)
            active, depth = active[~done], min(n, depth * 8)
        return found


def _matrix(rows: list[list[int]]) -> np.ndarray:
    width = max(map(len, rows), default=0)
    return np.array([r + [0] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width)


def _packed(key, table):
    rows = _matrix(table["v"].to_pylist())
    ids = table["id"].to_numpy()
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "width": pa.array([rows.shape[1]], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "rows": pa.array([rows.astype("<i8").tobytes()], pa.binary())})


PACKED = "block int, width int, ids binary, rows binary"


def _unpacked(width: int, ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(rows, "<i8").reshape(len(i), width)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k best rows of ``vectors`` for every row of ``queries``; both hold integer vectors."""
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).distinct()
    small_batches(vectors.sparkSession)  # a row below holds two blocks
    n, m = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    # packed once, as both meetings read them
    lists = staged(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_packed, PACKED), "lists")
    wanted = staged(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")).groupBy("block").applyInArrow(_packed, PACKED), "queries")
    wanted = wanted.select(F.col("block").alias("q_block"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                ids, rows = _unpacked(r["width"], r["ids"], r["rows"])
                q_ids, q_rows = _unpacked(r["q_width"], r["q_ids"], r["q_rows"])
                width = max(rows.shape[1], q_rows.shape[1])
                if at != (r["block"], width):  # rows come sorted by block
                    at, lists = (r["block"], width), SortedLists(ids, np.pad(rows, ((0, 0), (0, width - rows.shape[1]))))
                q_rows = np.pad(q_rows, ((0, 0), (0, width - q_rows.shape[1])))
                floor = None
                if r["floor_ids"]:
                    known = dict(zip(r["floor_ids"], r["floors"], strict=True))
                    floor = np.array([known.get(q, NO_FLOOR) for q in q_ids.tolist()], np.int64)
                found = lists.top(q_rows, q_ids, k, floor)
                size = [len(f[0]) for f in found]
                yield pa.record_batch([pa.array(np.repeat(q_ids, size)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "id", "score"])

    meet = lambda asked: asked.join(lists.hint("merge"), "block").select("block", "q_width", "q_ids", "q_rows", "floor_ids", "floors", "width", "ids", "rows").mapInArrow(tv.freeing(run), "query_id long, id long, score long")
    none = F.expr("cast(null as array<bigint>)")
    home = F.pmod(F.col("q_block"), F.lit(blocks)).cast("int")
    near = staged(meet(wanted.select("*", home.alias("block"), none.alias("floor_ids"), none.alias("floors"))), "near")
    floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = floors.groupBy(F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("q_block")).agg(F.collect_list(F.struct("query_id", "floor")).alias("f"))
    floors = floors.select("q_block", F.col("f.query_id").alias("floor_ids"), F.col("f.floor").alias("floors"))  # at most a block's queries
    others = wanted.join(floors.hint("merge"), "q_block", "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).where(F.col("block") != home)
    local = near.unionByName(meet(others)) if blocks > 1 else near
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("embedding"))
    return search(vectors, vectors.where("vec_id % 20 = 0"), 20)
