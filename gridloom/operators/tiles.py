"""Neighbourhood work by tiles: chains of array kernels over square tiles with a halo.

A plan begins with positions alone (sources), which every task makes for its
tile without any shuffle, or with a frame of cells, which is dealt to tiles
once: a cell goes to its own tile and to those whose halo it lies in. Kernels
that follow are put after it and widen the halo, so a chain of them costs
that one shuffle, whatever its length. A plan becomes a DataFrame when its
columns are first asked for.

A kernel sees the arrays of a window that ends at the grid's border or goes
on beyond its tile; it treats the window's edge as the grid's border. What
that spoils inside the grid lies in the halo and is cut off. Results don't
depend on the size of the tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.world import GridSpec

TILE = 256
MAX_HALO = 2 * TILE
Arrays = dict[str, np.ndarray]


@dataclass(frozen=True)
class Window:
    """Columns i0 to i1 and rows j0 to j1 (ends exclusive) of a grid."""

    spec: GridSpec
    i0: int
    j0: int
    i1: int
    j1: int

    @property
    def cell(self) -> tuple[float, float]:
        return self.spec.cell

    @property
    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """x and y of every cell, in metres."""
        s = self.spec
        x = s.origin_m[0] + s.extent_m[0] * (np.arange(self.i0, self.i1) / (s.width - 1))
        y = s.origin_m[1] + s.extent_m[1] * (np.arange(self.j0, self.j1) / (s.height - 1))
        return np.broadcast_to(x, (len(y), len(x))), np.broadcast_to(y[:, None], (len(y), len(x)))

    def grown(self, hx: int, hy: int) -> Window:
        a, b, c, d = self.spec.bounds
        return Window(self.spec, max(self.i0 - hx, a), max(self.j0 - hy, b), min(self.i1 + hx, c), min(self.j1 + hy, d))

    def cut(self, inner: Window, array: np.ndarray) -> np.ndarray:
        return array[inner.j0 - self.j0 : inner.j1 - self.j0, inner.i0 - self.i0 : inner.i1 - self.i0]


Kernel = Callable[[Window, Arrays], Arrays]


def _tile(spec: GridSpec, ti: int, tj: int) -> Window:
    a, b, c, d = spec.bounds
    return Window(spec, max(a, ti * TILE), max(b, tj * TILE), min(c, (ti + 1) * TILE), min(d, (tj + 1) * TILE))


def _worked(core: Window, steps: list[tuple[int, int, Kernel]], arrays: Arrays, names: list[str]) -> pa.Table:
    """The core's cells after all steps; ``arrays`` reach as far as the halos of all of them."""
    left = [(sum(s[0] for s in steps[k:]), sum(s[1] for s in steps[k:])) for k in range(len(steps) + 1)]
    window = core.grown(*left[0])
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for k, (_, _, f) in enumerate(steps):
            arrays = f(window, arrays)
            inner = core.grown(*left[k + 1])
            arrays, window = {n: window.cut(inner, a) for n, a in arrays.items()}, inner
    j, i = np.mgrid[core.j0 : core.j1, core.i0 : core.i1]
    return pa.table([pa.array(j.ravel().astype(np.int32)), pa.array(i.ravel().astype(np.int32)), *(pa.array(np.ascontiguousarray(arrays[n], np.float64).ravel()) for n in names)], ["j", "i", *names])


class TilePlan:
    """Kernels to be run, on ``base`` (j, i and columns of numbers) or on positions alone."""

    def __init__(self, spark: SparkSession, spec: GridSpec, base: DataFrame | None, steps: tuple = (), names: tuple[str, ...] = ()):
        self.spark, self.spec, self.base, self.steps = spark, spec, base, steps
        self.names = names or tuple(c for c in base.columns if c not in ("j", "i"))
        self._frame: DataFrame | None = None

    @property
    def halo(self) -> tuple[int, int]:
        return sum(s[0] for s in self.steps), sum(s[1] for s in self.steps)

    def then(self, halo: tuple[int, int], f: Kernel, names: list[str]) -> TilePlan:
        whole = max(h + more for h, more in zip(self.halo, halo, strict=True))
        if self._frame is not None or whole > MAX_HALO:  # known already, or too wide together: a new deal
            return TilePlan(self.spark, self.spec, self.frame()).then(halo, f, names) if self.steps else TilePlan(self.spark, self.spec, self.base, ((*halo, f),), tuple(names))
        return TilePlan(self.spark, self.spec, self.base, (*self.steps, (*halo, f)), tuple(names))

    def frame(self) -> DataFrame:
        if self._frame is None:
            self._frame = self._made() if self.base is None else self._dealt() if self.steps else self.base
        return self._frame

    def _schema(self) -> str:
        return "j int, i int" + "".join(f", `{n}` double" for n in self.names)

    def _tiles(self) -> tuple[int, int, int, int]:
        """First and last tile, across and down."""
        a, b, c, d = self.spec.bounds
        return a // TILE, (c - 1) // TILE, b // TILE, (d - 1) // TILE

    def _made(self) -> DataFrame:
        spec, steps, names = self.spec, list(self.steps), list(self.names)
        a, z, top, end = self._tiles()
        wide = z - a + 1
        count = wide * (end - top + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from _worked(_tile(spec, a + k % wide, top + k // wide), steps, {}, names).to_batches()

        return self.spark.range(0, count, 1, min(count, 4 * self.spark.sparkContext.defaultParallelism)).mapInArrow(run, self._schema())

    def _dealt(self) -> DataFrame:
        spec, steps, names, have = self.spec, list(self.steps), list(self.names), [c for c in self.base.columns if c not in ("j", "i")]
        hx, hy = self.halo
        a, z, top, end = self._tiles()
        over = lambda v, h, first, last: F.explode(F.sequence(F.greatest(F.floor((F.col(v) - h) / TILE), F.lit(first)).cast("int"), F.least(F.floor((F.col(v) + h) / TILE), F.lit(last)).cast("int")))
        cells = self.base.select("j", "i", *(F.col(c).cast("double").alias(c) for c in have))
        dealt = cells.withColumn("ti", over("i", hx, a, z)).withColumn("tj", over("j", hy, top, end))

        def run(key, table):
            core = _tile(spec, key[0].as_py(), key[1].as_py())
            window = core.grown(hx, hy)
            j, i = table["j"].to_numpy() - window.j0, table["i"].to_numpy() - window.i0
            arrays = {}
            for c in have:
                arrays[c] = np.full((window.j1 - window.j0, window.i1 - window.i0), np.nan)
                arrays[c][j, i] = table[c].to_numpy()
            return _worked(core, steps, arrays, names)

        return dealt.groupBy("ti", "tj").applyInArrow(run, self._schema())
