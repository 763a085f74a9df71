"""The physical world, grids of samples on it, windows, tiles and simulation grids."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

MAX_SIDE = 16_384
MAX_BUILD_SIDE = 65_537
TILED_ABOVE = 4_097


class PlanError(ValueError):
    """A mistake that is found before anything is computed; each kind has a class of its own."""


class UnknownOperator(PlanError):
    pass


class NodeNotFound(PlanError):
    pass


class PortNotFound(PlanError):
    pass


class InvalidLink(PlanError):
    pass


class Cycle(InvalidLink):
    pass


class MissingInput(PlanError):
    pass


class InvalidParam(PlanError):
    pass


class NodeFailed(PlanError):
    pass


class InvalidResolution(PlanError):
    pass


class Cancelled(PlanError):
    pass


class ProjectError(PlanError):
    pass


class PresetError(PlanError):
    pass


class ImageError(PlanError):
    pass


@dataclass(frozen=True)
class World:
    """A rectangle in metres, a range of heights and a seed."""

    size_m: tuple[float, float] = (8192.0, 8192.0)
    height_range_m: tuple[float, float] = (0.0, 2000.0)
    seed: int = 12345

    def __post_init__(self):
        low, high = self.height_range_m
        if not (self.size_m[0] > 0 and self.size_m[1] > 0 and high > low and all(map(math.isfinite, (*self.size_m, low, high)))):
            raise PlanError("a world needs positive sizes and a rising range of heights")

    @property
    def span(self) -> float:
        return (self.height_range_m[1] - self.height_range_m[0]) or 1.0


@dataclass(frozen=True)
class GridSpec:
    """Samples on the vertices of a grid: sample 0 on the origin, the last one on the far edge.

    A window (``i0``, ``j0`` and its width and height) keeps the numbers of
    its whole grid, so tiles agree bit for bit.
    """

    width: int
    height: int
    extent_m: tuple[float, float]
    origin_m: tuple[float, float] = (0.0, 0.0)
    window: tuple[int, int, int, int] | None = None

    def __post_init__(self):
        if not (2 <= self.width <= MAX_BUILD_SIDE and 2 <= self.height <= MAX_BUILD_SIDE):
            raise InvalidResolution(f"a grid has 2 to {MAX_BUILD_SIDE} samples a side")
        if self.window:
            i0, j0, w, h = self.window
            if w < 2 or h < 2 or i0 < 0 or j0 < 0 or i0 + w > self.width or j0 + h > self.height:
                raise InvalidResolution("a window has at least 2 x 2 samples of its grid")
            if (i0, j0, w, h) == (0, 0, self.width, self.height):
                object.__setattr__(self, "window", None)

    @classmethod
    def over(cls, world: World, resolution: int) -> GridSpec:
        return cls(resolution, resolution, world.size_m)

    @property
    def cell(self) -> tuple[float, float]:
        return self.extent_m[0] / (self.width - 1), self.extent_m[1] / (self.height - 1)

    @property
    def bounds(self) -> tuple[int, int, int, int]:
        """First column and row, and one past the last."""
        i0, j0, w, h = self.window or (0, 0, self.width, self.height)
        return i0, j0, i0 + w, j0 + h

    def x(self, i: int) -> float:
        return self.origin_m[0] + self.extent_m[0] * (i / (self.width - 1))

    def y(self, j: int) -> float:
        return self.origin_m[1] + self.extent_m[1] * (j / (self.height - 1))

    def crop(self, i0: int, j0: int, width: int, height: int) -> GridSpec:
        a, b, c, d = self.bounds
        if i0 < a or j0 < b or i0 + width > c or j0 + height > d:
            raise PlanError("a crop lies inside its grid")
        return replace(self, window=(i0, j0, width, height))

    def simulation(self, detail_m: float) -> GridSpec:
        """The grid of about ``detail_m`` metres a cell, at most ``MAX_SIDE`` a side; this one if its cells are at least twice as large."""
        if min(self.cell) >= 2 * detail_m:
            return self
        w, h = (min(max(2, round(e / detail_m) + 1), MAX_SIDE) for e in self.extent_m)
        return GridSpec(w, h, self.extent_m, self.origin_m)


def runs(length: int, size: int) -> list[tuple[int, int]]:
    """[start, stop) pieces of ``size``; a rest below 2 joins the last one."""
    starts = list(range(0, length, size)) or [0]
    if len(starts) > 1 and length - starts[-1] < 2:
        starts.pop()
    return list(zip(starts, [*starts[1:], length], strict=True))


def tiles(spec: GridSpec, size: int) -> list[tuple[int, int, int, int]]:
    """Cores (i0, j0, i1, j1) that hold every sample once."""
    return [(a, b, c, d) for b, d in runs(spec.height, size) for a, c in runs(spec.width, size)]


def halo(core: tuple[int, int, int, int], margin: int, spec: GridSpec) -> tuple[int, int, int, int]:
    """The core grown by ``margin`` samples, clipped to the world."""
    a, b, c, d = core
    return max(0, a - margin), max(0, b - margin), min(spec.width, c + margin), min(spec.height, d + margin)


def tiles_even(length: int, size: int) -> bool:
    """Whether output tiles that share their edges have one size."""
    return (length - 1) % (size - 1) == 0
