"""Rasters, the operator registry, and how an operator is applied."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.cells import clamp, denormalise, normalise
from ..plans.params import Param, checked
from ..plans.world import GridSpec, InvalidLink, InvalidParam, MissingInput, PlanError, PortNotFound, UnknownOperator, World
from .tiles import Kernel, TilePlan

HEIGHT, MASK, COLOUR, POINTS = "height", "mask", "colour", "points"
CHANNELS = ("r", "g", "b", "a")


@dataclass(frozen=True)
class Raster:
    """Cells (j, i and ``v``, or ``r g b a``) of a grid on a world; j is the row, i the column.

    ``source`` is their DataFrame, or a plan by tiles that is yet to become one.
    """

    source: DataFrame | TilePlan
    spec: GridSpec
    world: World
    kind: str = HEIGHT

    @property
    def df(self) -> DataFrame:
        return self.source.frame() if isinstance(self.source, TilePlan) else self.source

    @property
    def spark(self) -> SparkSession:
        return self.source.spark if isinstance(self.source, TilePlan) else self.source.sparkSession

    def around(self, halo: tuple[int, int], f: Kernel, names: list[str], kind: str | None = None) -> Raster:
        """The cells after a kernel that needs ``halo`` cells (across, down) around each, as columns ``names``."""
        plan = self.source if isinstance(self.source, TilePlan) else TilePlan(self.spark, self.spec, self.source)
        return replace(self, source=plan.then(halo, f, names), kind=kind or self.kind)

    @property
    def columns(self) -> tuple[str, ...]:
        return CHANNELS if self.kind == COLOUR else ("v",)

    @property
    def x(self) -> Column:
        return self.spec.origin_m[0] + self.spec.extent_m[0] * (F.col("i") / float(self.spec.width - 1))

    @property
    def y(self) -> Column:
        return self.spec.origin_m[1] + self.spec.extent_m[1] * (F.col("j") / float(self.spec.height - 1))

    def cells(self, v: Column, kind: str | None = None) -> Raster:
        return replace(self, source=self.df.select("j", "i", v.alias("v")), kind=kind or self.kind)

    def colours(self, *rgba: Column) -> Raster:
        return replace(self, source=self.df.select("j", "i", *(c.alias(n) for c, n in zip(rgba, CHANNELS, strict=True))), kind=COLOUR)

    def to(self, kind: str) -> Raster:
        """Heights and masks turn into each other over the world's range, without clamping."""
        if self.kind == kind:
            return self
        low, span = self.world.height_range_m[0], self.world.span
        if (self.kind, kind) == (HEIGHT, MASK):
            return self.cells(normalise(F.col("v"), low, span), MASK)
        if (self.kind, kind) == (MASK, HEIGHT):
            return self.cells(denormalise(F.col("v"), low, span), HEIGHT)
        raise InvalidLink(f"{self.kind} can't feed {kind}")

    def crop(self, i0: int, j0: int, width: int, height: int) -> Raster:
        spec = self.spec.crop(i0, j0, width, height)
        return replace(self, source=self.df.where(F.col("i").between(i0, i0 + width - 1) & F.col("j").between(j0, j0 + height - 1)), spec=spec)

    def channel(self, name: str) -> Raster:
        return replace(self, source=self.df.select("j", "i", F.col(name).alias("v")), kind=MASK)

    def min_max(self) -> DataFrame:
        return self.df.agg(F.min("v").alias("low"), F.max("v").alias("high"))

    def mean(self) -> DataFrame:
        return self.df.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"))

    def with_range(self) -> DataFrame:
        """Cells with the grid's ``low`` and ``high``: one row, so its broadcast has a fixed size."""
        return self.df.crossJoin(F.broadcast(self.min_max()))

    def probe(self, x: float, y: float) -> DataFrame:
        """The bilinear value at one position, from the four cells around it."""
        fx = min(max((x - self.spec.origin_m[0]) / self.spec.cell[0], 0.0), self.spec.width - 1.0)
        fy = min(max((y - self.spec.origin_m[1]) / self.spec.cell[1], 0.0), self.spec.height - 1.0)
        i0, j0 = min(int(fx), self.spec.width - 2), min(int(fy), self.spec.height - 2)
        near = self.df.where(F.col("i").between(i0, i0 + 1) & F.col("j").between(j0, j0 + 1))
        share = (1.0 - F.abs(F.col("i") - fx)) * (1.0 - F.abs(F.col("j") - fy))
        return near.agg(F.sum(F.col("v") * share).alias("v"))


def blank(spark: SparkSession, spec: GridSpec, world: World) -> Raster:
    """Cells of a grid without values; generated in parallel."""
    a, b, c, d = spec.bounds
    wide = c - a
    cells = spark.range(wide * (d - b)).select((F.expr(f"id div {wide}") + b).cast("int").alias("j"), (F.col("id") % wide + a).cast("int").alias("i"))
    return Raster(cells, spec, world)


def join_layers(layers: dict[str, Raster]) -> DataFrame:
    """One row per cell with a column per layer, named after it (or name_r ... of colours); grids must be equal."""
    first = next(iter(layers.values()))
    if any(r.spec != first.spec for r in layers.values()):
        raise PlanError("layers need one grid")
    out = None
    for name, r in layers.items():
        part = r.df.select("j", "i", *(F.col(c).alias(name if r.kind != COLOUR else f"{name}_{c}") for c in r.columns))
        out = part if out is None else out.join(part, ["j", "i"])
    return out


@dataclass(frozen=True)
class Port:
    key: str
    kind: str
    optional: bool = False


@dataclass
class Call:
    """What an operator's function gets: layers joined into one frame, parameters, and the world."""

    spark: SparkSession
    spec: GridSpec
    world: World
    inputs: dict[str, Raster | Any]
    params: dict[str, Any]
    seed: int = 0
    driven: dict[str, Raster] = field(default_factory=dict)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def frame(self, *names: str) -> Raster:
        """All given inputs (those named, else all rasters) and driving masks as columns of one frame."""
        use = {n: r for n, r in self.inputs.items() if isinstance(r, Raster) and (not names or n in names)}
        use |= {f"p_{n}": r for n, r in self.driven.items()}
        if not use:
            return blank(self.spark, self.spec, self.world)
        return Raster(join_layers(use), self.spec, self.world)

    def lone(self) -> Raster | None:
        """The input ``in`` if nothing else is connected: it need not become a frame."""
        others = [r for n, r in self.inputs.items() if n != "in" and isinstance(r, Raster)]
        return None if others or self.driven else self.inputs.get("in")

    def around(self, halo: tuple[int, int], f: Kernel, adds: list[str]) -> Raster:
        """All inputs as columns of one frame, with the columns that a kernel adds."""
        g = self.lone()
        if g is None:
            g = self.frame()
            names = [c for c in g.df.columns if c not in ("j", "i")]
            return g.around(halo, lambda w, a: a | f(w, a), [*names, *adds])
        return g.around(halo, lambda w, a: {"in": a["v"]} | f(w, {"in": a["v"]}), ["in", *adds])

    def has(self, name: str) -> bool:
        return name in self.inputs

    def value(self, key: str) -> Column:
        """A parameter, driven by its mask where one is connected: clamp(value * clamp(mask), low, high)."""
        if key not in self.driven:
            return F.lit(self.params[key])
        return clamp(F.lit(self.params[key]) * clamp(F.col(f"p_{key}")), *self.limits[key])


@dataclass(frozen=True)
class Operator:
    type_id: str
    run: Callable[[Call], dict[str, Any]]
    inputs: tuple[Port, ...] = ()
    outputs: tuple[Port, ...] = ()
    params: tuple[Param, ...] = ()
    reach: Callable[[dict], float] | None = None  # metres; None: the whole world
    version: int = 1
    migrate: Callable[[int, dict], dict] | None = None  # parameters of an older version, brought up to this one


OPERATORS: dict[str, Operator] = {}


def operator(type_id: str, inputs: tuple[Port, ...], outputs: tuple[Port, ...], params: tuple[Param, ...] = (), reach: Callable[[dict], float] | float | None = 0.0):
    def add(run):
        if type_id in OPERATORS:
            raise PlanError(f"{type_id} is registered twice")
        far = (lambda _: reach) if isinstance(reach, (int, float)) else reach
        OPERATORS[type_id] = Operator(type_id, run, inputs, outputs, params, far)
        return run

    return add


def H(key: str = "in", optional: bool = False) -> Port:
    return Port(key, HEIGHT, optional)


def M(key: str = "in", optional: bool = False) -> Port:
    return Port(key, MASK, optional)


def C(key: str = "in", optional: bool = False) -> Port:
    return Port(key, COLOUR, optional)


OUT_H, OUT_M, OUT_C = (H("out"),), (M("out"),), (C("out"),)


def apply(type_id: str, inputs: dict[str, Any] | None = None, params: dict[str, Any] | None = None, *, spark: SparkSession | None = None, spec: GridSpec | None = None, world: World | None = None, seed: int = 0, driven: dict[str, Raster] | None = None) -> dict[str, Any]:
    """All outputs of an operator. Inputs are converted to the kinds of their ports; parameters are checked first."""
    op = OPERATORS.get(type_id)
    if op is None:
        raise UnknownOperator(f"no operator {type_id}")
    given, ports = dict(inputs or {}), {p.key: p for p in op.inputs}
    if unknown := set(given) - set(ports):
        raise PortNotFound(f"{type_id} has no input {', '.join(sorted(unknown))}")
    for p in op.inputs:
        if p.key not in given and not p.optional:
            raise MissingInput(f"{type_id} needs {p.key}")
    values = checked(op.params, params or {})
    drivable = {p.key: (p.low, p.high) for p in op.params if p.drivable}
    masks = {}
    for k, r in (driven or {}).items():
        if k not in drivable:
            raise InvalidParam(f"{type_id}.{k} can't be driven")
        masks[k] = r.to(MASK)
    layers = {k: r.to(ports[k].kind) if isinstance(r, Raster) else r for k, r in given.items()}
    some = next((r for r in layers.values() if isinstance(r, Raster)), None)
    if some is not None:
        spark, spec, world = some.spark, some.spec, some.world
    if spark is None or spec is None or world is None:
        raise PlanError(f"{type_id} needs a session, a grid and a world")
    return op.run(Call(spark, spec, world, layers, values, seed, masks, drivable))


def ROW() -> WindowSpec:
    return Window.partitionBy("j").orderBy("i")


def COLUMN() -> WindowSpec:
    return Window.partitionBy("i").orderBy("j")
