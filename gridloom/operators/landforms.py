"""Landforms: profiles in columns over distances, shaped by a few fields of noise.

Noise comes from one Arrow pass over all fields that need the same columns;
everything else is column expressions, so Catalyst fuses it with its
neighbours. The profiles are this library's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import noise
from ..functions.cells import clamp, lerp, smoothstep
from ..plans.params import choice, number, whole
from .base import OUT_H, Call, H, Raster, operator
from .sources import POSITION

SEED = (whole("seed", 0),)


def _tall(default: float):
    return number("height_m", default, 0, 20000, drivable=True)


@dataclass(frozen=True)
class Field:
    """Noise of some octaves at the position (u, v), under a seed of its own."""

    u: Column
    v: Column
    octaves: int
    part: int


def with_fields(g: Raster, seed: int, fields: dict[str, Field]) -> Raster:
    """The frame with a column for each field, all from one pass."""
    kept = list(g.df.columns)
    names, wanted = [*kept, *fields], [(f.octaves, noise.derive(seed, f.part)) for f in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [c.to_numpy() for c in batch.columns[len(kept) :]]
            with np.errstate(over="ignore"):
                made = [pa.array(noise.fbm(at[2 * k], at[2 * k + 1], own, octaves)) for k, (octaves, own) in enumerate(wanted)]
            yield pa.record_batch([*batch.columns[: len(kept)], *made], names)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.df.schema.fields)
    source = g.df.select(*kept, *(c.cast("double").alias(f"_{n}{k}") for n, f in fields.items() for k, c in (("u", f.u), ("v", f.v))))
    return Raster(source.mapInArrow(run, types + "".join(f", {n} double" for n in fields)), g.spec, g.world)


class _Site:
    """The call's frame with positions ``x`` and ``y``, and ``dx`` and ``dy`` from the landform's middle."""

    def __init__(self, c: Call):
        g = c.frame()
        middle = [s / 2 + c.params.get(k, 0.0) for s, k in zip(c.world.size_m, ("pos_x_m", "pos_y_m"), strict=True)]
        df = g.df.withColumns({"x": g.x, "y": g.y}).withColumns({"dx": F.col("x") - middle[0], "dy": F.col("y") - middle[1]})
        self.c, self.g = c, Raster(df, g.spec, g.world)

    def add(self, **columns: Column) -> None:
        self.g = Raster(self.g.df.withColumns(columns), self.g.spec, self.g.world)

    def turned(self, angle_deg: float, dx: str = "dx", dy: str = "dy") -> None:
        """``u`` along a direction (0 degrees is +x, 90 degrees is +y) and ``w`` across it."""
        cos, sin = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
        self.add(u=F.col(dx) * cos + F.col(dy) * sin, w=F.col(dy) * cos - F.col(dx) * sin)

    def noise(self, **fields: Field) -> None:
        self.g = with_fields(self.g, self.c.seed, fields)

    def near(self, size: float, octaves: int, part: int) -> Field:
        """Noise at the place itself, in features of about ``size`` metres."""
        return Field(F.col("x") / size, F.col("y") / size, octaves, part)

    def out(self, ground: str, height: str, shape: Column, more: Column | float = 0.0) -> dict:
        """The ground (the input where there is one) with ``shape`` times the height on it."""
        base = F.col("in") if self.c.has("in") else F.lit(self.c.params[ground])
        return {"out": Raster(self.g.df, self.c.spec, self.c.world).cells(base + self.c.value(height) * shape + more)}


def _crest(n: Column) -> Column:
    """1 where noise crosses 0, falling to both sides: a crease line."""
    return clamp(1.0 - 1.5 * F.abs(n))


@operator("terrain.mountain", (), OUT_H, (number("radius_m", 3500, 1), _tall(1800), number("base_m", 0), choice("style", "alpine", "rounded"), number("ridges", 0.6, 0, 1), number("roughness", 0.5, 0, 1), *POSITION, *SEED))
def mountain(c: Call):
    """A wavering footprint; hollow flanks (alpine) or a dome (rounded); crests that run down from the summit, none on it."""
    p, s = c.params, _Site(c)
    size, alpine = p["radius_m"], p["style"] == "alpine"
    s.noise(wave=s.near(0.8 * size, 3, 11))
    far = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    s.add(far=F.greatest(far, F.lit(1e-6)), r=far / size * (1.0 + 0.3 * F.col("wave")))
    ring = (2.0 + F.col("r")) / F.col("far")
    s.noise(spokes=Field(F.col("dx") * ring, F.col("dy") * ring, 4 if alpine else 2, 12), plain=s.near(0.4 * size, 5 if alpine else 3, 13), fine=s.near(size / 8, 5, 14))
    s.add(t=clamp(1.0 - F.col("r")))
    t = F.col("t")
    body = F.pow(t, F.lit(1.7)) if alpine else t * t * (3.0 - 2.0 * t)
    cut = 1.0 - p["ridges"] * (1.0 - t * t) * (1.0 - _crest(0.6 * F.col("spokes") + 0.4 * F.col("plain")))
    return s.out("base_m", "height_m", F.greatest(body * cut + 0.05 * p["roughness"] * t * F.col("fine"), F.lit(0.0)))


@operator("terrain.ridge", (), OUT_H, (number("angle_deg", 30), number("length_m", 6000, 1), number("width_m", 1500, 1), _tall(1200), number("base_m", 0), number("meander_m", 500, 0), number("ridges", 0.5, 0, 1), number("roughness", 0.5, 0, 1), *POSITION, *SEED))
def ridge(c: Call):
    """A winding line whose sides fall with the power 1.6 of the distance; its crest sags, spurs run down its sides."""
    p, s = c.params, _Site(c)
    length, width, zero = p["length_m"], p["width_m"], F.lit(0.0)
    s.turned(p["angle_deg"])
    s.noise(bend=Field(F.col("u") / (0.5 * length), zero, 3, 21), sag=Field(F.col("u") / (0.3 * length), zero + 7.0, 3, 22), fine=s.near(width / 6, 5, 24))
    s.add(w=F.col("w") + p["meander_m"] * F.col("bend"), past=F.greatest(F.abs(F.col("u")) - 0.5 * length, zero))
    s.noise(spurs=Field(F.col("u") / (0.4 * width), F.col("w") / (2.0 * width), 4, 23))
    s.add(d=F.least(F.sqrt(F.col("w") * F.col("w") + F.col("past") * F.col("past")) / width, F.lit(1.0)))
    d = F.col("d")
    crest = 1.0 - 0.25 * F.abs(F.col("sag"))
    cut = 1.0 - p["ridges"] * d * (1.0 - _crest(F.col("spurs")))
    return s.out("base_m", "height_m", F.greatest(F.pow(1.0 - d, F.lit(1.6)) * crest * cut + 0.05 * p["roughness"] * (1.0 - d) * F.col("fine"), zero))


@operator("terrain.canyon", (H(optional=True),), OUT_H, (number("angle_deg", 0), number("depth_m", 450, 0, 20000, drivable=True), number("width_m", 1800, 1), number("floor_width_m", 300, 0), whole("steps", 3, 0, 12), number("meander_m", 900, 0), number("meander_size_m", 3000, 1), number("roughness", 0.5, 0, 1), number("surface_m", 800), *POSITION, *SEED))
def canyon(c: Call):
    """A winding cut with a flat floor; its walls are smooth, or ``steps`` ledges."""
    p, s = c.params, _Site(c)
    half = 0.5 * p["width_m"]
    floor = min(0.5 * p["floor_width_m"], 0.95 * half)
    s.turned(p["angle_deg"])
    s.noise(bend=Field(F.col("u") / p["meander_size_m"], F.lit(0.0), 3, 31), ragged=s.near(half, 4, 32))
    away = F.abs(F.col("w") - p["meander_m"] * F.col("bend")) + 0.3 * p["roughness"] * (half - floor) * F.col("ragged")
    s.add(wall=smoothstep(floor, half, away))
    wall = F.col("wall")
    if p["steps"] > 0:
        whole_steps = F.floor(wall * p["steps"])
        wall = lerp(wall, (whole_steps + smoothstep(0.6, 1.0, wall * p["steps"] - whole_steps)) / p["steps"], 0.75)
    return s.out("surface_m", "depth_m", wall - 1.0)


@operator("terrain.crater", (H(optional=True),), OUT_H, (number("radius_m", 1200, 1), number("depth_m", 300, 0, 20000, drivable=True), number("rim_height_m", 120, 0), number("rim_width", 0.6, 0.05, 4), number("floor", 0.3, 0, 0.95), number("roughness", 0.3, 0, 1), number("base_m", 0), *POSITION, *SEED))
def crater(c: Call):
    """A flat floor, a bowl up to the rim, and a rim that fades outwards like a bell."""
    p, s = c.params, _Site(c)
    size, rough = p["radius_m"], p["roughness"]
    s.noise(wave=s.near(0.6 * size, 3, 41), fine=s.near(size / 6, 4, 42))
    s.add(r=F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / size * (1.0 + 0.12 * rough * F.col("wave")))
    r, edge = F.col("r"), p["rim_width"]
    bowl = smoothstep(p["floor"], 1.0, r)
    out = (r - 1.0) / edge
    bell = F.when(r < 1.0, bowl).otherwise(F.exp(-2.0 * out * out))
    grain = 0.08 * rough * F.col("fine") * (1.0 - smoothstep(1.0, 1.0 + 2.0 * edge, r))
    return s.out("base_m", "depth_m", F.when(r < 1.0, bowl - 1.0).otherwise(0.0) + grain, p["rim_height_m"] * (bell + grain))


@operator("terrain.plateau", (), OUT_H, (number("radius_m", 2200, 1), _tall(500), number("base_m", 0), number("cliff_m", 150, 0), number("talus_m", 700, 0), number("talus_height", 0.35, 0, 1), number("edge_m", 600, 0), number("roughness", 0.3, 0, 1), *POSITION, *SEED))
def plateau(c: Call):
    """A top with a wavering edge, a cliff down to ``talus_height`` of it, and a slope of rubble that runs out."""
    p, s = c.params, _Site(c)
    cliff, talus, foot = max(p["cliff_m"], 1e-3), max(p["talus_m"], 1e-3), p["talus_height"]
    s.noise(wave=s.near(max(0.4 * p["radius_m"], 2.0 * p["edge_m"]), 4, 51), fine=s.near(p["radius_m"] / 4, 4, 52))
    s.add(d=F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) - p["radius_m"] + p["edge_m"] * F.col("wave"))
    d = F.col("d")
    top = 1.0 + 0.04 * p["roughness"] * F.col("fine") * (1.0 - smoothstep(-0.1 * p["radius_m"], 0.0, d))
    face = lerp(foot, 1.0, 0.5 + 0.5 * F.cos(math.pi * clamp(d / cliff)))
    rest = clamp(1.0 - (d - cliff) / talus)
    return s.out("base_m", "height_m", F.when(d <= 0, top).when(d < cliff, face).otherwise(foot * rest * rest))


@operator("terrain.dunes", (), OUT_H, (number("angle_deg", 0), number("wavelength_m", 450, 1), number("height_m", 35, 0, 2000, drivable=True), number("base_m", 0), number("asymmetry", 0.75, 0.05, 0.95), number("sinuosity_m", 220, 0), number("variation", 0.5, 0, 1), *SEED))
def dunes(c: Call):
    """Waves across the wind: a long rise to ``asymmetry`` of the wavelength, a short steep fall; crests wander and vary."""
    p, s = c.params, _Site(c)
    wave, lean = p["wavelength_m"], p["asymmetry"]
    s.turned(p["angle_deg"], "x", "y")
    s.noise(bend=Field(F.col("w") / (2.0 * wave), F.col("u") / (5.0 * wave), 3, 61), swell=s.near(5.0 * wave, 3, 62))
    phase = (F.col("u") + p["sinuosity_m"] * F.col("bend")) / wave
    s.add(f=phase - F.floor(phase))
    f = F.col("f")
    rise, fall = 0.5 - 0.5 * F.cos(math.pi * f / lean), F.pow((1.0 - f) / (1.0 - lean), F.lit(1.5))
    return s.out("base_m", "height_m", F.when(f < lean, rise).otherwise(fall) * (1.0 - p["variation"] * clamp(0.5 + 0.5 * F.col("swell"))))
