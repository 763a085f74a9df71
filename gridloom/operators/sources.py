"""Sources: analytic shapes, noise, and grids from tables or decoded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import noise
from ..functions.cells import clamp, col, smoothstep
from ..plans.params import Param, choice, flag, number, whole
from ..plans.world import GridSpec, ImageError, InvalidParam
from .base import COLOUR, HEIGHT, OUT_H, Call, H, Raster, blank, operator
from .tiles import TilePlan

HEIGHT_PARAMS = (number("height_m", 1000, 0, 20000, drivable=True), number("base_m", 0, -20000, 20000))
POSITION = (number("pos_x_m", 0), number("pos_y_m", 0))


@operator("primitive.constant", (), OUT_H, (number("height_m", 0),))
def constant(c: Call):
    return {"out": c.frame().cells(F.lit(c.params["height_m"]))}


@operator("primitive.gradient", (), OUT_H, (choice("mode", "linear", "radial"), number("angle_deg", 0), number("length_m", 8192, 1e-3), choice("profile", "linear", "smooth"), *HEIGHT_PARAMS, *POSITION))
def ramp(c: Call):
    p, g = c.params, c.frame()
    dx, dy = _centred(g, p)
    if p["mode"] == "radial":
        t = F.sqrt(dx * dx + dy * dy) / p["length_m"]
    else:
        a = np.deg2rad(p["angle_deg"])
        t = (dx * float(np.cos(a)) + dy * float(np.sin(a))) / p["length_m"] + 0.5
    t = clamp(t)
    return {"out": g.cells(p["base_m"] + c.value("height_m") * (smoothstep(0.0, 1.0, t) if p["profile"] == "smooth" else t))}


def _distance(g: Raster, p: dict) -> Column:
    dx, dy = _centred(g, p)
    return F.sqrt(dx * dx + dy * dy)


@operator("primitive.cone", (), OUT_H, (number("radius_m", 2500, 1e-3), number("height_m", 1500, 0, 20000, drivable=True), number("base_m", 0), *POSITION))
def cone(c: Call):
    g = c.frame()
    return {"out": g.cells(c.params["base_m"] + c.value("height_m") * F.greatest(1.0 - _distance(g, c.params) / c.params["radius_m"], F.lit(0.0)))}


@operator("primitive.hemisphere", (), OUT_H, (number("radius_m", 2500, 1e-3), number("height_m", 1500, 0, 20000, drivable=True), number("base_m", 0), *POSITION))
def hemisphere(c: Call):
    g = c.frame()
    d = _distance(g, c.params) / c.params["radius_m"]
    return {"out": g.cells(c.params["base_m"] + c.value("height_m") * F.sqrt(F.greatest(1.0 - d * d, F.lit(0.0))))}


def _polygon(u: Column, v: Column, corners: list[tuple[float, float]]) -> Column:
    """Signed distance to a convex polygon whose corners turn counter-clockwise: below 0 inside."""
    lines, segments = [], []
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        ex, ey = bx - ax, by - ay
        long = float(np.hypot(ex, ey))
        px, py = u - ax, v - ay
        lines.append(px * (ey / long) - py * (ex / long))
        t = clamp((px * ex + py * ey) / (long * long))
        qx, qy = px - t * ex, py - t * ey
        segments.append(F.sqrt(qx * qx + qy * qy))
    outside = F.greatest(*lines)
    return F.when(outside <= 0, outside).otherwise(F.least(*segments))


def _centred(g: Raster, p: dict) -> tuple[Column, Column]:
    """Position from the operator's centre, itself given from the middle of the world."""
    return g.x - (g.world.size_m[0] / 2 + p["pos_x_m"]), g.y - (g.world.size_m[1] / 2 + p["pos_y_m"])


@operator("primitive.shape", (), OUT_H, (choice("shape", "circle", "square", "diamond", "hexagon", "triangle"), number("size_m", 2500, 1e-3), number("falloff_m", 800, 0), number("rotation_deg", 0), *HEIGHT_PARAMS, *POSITION))
def shape(c: Call):
    """1 - smoothstep(0, falloff, distance outside the shape); a hard edge without falloff."""
    p, g = c.params, c.frame()
    a = np.deg2rad(p["rotation_deg"])
    dx, dy = _centred(g, p)
    u, v = dx * float(np.cos(a)) + dy * float(np.sin(a)), dy * float(np.cos(a)) - dx * float(np.sin(a))
    size = p["size_m"]
    if p["shape"] == "circle":
        d = F.sqrt(u * u + v * v) - size
    elif p["shape"] == "square":
        ex, ey = F.abs(u) - size, F.abs(v) - size
        ox, oy = F.greatest(ex, F.lit(0.0)), F.greatest(ey, F.lit(0.0))
        d = F.sqrt(ox * ox + oy * oy) + F.least(F.greatest(ex, ey), F.lit(0.0))
    elif p["shape"] == "diamond":
        d = (F.abs(u) + F.abs(v) - size) * float(np.sqrt(0.5))
    elif p["shape"] == "hexagon":
        w = size / float(np.sqrt(3))
        d = _polygon(u, v, [(2 * w, 0), (w, size), (-w, size), (-2 * w, 0), (-w, -size), (w, -size)])
    else:
        w = size / float(np.sqrt(3))
        d = _polygon(u, v, [(0, -2 * w), (size, w), (-size, w)])
    hard = F.when(d <= 0, 1.0).otherwise(0.0)
    return {"out": g.cells(p["base_m"] + c.value("height_m") * (1.0 - smoothstep(0.0, p["falloff_m"], d) if p["falloff_m"] > 0 else hard))}


# Noise: position-wise kernels on Arrow batches.

FIELD = (number("feature_size_m", 3000, 1e-3), *HEIGHT_PARAMS, number("offset_x_m", 0), number("offset_y_m", 0), whole("seed", 0))


def fractal(octaves: int) -> tuple:
    return (choice("basis", "perlin", "simplex", "value"), whole("octaves", octaves, 1, 16), number("lacunarity", 2, 1, 8), number("gain", 0.5, 0, 1))


def kernel(g: Raster, f, names: list[str], extra: list[str] = ()) -> Raster:
    """Cells with columns ``names`` computed by ``f(x, y)`` on arrays; other columns in ``extra`` are kept."""
    columns = ["j", "i", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(columns)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                out = f(batch.column(n).to_numpy(), batch.column(n + 1).to_numpy())
            yield pa.record_batch([*(batch.column(k) for k in range(n)), *(pa.array(np.asarray(o, np.float64)) for o in out)], [*columns, *names])

    schema = "j int, i int" + "".join(f", `{e}` double" for e in extra) + "".join(f", `{n}` double" for n in names)
    source = g.df.select("j", "i", *(F.col(e).cast("double").alias(e) for e in extra), g.x.alias("_x"), g.y.alias("_y"))
    return Raster(source.mapInArrow(run, schema), g.spec, g.world)


def _field(c: Call, f) -> dict:
    p, seed = c.params, c.seed
    at = lambda x, y: f((x + p["offset_x_m"]) / p["feature_size_m"], (y + p["offset_y_m"]) / p["feature_size_m"], seed)
    if not c.driven:
        made = TilePlan(c.spark, c.spec, None, ((0, 0, lambda w, _: {"v": p["base_m"] + (at(*w.positions) * 0.5 + 0.5) * p["height_m"]}),), ("v",))
        return {"out": Raster(made, c.spec, c.world)}
    g = kernel(c.frame(), lambda x, y: (at(x, y),), ["n"], ["p_height_m"])
    return {"out": g.cells(p["base_m"] + (F.col("n") * 0.5 + 0.5) * c.value("height_m"))}


def _fractal_args(p: dict) -> dict:
    return {k: p[k] for k in ("octaves", "basis", "lacunarity", "gain")}


@operator("noise.perlin", (), OUT_H, FIELD)
def perlin(c: Call):
    return _field(c, noise.perlin)


@operator("noise.simplex", (), OUT_H, FIELD)
def simplex(c: Call):
    return _field(c, noise.simplex)


@operator("noise.value", (), OUT_H, FIELD)
def value(c: Call):
    return _field(c, noise.value)


@operator("noise.fbm", (), OUT_H, (*FIELD, *fractal(6)))
def fbm(c: Call):
    a = _fractal_args(c.params)
    return _field(c, lambda x, y, s: noise.fbm(x, y, s, **a))


@operator("noise.ridged", (), OUT_H, (*FIELD, *fractal(8)))
def ridged(c: Call):
    a = _fractal_args(c.params)
    return _field(c, lambda x, y, s: noise.ridged(x, y, s, **a) * 2.0 - 1.0)


@operator("noise.billow", (), OUT_H, (*FIELD, *fractal(6)))
def billow(c: Call):
    a = _fractal_args(c.params)
    return _field(c, lambda x, y, s: noise.billow(x, y, s, **a))


@operator("noise.domain_warp", (), OUT_H, (*FIELD, *fractal(6), number("warp_m", 2000, 0)))
def domain_warp(c: Call):
    a, warp = _fractal_args(c.params), c.params["warp_m"] / c.params["feature_size_m"]
    return _field(c, lambda x, y, s: noise.warped(x, y, s, warp=warp, **a))


@operator("noise.voronoi", (), OUT_H, (*FIELD, choice("mode", "f1", "f1_inverted", "f2_f1", "cells"), number("jitter", 1, 0, 1)))
def voronoi(c: Call):
    mode, jitter = c.params["mode"], c.params["jitter"]

    def f(x, y, s):
        near, second, cell = noise.worley(x, y, s, jitter)
        if mode == "cells":
            return cell * 2.0 - 1.0
        if mode == "f2_f1":
            return 1.0 - 2.0 * np.minimum((second - near) * 2.0, 1.0)
        return (2.0 * np.minimum(near, 1.0) - 1.0) * (-1.0 if mode == "f1_inverted" else 1.0)

    return _field(c, f)


def file_cells(c: Call, flip_y: bool, kind: str) -> tuple[Raster, bool]:
    """An image file stretched over the whole world, at this grid's samples, and whether its values are metres. Pixel (0, 0) is the origin."""
    from ..sources.images import read_images
    from .focal import sample

    if not c.params["path"]:
        raise InvalidParam("no file is chosen")
    px = read_images(c.spark, c.params["path"])
    size = px.agg(F.max("j").alias("j"), F.max("i").alias("i"), F.first("metres").alias("metres")).first()
    if size.j is None:
        raise ImageError(f"{c.params['path']} holds no image")
    grid = GridSpec(size.i + 1, size.j + 1, c.world.size_m)
    values = [F.col("r").alias("v")] if kind != COLOUR else list("rgba")
    whole = Raster(px.select("j", "i", *values), grid, c.world, kind)
    at = blank(c.spark, c.spec, c.world)
    y = c.world.size_m[1] - at.y if flip_y else at.y
    read = sample(whole, at.df.withColumns({"sx": at.x, "sy": y}))
    return Raster(read.select("j", "i", *whole.columns), c.spec, c.world, kind), bool(size.metres)


@operator("primitive.file", (H("image", optional=True),), OUT_H, (Param("path", "file", ""), choice("values", "auto", "metres", "normalised"), flag("world_range", True), number("low_m", 0), number("high_m", 1000), flag("flip_y", False)), reach=None)
def from_image(c: Call):
    """A height image stretched over the world, or the cells of one that is decoded already; 0..1 is brought to a range unless it is in metres."""
    p = c.params
    if c.has("image"):
        g, metres, value = c.frame("image"), False, F.col("image")
        j = F.lit(c.spec.height - 1) - F.col("j") if p["flip_y"] else F.col("j")
    else:
        g, metres = file_cells(c, p["flip_y"], HEIGHT)
        value, j = F.col("v"), F.col("j")
    if p["values"] == "normalised" or (p["values"] == "auto" and not metres):
        low, high = c.world.height_range_m if p["world_range"] else (p["low_m"], p["high_m"])
        value = low + value * (high - low)
    return {"out": Raster(g.df.select(j.cast("int").alias("j"), "i", col(value).alias("v")), c.spec, c.world)}
