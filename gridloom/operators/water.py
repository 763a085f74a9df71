"""Operators that see the whole world: flow, lakes, rivers, sea, erosion.

The sea finds its way over tiles in rounds, on grids of any size. The others run on a simulation grid of at most ``MAX_SIDE`` samples a side, as
one group of cells in one task; heights come to it through a distributed
resample and go back to the full grid as a distributed difference, so only
the bounded simulation grid ever meets in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import hydro
from ..functions.cells import clamp, log_mask, smoothstep, snap01
from ..plans.params import choice, flag, number
from ..plans.staging import components, staged
from ..plans.world import MAX_SIDE, GridSpec, PlanError
from .base import HEIGHT, MASK, Call, H, M, Raster, join_layers, operator
from .focal import dilate, distance_to, gaussian, gradient, onto, resample
from .tiles import TILE


def world_pass(g: Raster, f: Callable[..., dict[str, np.ndarray]], inputs: list[str], outputs: list[str]) -> Raster:
    """``f`` over whole 2-D arrays of ``inputs``; columns ``outputs`` of the result, staged once for all who read it."""
    if max(g.spec.width, g.spec.height) > MAX_SIDE:
        raise PlanError(f"a world pass has at most {MAX_SIDE} samples a side")
    shape, cell = (g.spec.height, g.spec.width), g.spec.cell

    def run(table: pa.Table) -> pa.Table:
        j, i = table["j"].to_numpy(), table["i"].to_numpy()
        grids = []
        for name in inputs:
            a = np.zeros(shape)
            a[j, i] = table[name].to_numpy()
            if not np.isfinite(a).all() or np.abs(a).max(initial=0) > 1e8:
                raise ValueError(f"{name} holds values that aren't finite or beyond 1e8")
            grids.append(a)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            out = f(cell, *grids)
        jj, ii = np.divmod(np.arange(shape[0] * shape[1]), shape[1])
        return pa.table([pa.array(jj.astype(np.int32)), pa.array(ii.astype(np.int32)), *(pa.array(np.asarray(out[n], np.float64).ravel()) for n in outputs)], ["j", "i", *outputs])

    one = g.df.select("j", "i", *(F.col(n).cast("double").alias(n) for n in inputs), F.lit(0).alias("all"))
    return Raster(staged(one.groupBy("all").applyInArrow(run, "j int, i int" + "".join(f", {n} double" for n in outputs)), "world"), g.spec, g.world)


def _one(g: Raster, name: str, kind: str = HEIGHT) -> Raster:
    return Raster(g.df.select("j", "i", F.col(name).alias("v")), g.spec, g.world, kind)


def simulated(g: Raster, detail_m: float) -> tuple[Raster, GridSpec]:
    """The raster on its simulation grid."""
    spec = g.spec.simulation(detail_m)
    return (g if spec == g.spec else resample(g, spec)), spec


def _back(fine: Raster, coarse: Raster, name: str, kind: str = MASK) -> Raster:
    part = _one(coarse, name, kind)
    return part if coarse.spec == fine.spec else onto(part, fine.spec)


def _added(fine: Raster, coarse: Raster, name: str) -> Raster:
    """``fine`` plus the change ``name`` of the simulation."""
    d = _back(fine, coarse, name)
    return Raster(join_layers({"h": fine, "d": d}), fine.spec, fine.world).cells(F.col("h") + F.col("d"), HEIGHT)


def fill_depressions(g: Raster) -> Raster:
    return _one(world_pass(g, lambda cell, h: {"f": hydro.fill(h)}, ["v"], ["f"]), "f")


def d8_receiver(g: Raster) -> Raster:
    """Each cell's steepest lower neighbour as j * width + i, its own index where none is lower; windows only."""
    from .base import COLUMN, ROW

    near: dict[tuple[int, int], Column] = {}
    df = g.df.withColumns({f"c{di}": (F.lag("v").over(ROW()) if di < 0 else F.lead("v").over(ROW())) for di in (-1, 1)}).withColumn("c0", F.col("v"))
    for dj, di in hydro.D8:
        near[dj, di] = F.col(f"c{di}") if dj == 0 else (F.lag(f"c{di}").over(COLUMN()) if dj < 0 else F.lead(f"c{di}").over(COLUMN()))
    df = df.withColumns({f"n{k}": near[o] for k, o in enumerate(hydro.D8)})
    width, cell = g.spec.width, g.spec.cell
    own = (F.col("j") * width + F.col("i")).cast("long")
    drops = []
    for k, (dj, di) in enumerate(hydro.D8):
        drop = (F.col("v") - F.col(f"n{k}")) / math.hypot(dj * cell[1], di * cell[0])
        drops.append(F.struct(F.coalesce(drop, F.lit(-1.0)).alias("drop"), F.lit(-k).alias("first"), (own + (dj * width + di)).alias("to")))
    best = F.array_max(F.array(*drops))
    return Raster(df.select("j", "i", "v", F.when(best["drop"] > 0, best["to"]).otherwise(own).alias("to")), g.spec, g.world)


def drained(g: Raster) -> Raster:
    """Columns ``area`` (m^2) and ``outlet`` (index) of D8 flow over filled ground."""

    def f(cell, h):
        to, levels, _ = hydro.route(h, cell)
        return {"area": hydro.gather_down(to, levels, np.full(h.size, cell[0] * cell[1])), "outlet": hydro.outlets(to)}

    return world_pass(g, f, ["v"], ["area", "outlet"])


@operator("data.flow", (H(),), (M("accumulation"), M("direction"), M("basins")), (choice("method", "dinf", "d8"), number("detail_m", 8, 0.01, 1e4)), reach=None)
def flow(c: Call):
    sim, spec = simulated(_one(c.frame(), "in"), c.params["detail_m"])
    dinf = c.params["method"] == "dinf"

    def f(cell, h):
        to, levels, filled = hydro.route(h, cell)
        own = np.full(h.size, cell[0] * cell[1])
        one, two, share, angle = hydro.spread_two(filled, cell, to)
        if dinf:
            area = hydro.gather_two(one, two, share, own)
        else:
            area = hydro.gather_down(to, levels, own)
            angle = hydro.link_angle(to, h.shape, cell)
        return {"area": area, "angle": angle / 360.0, "basin": hydro.unit(hydro.mix(hydro.outlets(to).astype(hydro.U) ^ hydro.U(hydro.BASIN_SALT)))}

    r = world_pass(sim, f, ["v"], ["area", "angle", "basin"])
    strong = gaussian(dilate(r.cells(log_mask(F.col("area"), hydro.FLOW_LOW, hydro.FLOW_HIGH), MASK)), 0.5 * spec.cell[0])
    near = lambda name: _one(r, name, MASK) if spec == c.spec else onto(_one(r, name, MASK), c.spec, nearest=True)
    return {"accumulation": strong if spec == c.spec else onto(strong, c.spec), "direction": near("angle"), "basins": near("basin")}


@operator("data.wetness", (H(), M("water", True)), (M("wetness"), M("water_distance")), (number("reach_m", 150, 1e-6), number("stream_area_km2", 0.5, 1e-6), number("detail_m", 8, 0.01, 1e4)), reach=None)
def wetness(c: Call):
    """Topographic wetness, or nearness to water and streams, whichever way a place is wet."""
    p, g = c.params, c.frame()
    sim, spec = simulated(_one(g, "in"), p["detail_m"])

    def f(cell, h):
        to, levels, filled = hydro.route(h, cell)
        one, two, share, _ = hydro.spread_two(filled, cell, to)
        area = hydro.gather_two(one, two, share, np.full(h.size, cell[0] * cell[1]))
        gy, gx = np.gradient(h, cell[1], cell[0])
        twi = np.log(area.reshape(h.shape) / (sum(cell) / 2) / np.maximum(np.hypot(gx, gy), 1e-3))
        return {"twi": np.clip((twi - 4.0) / 10.0, 0.0, 1.0), "stream": hydro.reaches(area, p["stream_area_km2"] * 1e6)}

    r = world_pass(sim, f, ["v"], ["twi", "stream"])
    near = lambda g, cells: distance_to(g, cells).cells(clamp(F.col("v") / p["reach_m"]), MASK)
    damp, far = gaussian(_one(r, "twi", MASK), 0.5 * spec.cell[0]), near(_one(r, "stream", MASK), F.col("v") > 0.5)
    damp, far = (x if spec == c.spec else onto(x, c.spec) for x in (damp, far))
    if c.has("water"):
        both = Raster(join_layers({"a": far, "b": near(c.inputs["water"], F.col("v") > 0.5)}), c.spec, c.world)
        far = both.cells(F.least("a", "b"), MASK)
    both = Raster(join_layers({"t": damp, "d": far}), c.spec, c.world)
    return {"wetness": both.cells(1.0 - (1.0 - F.col("t")) * smoothstep(0.0, 1.0, F.col("d")), MASK), "water_distance": far}


LAKES = (number("min_depth_m", 1, 0), number("min_area_m2", 5000, 0), number("infill", 0.3, 0, 1), number("shore_width_m", 30, 0, 1e4), number("detail_m", 8, 0.01, 1e4))


def waterline(g: Raster, wet, width_m: float) -> Raster:
    """1 at the waterline, 0 ``width_m`` away from it, in the water and on land."""
    sides = Raster(join_layers({"land": distance_to(g, wet), "water": distance_to(g, ~wet)}), g.spec, g.world)
    return sides.cells(1.0 - smoothstep(0.0, width_m, F.greatest("land", "water")), MASK)


@operator("simulate.lakes", (H(),), (H("height"), H("water_surface"), M("lakes"), M("shore")), LAKES, reach=None)
def lakes(c: Call):
    p, fine = c.params, _one(c.frame(), "in")
    sim, _ = simulated(fine, p["detail_m"])

    def f(cell, h):
        label, level = hydro.lakes(h, cell, p["min_depth_m"], p["min_area_m2"])
        level, depth = hydro.spread(label, level, h)
        return {"level": level, "depth": depth}

    r = world_pass(sim, f, ["v"], ["level", "depth"])
    level, depth = (_one(r, name) if r.spec == c.spec else onto(_one(r, name), c.spec, nearest=True) for name in ("level", "depth"))
    g = Raster(join_layers({"h": fine, "level": level, "depth": depth}), c.spec, c.world)
    deep = F.greatest(F.col("level") - F.col("h"), F.lit(0.0))
    soft = clamp(deep / 0.1)
    return {
        "height": g.cells(F.when(deep > 0, F.greatest(F.col("h"), F.col("level") - (1.0 - p["infill"]) * F.col("depth"))).otherwise(F.col("h")), HEIGHT),
        "water_surface": g.cells(F.when(deep > 0, F.col("level")).otherwise(F.col("h")), HEIGHT),
        "lakes": g.cells(snap01(soft), MASK),
        "shore": waterline(g, soft >= 0.5, p["shore_width_m"]),
    }


RIVERS = (number("source_area_km2", 0.5, 1e-6), number("width_m", 40, 0.1), number("depth_m", 4, 0), number("bank_width_m", 20, 0), number("meander_m", 30, 0), number("detail_m", 8, 0.01, 1e4))
PIECES = 4


def reaches(g: Raster, p: dict, seed: int = 0):
    """Table of straight river pieces (x0, y0, x1, y1, and water level, half width and depth at both ends), downstream.

    Curves run from the middle of a cell's link to the middle of its
    receiver's; a source has a piece from its own place to there. Size grows
    with the decades of drained area; the meanders fade out at the edges.
    """
    from ..functions import noise

    source, amp = p["source_area_km2"] * 1e6, p["meander_m"]
    wave = max(12.0 * amp, 50.0)
    names = ["x0", "y0", "x1", "y1", "level0", "level1", "half0", "half1", "depth0", "depth1"]
    shape, cell, origin, extent = (g.spec.height, g.spec.width), g.spec.cell, g.spec.origin_m, g.spec.extent_m

    def run(table: pa.Table) -> pa.Table:
        h = np.zeros(shape)
        h[table["j"].to_numpy(), table["i"].to_numpy()] = table["v"].to_numpy()
        with np.errstate(over="ignore"):
            to, levels, filled = hydro.route(h, cell)
            area = hydro.gather_down(to, levels, np.full(h.size, cell[0] * cell[1]))
            j, i = np.divmod(np.arange(h.size), shape[1])
            x, y = origin[0] + i * cell[0], origin[1] + j * cell[1]
            if amp > 0:
                edge = np.minimum.reduce([x - origin[0], origin[0] + extent[0] - x, y - origin[1], origin[1] + extent[1] - y])
                k = amp * np.minimum(edge / (2.0 * amp), 1.0)
                x, y = x + k * noise.metres(x, y, wave, seed, 3), y + k * noise.metres(x, y, wave, seed ^ 0x6D65616E, 3)
        big = np.clip(np.log10(np.maximum(area, source) / source) / 3.0, 0.0, 1.0)
        half, depth, level = 0.5 * p["width_m"] * (0.1 + 0.9 * big), p["depth_m"] * (0.3 + 0.7 * big), filled.ravel()
        runs = (area >= source) & (to != np.arange(h.size))
        a = np.flatnonzero(runs)
        b = to[a]
        e = to[b]  # b itself where it is an outlet, so that middles with it are its own values
        mid = lambda v, s, t: 0.5 * (v[s] + v[t])
        first = {"level": mid(level, a, b), "half": mid(half, a, b), "depth": mid(depth, a, b)}
        last = {"level": mid(level, b, e), "half": half[b], "depth": depth[b]}
        rows = []
        for k in range(PIECES):
            row = {}
            for end, t in enumerate((k / PIECES, (k + 1) / PIECES)):
                u = 1.0 - t
                row |= {f"{n}{end}": u * u * mid(v, a, b) + 2.0 * u * t * v[b] + t * t * mid(v, b, e) for n, v in (("x", x), ("y", y))}
                row |= {f"{n}{end}": first[n] + (last[n] - first[n]) * t for n in first}
            rows.append(row)
        fed = np.zeros(h.size, bool)
        fed[b] = True
        s = a[~fed[a]]
        rows.append({f"{n}0": v[s] for n, v in (("x", x), ("y", y), ("level", level), ("half", half), ("depth", depth))} | {f"{n}1": mid(v, s, to[s]) for n, v in (("x", x), ("y", y), ("level", level), ("half", half), ("depth", depth))})
        return pa.table([pa.array(np.concatenate([row[n] for row in rows])) for n in names], names)

    return g.df.select("j", "i", F.col("v").cast("double").alias("v"), F.lit(0).alias("all")).groupBy("all").applyInArrow(run, ", ".join(f"{n} double" for n in names))


@operator("simulate.rivers", (H(),), (H("height"), H("water_surface"), M("river"), M("riverbank")), RIVERS, reach=None)
def rivers(c: Call):
    """Beds cut along the reaches: a band join of cells with pieces by blocks, then min and max per cell."""
    p, fine = c.params, _one(c.frame(), "in")
    sim, _ = simulated(fine, p["detail_m"])
    bank, pixel = p["bank_width_m"], min(c.spec.cell)
    band = max(bank, 0.5 * pixel)
    block = max(32 * max(c.spec.cell), p["width_m"] + bank)
    pieces = reaches(sim, p, c.seed).withColumn("far", F.greatest("half0", "half1") + band)
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - F.col("far")) / block), F.floor((F.greatest(a, b) + F.col("far")) / block)))
    dealt = pieces.withColumn("bx", span(F.col("x0"), F.col("x1"))).withColumn("by", span(F.col("y0"), F.col("y1")))
    cells = fine.df.withColumns({"x": fine.x, "y": fine.y}).withColumns({"bx": F.floor(F.col("x") / block), "by": F.floor(F.col("y") / block)})
    ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = clamp(((F.col("x") - F.col("x0")) * ex + (F.col("y") - F.col("y0")) * ey) / F.greatest(ex * ex + ey * ey, F.lit(1e-9)))
    qx, qy = F.col("x") - F.col("x0") - t * ex, F.col("y") - F.col("y0") - t * ey
    at = lambda n: F.col(f"{n}0") + t * (F.col(f"{n}1") - F.col(f"{n}0"))
    met = cells.join(dealt, ["bx", "by"]).withColumns({"d": F.sqrt(qx * qx + qy * qy), "level": at("level"), "half": at("half"), "depth": at("depth")}).where(F.col("d") < F.col("half") + band)
    r, inside = F.col("d") / F.col("half"), F.col("d") < F.col("half")
    slope = smoothstep(0.0, 1.0, (F.col("d") - F.col("half")) / bank) if bank > 0 else F.lit(1.0)
    bed = F.when(inside, F.col("level") - F.col("depth") * (1.0 - r * r)).otherwise(F.col("level") + (F.col("v") - F.col("level")) * slope)
    cover = clamp((F.col("half") - F.col("d")) / pixel + 0.5)  # the share of the pixel, so rivers narrower than one still show
    per = met.groupBy("j", "i").agg(F.min(bed).alias("bed"), F.max(cover).alias("cover"), F.max(F.when(inside, F.col("level"))).alias("surface"), F.max(F.when(~inside, 1.0 - slope)).alias("bank"))
    g = Raster(fine.df.join(per, ["j", "i"], "left"), c.spec, c.world)
    height, covered = F.least("v", F.coalesce("bed", "v")), F.coalesce("cover", F.lit(0.0))
    return {
        "height": g.cells(height, HEIGHT),
        "water_surface": g.cells(F.greatest(height, F.coalesce("surface", height)), HEIGHT),
        "river": g.cells(covered, MASK),
        "riverbank": g.cells(F.coalesce("bank", F.lit(0.0)) * (1.0 - covered), MASK),
    }


PART_BITS = 17  # a tile has fewer parts than cells


def reached(g: Raster, low: Column) -> Raster:
    """1 where ``low`` holds and a path of 4-neighbours that hold leads to the border, else 0.

    Tiles number their own parts; parts that touch across tiles are tied in
    rounds over those pairs alone, so no task sees more than a tile.
    """
    spec = g.spec
    a, b, c, d = spec.bounds
    wide = (c - 1) // TILE + 1
    tile = [F.floor(F.col(v) / TILE).cast("int") for v in ("i", "j")]

    def run(key, table):
        ti, tj = key[0].as_py(), key[1].as_py()
        j, i = table["j"].to_numpy(), table["i"].to_numpy()
        low = np.zeros((TILE, TILE), bool)
        low[j - tj * TILE, i - ti * TILE] = table["low"].to_numpy(zero_copy_only=False)
        part = hydro.parts(low)[j - tj * TILE, i - ti * TILE]
        return pa.table([table["j"], table["i"], pa.array(part + ((tj * wide + ti) << PART_BITS), pa.int64(), mask=part < 0)], ["j", "i", "part"])

    marked = g.df.select("j", "i", F.coalesce(low, F.lit(False)).alias("low"), tile[0].alias("ti"), tile[1].alias("tj"))
    cells = staged(marked.groupBy("ti", "tj").applyInArrow(run, "j int, i int, part long"), "parts")
    sides = cells.where(F.col("part").isNotNull() & (F.col("i") % TILE).isin(0, TILE - 1) | F.col("part").isNotNull() & (F.col("j") % TILE).isin(0, TILE - 1))
    there = sides.select(F.col("j").alias("_j"), F.col("i").alias("_i"), F.col("part").alias("v"))
    across = sides.where(F.col("i") % TILE == TILE - 1).join(there, (F.col("_j") == F.col("j")) & (F.col("_i") == F.col("i") + 1))
    down = sides.where(F.col("j") % TILE == TILE - 1).join(there, (F.col("_j") == F.col("j") + 1) & (F.col("_i") == F.col("i")))
    tied = components(across.unionByName(down).select(F.col("part").alias("u"), "v").distinct())
    rim = cells.where(F.col("part").isNotNull() & ((F.col("i") == a) | (F.col("i") == c - 1) | (F.col("j") == b) | (F.col("j") == d - 1))).select("part").distinct()
    roots = rim.join(tied, F.col("part") == F.col("node"), "left").select("part", "root")
    inner = tied.join(roots.where(F.col("root").isNotNull()).select(F.col("root").alias("of")).distinct(), F.col("root") == F.col("of")).select(F.col("node").alias("wet"))
    wet = roots.select(F.col("part").alias("wet")).union(inner).distinct()
    return Raster(cells.join(wet, F.col("part") == F.col("wet"), "left").select("j", "i", F.when(F.col("wet").isNotNull(), 1.0).otherwise(0.0).alias("v")), spec, g.world, MASK)


SEA = (number("sea_level_m", 200), flag("from_edges", True), number("shallow_depth_m", 30, 1e-6), number("shore_width_m", 60, 0, 1e4), number("beach_height_m", 10, 0), number("coastal_erosion", 0.6, 0, 1))


@operator("simulate.sea", (H(),), (H("height"), H("water_surface"), M("sea"), M("shallow"), M("shoreline")), SEA, reach=None)
def sea(c: Call):
    p, fine = c.params, _one(c.frame(), "in")
    level = p["sea_level_m"]
    wet = fine.cells(F.when(F.col("v") < level, 1.0).otherwise(0.0), MASK)
    if p["from_edges"]:
        wet = reached(fine, F.col("v") < level)
    near = distance_to(wet, F.col("v") > 0.5).cells(1.0 - smoothstep(0.0, p["shore_width_m"], F.col("v")), MASK)
    g = Raster(join_layers({"h": fine, "wet": wet, "near": near}), c.spec, c.world)
    h, is_wet = F.col("h"), F.col("wet") > 0.5
    deep, above = level - h, h - level
    low = (above > 0) & (above < p["beach_height_m"])
    line = waterline(g, is_wet, p["shore_width_m"])
    beach = level + above * (1.0 - p["coastal_erosion"] * F.col("near") * (1.0 - above / max(p["beach_height_m"], 1e-9)))
    worn = F.when(~is_wet & low, beach).otherwise(h)
    return {
        "height": g.cells(worn, HEIGHT),
        "water_surface": g.cells(F.when(is_wet, level).otherwise(worn), HEIGHT),
        "sea": g.cells(F.when(is_wet, F.least(deep / 0.1, F.lit(1.0))).otherwise(0.0), MASK),
        "shallow": g.cells(F.when(is_wet, 1.0 - smoothstep(0.0, p["shallow_depth_m"], deep)).otherwise(0.0), MASK),
        "shoreline": line,
    }


def _eroded(c: Call, f, outputs: list[str]) -> tuple[Raster, Raster]:
    fine = _one(c.frame(), "in")
    sim, spec = simulated(fine, c.params["detail_m"])
    layers = {"v": sim}
    for name in ("mask", "hardness"):
        if c.has(name):
            m = c.inputs[name]
            layers[name] = m if spec == c.spec else onto(m, spec)
    joined = Raster(join_layers(layers), spec, c.world)
    names = list(layers)

    def run(cell, *grids):
        got = dict(zip(names, grids, strict=True))
        return f(cell, got["v"], np.clip(got.get("mask", np.ones_like(got["v"])), 0, 1), np.clip(got.get("hardness", np.zeros_like(got["v"])), 0, 1))

    return fine, world_pass(joined, run, names, outputs)


DETAIL = number("detail_m", 8, 0.01, 1e4)


@operator("simulate.thermal", (H(), M("mask", True), M("hardness", True)), (H("height"), M("debris")), (number("duration_s", 60, 0), number("talus_angle_deg", 35, 0, 89), number("diffusivity_m2_s", 10, 0, 100), DETAIL), reach=None)
def thermal(c: Call):
    p = c.params
    hydro.thermal_steps(simulated(_one(c.frame(), "in"), p["detail_m"])[1].cell, p["duration_s"], p["diffusivity_m2_s"])  # said before anything runs

    def f(cell, h, strength, hard):
        d = hydro.thermal(h, cell, p["duration_s"], p["talus_angle_deg"], p["diffusivity_m2_s"], strength, hard) - h
        up = np.maximum(d, 0.0)
        return {"change": d, "debris": up / (1.0 + up)}

    fine, r = _eroded(c, f, ["change", "debris"])
    return {"height": _added(fine, r, "change"), "debris": _back(fine, r, "debris")}


HYDRAULIC = (number("duration_kyr", 1000, 0, 5000), number("rainfall_m_yr", 1, 0, 10), number("rock_softness", 0.5, 0, 1), number("sediment_capacity", 1.5, 0, 10), number("deposition_rate", 0.5, 0, 1), number("evaporation", 0.02, 0, 1), number("downcutting", 1, 0, 4), DETAIL, number("creep_m2_yr", 0.002, 0, 1))


@operator("simulate.hydraulic", (H(), M("mask", True), M("hardness", True)), (H("height"), M("flow"), M("wear"), M("deposition"), M("sediment")), HYDRAULIC, reach=None)
def hydraulic(c: Call):
    p = c.params

    def f(cell, h, strength, hard):
        out = hydro.hydraulic(h, cell, p, strength, hard)
        return out | {"change": out["height"] - h}

    fine, r = _eroded(c, f, ["change", "flow", "wear", "deposition", "sediment"])
    soft = lambda name: _back(fine, Raster(gaussian(_one(r, name, MASK), max(r.spec.cell)).df.withColumnRenamed("v", name), r.spec, r.world), name)
    return {"height": _added(fine, r, "change"), "flow": soft("flow"), "wear": _back(fine, r, "wear"), "deposition": _back(fine, r, "deposition"), "sediment": soft("sediment")}
