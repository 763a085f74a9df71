"""Point sets: populations scattered by density, and what can be done with points.

A point set is a DataFrame (x_m, y_m, z_m, rotation_deg, scale, species).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hydro, noise
from ..functions.cells import clamp, lerp, smoothstep, soft_range
from ..plans.params import Param, choice, number, whole
from ..plans.world import GridSpec
from .base import MASK, POINTS, Call, H, M, Port, Raster, operator
from .focal import blur_halo, blurred, sample, slope_degrees, slopes
from .tiles import Window as Tile

TILE_CELLS = 512
REACH_CELLS = 20  # nine phases of two cells, and two more


def scatter_points(density: Raster, height: Raster, p: dict, seed: int) -> DataFrame:
    """Points at least ``spacing_m`` apart where a hash is below the density; the same for any tiling.

    Tiles are groups of cells with a halo, so no task holds more than a tile.
    """
    spec, world, spacing = density.spec, density.world, p["spacing_m"]
    side = spacing / math.sqrt(2.0)
    if math.ceil(world.size_m[0] / side) * math.ceil(world.size_m[1] / side) > 2**53:
        raise ValueError("the spacing is too small for this world")
    tile, margin = TILE_CELLS * side, REACH_CELLS * side + 2 * max(spec.cell)
    last = [max(0, math.ceil(s / tile) - 1) for s in world.size_m]
    to = lambda v, k: F.least(F.greatest(F.floor(v / tile), F.lit(0)), F.lit(last[k])).cast("int")
    held = density.df.withColumns({"x": density.x, "y": density.y})
    held = held.withColumn("tx", F.explode(F.sequence(to(F.col("x") - margin, 0), to(F.col("x") + margin, 0)))).withColumn("ty", F.explode(F.sequence(to(F.col("y") - margin, 1), to(F.col("y") + margin, 1))))
    cell, origin = spec.cell, spec.origin_m
    low, high = p.get("rotation_min_deg", 0.0), p.get("rotation_max_deg", 360.0)

    def run(key, table):
        tx, ty = (k.as_py() for k in key)
        j, i, v = (table[n].to_numpy() for n in ("j", "i", "v"))
        grid = np.zeros((j.max() - j.min() + 1, i.max() - i.min() + 1))
        grid[j - j.min(), i - i.min()] = v

        def at(x, y):
            fx = np.clip((x - origin[0]) / cell[0] - i.min(), 0, grid.shape[1] - 1)
            fy = np.clip((y - origin[1]) / cell[1] - j.min(), 0, grid.shape[0] - 1)
            a, b = np.minimum(fx.astype(int), grid.shape[1] - 2), np.minimum(fy.astype(int), grid.shape[0] - 2)
            u, w = fx - a, fy - b
            return (grid[b, a] * (1 - u) + grid[b, a + 1] * u) * (1 - w) + (grid[b + 1, a] * (1 - u) + grid[b + 1, a + 1] * u) * w

        o = (tx * TILE_CELLS - REACH_CELLS, ty * TILE_CELLS - REACH_CELLS)
        o = (max(o[0], 0), max(o[1], 0))
        end = ((tx + 1) * TILE_CELLS + REACH_CELLS, (ty + 1) * TILE_CELLS + REACH_CELLS)
        with np.errstate(over="ignore"):
            x, y, ci, cj = hydro.scatter(at, world.size_m, spacing, seed, o, (end[0] - o[0], end[1] - o[1]))
            own = (ci // TILE_CELLS == tx) & (cj // TILE_CELLS == ty)
            x, y, ci, cj = x[own], y[own], ci[own], cj[own]
            s = noise.derive(seed, 7)
            turn, size = hydro.cell_random(ci, cj, s, 10), hydro.cell_random(ci, cj, s, 11)
        return pa.table([pa.array(c) for c in (x, y, (low + (high - low) * turn) % 360.0, p["scale_min"] + (p["scale_max"] - p["scale_min"]) * size)], ["sx", "sy", "rotation_deg", "scale"])

    found = held.select("tx", "ty", "j", "i", F.col("v").cast("double").alias("v")).groupBy("tx", "ty").applyInArrow(run, "sx double, sy double, rotation_deg double, scale double")
    raised = sample(height, found)
    return raised.select(F.col("sx").alias("x_m"), F.col("sy").alias("y_m"), F.col("v").alias("z_m"), "rotation_deg", "scale", F.lit(p["species"]).alias("species"))


def _noise01(w: Tile, size: float, seed: int, octaves: int) -> np.ndarray:
    return np.clip(noise.metres(*w.positions, size, seed, octaves) * 0.5 + 0.5, 0, 1)


def _patches(amount: float) -> Column:
    return lerp(1.0, smoothstep(0.35, 0.65, F.col("n1")), amount) if amount > 0 else F.lit(1.0)


def _population(type_id: str, species: str, spacing: float, scale: tuple[float, float], slope_max: float, top: float, water: float, peaks: float, dead: float, patches: float, patch: float, spread: float):
    params = (
        number("coverage", 0.8, 0, 1, drivable=True), number("health", 0.8, 0, 1), number("water_preference", water, -1, 1), number("spread_m", spread, 0), number("randomness", 0.3, 0, 1),
        number("slope_min_deg", 0, 0, 90), number("slope_max_deg", slope_max, 0, 90), number("slope_falloff_deg", 6, 0, 90),
        number("height_min_m", 0), number("height_max_m", top), number("height_falloff_m", 100, 0), number("avoid_peaks", peaks, 0, 1), number("snow_tolerance", 0.2, 0, 1),
        choice("occupied_mode", "avoid", "intermingle", "near"), number("occupied_strength", 1, 0, 1),
        number("dead_zones", dead, 0, 1), number("dead_slope_deg", 38, 0, 90), number("patches", patches, 0, 1), number("patch_size_m", patch, 1e-3),
        number("spacing_m", spacing, 0.1), number("rotation_min_deg", 0, 0, 360), number("rotation_max_deg", 360, 0, 360), number("scale_min", scale[0], 0.01), number("scale_max", scale[1], 0.01), Param("species", "text", species), whole("seed", 0),
    )

    @operator(type_id, (H(), M("water", True), M("snow", True), M("area", True), M("occupied", True)), (M("density"), Port("points", POINTS), M("dead_zones"), M("occupied"), M("water")), params, reach=lambda p: 500.0 + REACH_CELLS * p["spacing_m"] / math.sqrt(2.0))
    def grow(c: Call):
        """Density by habitat, health, patches, neighbours and dead ground; points by density."""
        p, cell, seed = c.params, c.spec.cell, c.seed
        ground = c.inputs["in"]
        base = c.around(blur_halo(120.0, cell), lambda w, a: slopes(a["in"], cell) | {"relief": (a["in"] - blurred(a["in"], 120.0, cell)) / 40.0}, ["gx", "gy", "relief"])
        have = [k for k in ("water", "snow", "area", "occupied") if c.has(k)] + [f"p_{k}" for k in c.driven]
        df = base.df.withColumn("slope", slope_degrees())
        wet = clamp(F.col("water")) if c.has("water") else clamp(0.5 - 0.5 * F.col("relief"))
        pref = p["water_preference"]
        home = soft_range(F.col("slope"), p["slope_min_deg"], p["slope_max_deg"], p["slope_falloff_deg"]) * soft_range(F.col("in"), p["height_min_m"], p["height_max_m"], p["height_falloff_m"])
        home = home * (lerp(1.0, F.col("wet"), pref) if pref >= 0 else lerp(1.0, 1.0 - F.col("wet"), -pref)) * (1.0 - p["avoid_peaks"] * clamp(F.col("relief")))
        if c.has("snow"):
            home = home * (1.0 - clamp(F.col("snow")) * (1.0 - p["snow_tolerance"]))
        steep = smoothstep(p["dead_slope_deg"] - 6.0, p["dead_slope_deg"] + 6.0, F.col("slope"))
        df = df.withColumn("wet", wet).withColumns({"home": home, "steep": steep})
        near = c.has("occupied") and p["occupied_mode"] == "near"
        sigmas = {"home": p["spread_m"] / 2, **({"runout": 60.0} if p["dead_zones"] > 0 else {}), **({"around": 40.0} if near else {})}
        halos = [blur_halo(s, cell) for s in sigmas.values()]
        sources = {"home": "home", "runout": "steep", "around": "occupied"}

        def settled(w: Tile, a: dict) -> dict:
            made = {n: blurred(a[sources[n]], s, cell) for n, s in sigmas.items()}
            if p["patches"] > 0:
                made["n1"] = _noise01(w, p["patch_size_m"], noise.derive(seed, 1), 3)
            if p["randomness"] > 0:
                made["n2"] = _noise01(w, max(4.0 * p["spacing_m"], 4.0), noise.derive(seed, 2), 2)
            if p["dead_zones"] > 0:
                made["n3"] = _noise01(w, 80.0, noise.derive(seed, 3), 2)
            return a | made

        kept = ["slope", "wet", "home", "steep", *have]
        extra = [n for n in ("runout", "around") if n in sigmas] + [n for n, k in (("n1", "patches"), ("n2", "randomness"), ("n3", "dead_zones")) if p[k] > 0]
        g = Raster(df.select("j", "i", *kept), c.spec, c.world).around((max(h[0] for h in halos), max(h[1] for h in halos)), settled, [*kept, *extra])
        dead = F.lit(0.0)
        if p["dead_zones"] > 0:
            slide = clamp(F.col("snow")) * smoothstep(25.0, 40.0, F.col("slope")) if c.has("snow") else F.lit(0.0)
            raw = F.greatest(F.col("steep"), F.least(F.col("runout") * 1.6, F.lit(1.0)) * 0.8, slide)
            dead = clamp(p["dead_zones"] * raw * lerp(0.8, 1.5, F.col("n3")))
        patch = _patches(p["patches"])
        fine = lerp(1.0, F.col("n2"), p["randomness"]) if p["randomness"] > 0 else F.lit(1.0)
        healthy = F.col("home") if p["health"] >= 1 else clamp((F.col("home") - (1.0 - p["health"])) / max(p["health"], 0.05))
        taken, free = F.lit(0.0), F.lit(1.0)
        if c.has("occupied"):
            taken = clamp(F.col("occupied"))
            s = p["occupied_strength"]
            free = {"avoid": 1.0 - s * taken, "intermingle": 1.0 - 0.5 * s * taken, "near": lerp(1.0, F.least(2.0 * F.col("around"), F.lit(1.0)) * (1.0 - taken), s) if p["occupied_mode"] == "near" else taken}[p["occupied_mode"]]
        allowed = clamp(F.col("area")) if c.has("area") else F.lit(1.0)
        density = clamp(c.value("coverage") * healthy * patch * fine * allowed * free * (1.0 - dead))
        made = g.cells(density, MASK)
        return {
            "density": made,
            "points": scatter_points(made, ground, p, c.seed),
            "dead_zones": g.cells(dead, MASK),
            "occupied": g.cells(1.0 - (1.0 - taken) * (1.0 - F.least(2.0 * density, F.lit(1.0))), MASK),
            "water": g.cells(F.col("wet"), MASK),
        }

    return grow


trees = _population("vegetation.trees", "tree", 7, (0.8, 1.2), 35, 1400, 0.2, 0.4, 0.5, 0.4, 150, 20)
shrubs = _population("vegetation.shrubs", "shrub", 3, (0.7, 1.3), 42, 1800, 0.1, 0.2, 0.3, 0.5, 60, 10)
grass = _population("vegetation.grass", "grass", 2, (0.6, 1.4), 45, 2200, 0.3, 0.0, 0.2, 0.3, 40, 5)

DEBRIS = (
    number("coverage", 0.8, 0, 1, drivable=True), number("talus_weight", 1, 0, 10), number("dead_zone_weight", 0.5, 0, 10), number("slope_min_deg", 30, 0, 90), number("reach_m", 80, 0),
    number("patches", 0.4, 0, 1), number("patch_size_m", 40, 1e-3), number("spacing_m", 5, 0.1), number("rotation_min_deg", 0, 0, 360), number("rotation_max_deg", 360, 0, 360), number("scale_min", 0.5, 0.01), number("scale_max", 2, 0.01), Param("species", "text", "rock"), whole("seed", 0),
)


@operator("vegetation.debris", (H(), M("talus", True), M("dead_zones", True), M("area", True)), (M("density"), Port("points", POINTS)), DEBRIS, reach=lambda p: 1.75 * p["reach_m"] + REACH_CELLS * p["spacing_m"] / math.sqrt(2.0))
def debris(c: Call):
    """Rocks on talus, or below steep ground, and in dead zones."""
    p, ground, cell, seed = c.params, c.inputs["in"], c.spec.cell, c.seed
    have = [k for k in ("talus", "dead_zones", "area") if c.has(k)] + [f"p_{k}" for k in c.driven]
    df = c.around((1, 1), lambda w, a: slopes(a["in"], cell), ["gx", "gy"]).df
    df = df.select("j", "i", smoothstep(p["slope_min_deg"] - 4.0, p["slope_min_deg"] + 10.0, slope_degrees()).alias("steep"), *have)
    extra = ([] if c.has("talus") else ["rolled"]) + (["n1"] if p["patches"] > 0 else [])

    def settled(w: Tile, a: dict) -> dict:
        made = {} if c_talus else {"rolled": blurred(a["steep"], p["reach_m"] / 2, cell)}
        return a | made | ({"n1": _noise01(w, p["patch_size_m"], noise.derive(seed, 1), 3)} if p["patches"] > 0 else {})

    c_talus = c.has("talus")
    g = Raster(df, c.spec, c.world).around((0, 0) if c_talus else blur_halo(p["reach_m"] / 2, cell), settled, ["steep", *have, *extra])
    talus = clamp(F.col("talus")) if c_talus else clamp(F.least(F.col("rolled") * 1.8, F.lit(1.0)) * (1.0 - 0.7 * F.col("steep")))
    patch = _patches(p["patches"])
    dead = clamp(F.col("dead_zones")) if c.has("dead_zones") else F.lit(0.0)
    allowed = clamp(F.col("area")) if c.has("area") else F.lit(1.0)
    made = g.cells(clamp(F.greatest(talus * p["talus_weight"], dead * p["dead_zone_weight"]) * c.value("coverage") * patch * allowed), MASK)
    return {"density": made, "points": scatter_points(made, ground, p, c.seed)}


def within(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points in a box, edges included."""
    return points.where(F.col("x_m").between(x0, x1) & F.col("y_m").between(y0, y1))


def owned(points: DataFrame, x0: float, y0: float, x1: float, y1: float, last_x: bool, last_y: bool) -> DataFrame:
    """Points that a tile owns: half-open, the last tile closed."""
    x, y = F.col("x_m"), F.col("y_m")
    return points.where((x >= x0) & (x <= x1 if last_x else x < x1) & (y >= y0) & (y <= y1 if last_y else y < y1))


def z_range(points: DataFrame) -> DataFrame:
    return points.agg(F.coalesce(F.min("z_m"), F.lit(0.0)).alias("low"), F.coalesce(F.max("z_m"), F.lit(0.0)).alias("high"), F.count(F.lit(1)).alias("n"))


def rasterise(points: DataFrame, like: Raster) -> Raster:
    """1 in cells that are nearest to some point, else 0."""
    s = like.spec
    at = lambda v, o, e, n: F.floor(F.least(F.greatest((F.col(v) - o) / e * float(n - 1), F.lit(0.0)), F.lit(float(n - 1))) + 0.5).cast("int")
    hit = points.select(at("y_m", s.origin_m[1], s.extent_m[1], s.height).alias("j"), at("x_m", s.origin_m[0], s.extent_m[0], s.width).alias("i")).distinct().withColumn("hit", F.lit(1.0))
    return Raster(like.df.select("j", "i").join(hit, ["j", "i"], "left").select("j", "i", F.coalesce("hit", F.lit(0.0)).alias("v")), s, like.world, MASK)


BLOCK_POINTS = 4096


def thin(points: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Every n-th point of each species, ``most`` in all, in equal shares.

    Points are ranked by a hash of ``order``, then by ``order``; by blocks of
    the hash whose number follows that of the points, so no species is in one
    task.
    """
    total = points.groupBy("species").agg(F.count(F.lit(1)).alias("_n"))
    kinds, count = (x or 0 for x in total.agg(F.count(F.lit(1)), F.sum("_n")).first())
    share, digits = max(1, most // max(kinds, 1)), 1
    while count > BLOCK_POINTS * 16**digits:
        digits += 1
    blocked = points.withColumn("_block", F.substring(F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in order))), 1, digits))
    own = F.row_number().over(Window.partitionBy("species", "_block").orderBy(*order)) - 1
    sizes = blocked.groupBy("species", "_block").agg(F.count(F.lit(1)).alias("_m"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(Window.partitionBy("species").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_m")
    ranked = blocked.withColumn("_own", own).join(before, ["species", "_block"]).join(total, "species")
    return ranked.where((F.col("_before") + F.col("_own")) % F.ceil(F.col("_n") / share) == 0).drop("_block", "_own", "_before", "_n")
