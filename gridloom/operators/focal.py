"""Neighbourhood operators: array kernels on tiles with a halo (``tiles``); borders repeat, grids never shrink.

Only blurs that reach farther than a tile's widest halo run as window frames
over whole rows and columns, and positions farther away are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import noise
from ..functions.cells import clamp, lerp, smoothstep, soft_range
from ..plans.params import choice, flag, number, whole
from ..plans.world import GridSpec
from .base import COLUMN, HEIGHT, MASK, OUT_C, OUT_H, OUT_M, ROW, Call, H, M, Raster, operator
from .local import STRENGTH, by_strength, mask_out
from .tiles import MAX_HALO, Arrays
from .tiles import Window as Tile


def _shift(v: Column, k: int, w: WindowSpec, first: Column, last: Column) -> Column:
    if k == 0:
        return v
    return F.coalesce(F.lag(v, -k).over(w), first) if k < 0 else F.coalesce(F.lead(v, k).over(w), last)


def _ends(w: WindowSpec, name: str) -> tuple[Column, Column]:
    whole_row = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(name).over(whole_row), F.last(name).over(whole_row)


def taps(sigma_cells: float) -> list[float]:
    """Weights of a normalised Gaussian out to three sigmas, from the middle outwards."""
    raw = [math.exp(-0.5 * (k / sigma_cells) ** 2) for k in range(math.ceil(3 * sigma_cells) + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [x / total for x in raw]


def box_radii(sigma_cells: float, passes: int = 3) -> list[int]:
    """Radii of box blurs in a row that are about a Gaussian."""
    ideal = math.sqrt(12 * sigma_cells**2 / passes + 1)
    low = math.floor(ideal)
    low -= 1 - low % 2
    few = round((12 * sigma_cells**2 - passes * low * low - 4 * passes * low - 3 * passes) / (-4 * low - 4))
    return [(low if k < few else low + 2) // 2 for k in range(passes)]


def _tap_pass(g: Raster, weights: list[float], w: WindowSpec) -> Raster:
    first, last = _ends(w, "v")
    ended = g.df.withColumns({"_a": first, "_z": last})
    v = F.col("v")
    out = v * weights[0]
    for k, x in enumerate(weights[1:], 1):
        out = out + (_shift(v, -k, w, F.col("_a"), F.col("_z")) + _shift(v, k, w, F.col("_a"), F.col("_z"))) * x
    return Raster(ended.select("j", "i", out.alias("v")), g.spec, g.world, g.kind)


def _box_pass(g: Raster, r: int, w: WindowSpec, place: Column, count: int) -> Raster:
    first, last = _ends(w, "v")
    inside = F.sum("v").over(w.rowsBetween(-r, r))
    before, after = F.greatest(F.lit(r) - place, F.lit(0)), F.greatest(place + r - (count - 1), F.lit(0))
    mean = (inside + before * first + after * last) / float(2 * r + 1)
    return Raster(g.df.select("j", "i", mean.alias("v")), g.spec, g.world, g.kind)


def blurred(a: np.ndarray, sigma_m: float, cell: tuple[float, float]) -> np.ndarray:
    """What ``gaussian`` does, on an array."""
    for axis, size in ((1, cell[0]), (0, cell[1])):
        s = sigma_m / size
        if s < 0.2:
            continue
        if s <= 6:
            w = taps(s)
            far, n = len(w) - 1, a.shape[axis]
            wide = np.pad(a, [(far, far) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
            part = lambda k, wide=wide, axis=axis, n=n: wide[:, k : k + n] if axis else wide[k : k + n]
            a = w[0] * part(far)
            for k, x in enumerate(w[1:], 1):
                a = a + x * (part(far - k) + part(far + k))
        else:
            for r in box_radii(s):
                wide = np.pad(a, [(r + 1, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
                total = np.cumsum(wide, axis)
                a = (total[:, 2 * r + 1 :] - total[:, : -2 * r - 1] if axis else total[2 * r + 1 :] - total[: -2 * r - 1]) / (2 * r + 1)
    return a


def blur_halo(sigma_m: float, cell: tuple[float, float]) -> tuple[int, int]:
    """How many cells a blur reaches, across and down."""
    far = lambda s: 0 if s < 0.2 else math.ceil(3 * s) if s <= 6 else sum(box_radii(s)) + 1
    return far(sigma_m / cell[0]), far(sigma_m / cell[1])


def gaussian(g: Raster, sigma_m: float) -> Raster:
    """Separable blur with repeated borders: exact taps up to six cells, beyond that three boxes."""
    halo = blur_halo(sigma_m, g.spec.cell)
    if max(halo) <= MAX_HALO:
        cell = g.spec.cell
        return g.around(halo, lambda w, a: {"v": blurred(a["v"], sigma_m, cell)}, ["v"]) if any(halo) else g
    for w, cell, place, n in ((ROW(), g.spec.cell[0], F.col("i"), g.spec.width), (COLUMN(), g.spec.cell[1], F.col("j"), g.spec.height)):
        s = sigma_m / cell
        if s < 0.2:
            continue
        if s <= 6:
            g = _tap_pass(g, taps(s), w)
        else:
            for r in box_radii(s):
                g = _box_pass(g, r, w, place, n)
    return g


def _blurred(c: Call, sigma_m: float | dict[str, float], name: str = "in") -> Raster:
    """All layers of the call, with ``blur`` (or a column for each of several sigmas)."""
    wanted = sigma_m if isinstance(sigma_m, dict) else {"blur": sigma_m}
    cell = c.spec.cell
    halos = [blur_halo(s, cell) for s in wanted.values()]
    halo = (max(h[0] for h in halos), max(h[1] for h in halos))
    if max(halo) <= MAX_HALO:
        return c.around(halo, lambda w, a: {n: blurred(a[name], s, cell) for n, s in wanted.items()}, list(wanted))
    g = c.frame()
    df = g.df
    for n, s in wanted.items():
        soft = gaussian(Raster(g.df.select("j", "i", F.col(name).alias("v")), c.spec, c.world), s)
        df = df.join(soft.df.withColumnRenamed("v", n), ["j", "i"])
    return Raster(df, c.spec, c.world)


@operator("adjust.blur", (H(),), OUT_H, (number("radius_m", 100, 0), *STRENGTH), reach=lambda p: 1.75 * p["radius_m"])
def blur(c: Call):
    if c.lone() is not None and c.params["strength"] == 1:
        return {"out": gaussian(c.lone(), c.params["radius_m"] / 2)}
    return {"out": _blurred(c, c.params["radius_m"] / 2).cells(by_strength(c, F.col("blur")))}


@operator("adjust.sharpen", (H(),), OUT_H, (number("radius_m", 200, 0), number("amount", 1, 0, 10, drivable=True)), reach=lambda p: 1.75 * p["radius_m"])
def sharpen(c: Call):
    return {"out": _blurred(c, c.params["radius_m"] / 2).cells(F.col("in") + c.value("amount") * (F.col("in") - F.col("blur")))}


def slopes(a: np.ndarray, cell: tuple[float, float]) -> Arrays:
    """Central differences per metre, one-sided at the borders."""
    gy, gx = np.gradient(a, cell[1], cell[0])
    return {"gx": gx, "gy": gy}


def gradient(g: Raster, name: str = "v") -> Raster:
    """The frame with ``gx`` and ``gy``."""
    cell, names = g.spec.cell, [c for c in g.df.columns if c not in ("j", "i")]
    return g.around((1, 1), lambda w, a: a | slopes(a[name], cell), [*names, "gx", "gy"])


def _graded(c: Call) -> Raster:
    """All layers of the call, with the gradient of ``in``."""
    cell = c.spec.cell
    return c.around((1, 1), lambda w, a: slopes(a["in"], cell), ["gx", "gy"])


def slope_degrees() -> Column:
    return F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))


def facing(angle_deg: float) -> Column:
    """Cosine between downhill and a direction, 0 on flat ground."""
    a = math.radians(angle_deg)
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return F.when(length > 0, (F.col("gx") * -math.cos(a) - F.col("gy") * math.sin(a)) / length).otherwise(0.0)


@operator("data.slope", (H(),), OUT_M, (number("min_deg", 30, 0, 90), number("max_deg", 90, 0, 90), number("falloff_deg", 5, 0, 90), flag("invert", False)))
def slope(c: Call):
    p = c.params
    return mask_out(_graded(c), soft_range(slope_degrees(), p["min_deg"], p["max_deg"], p["falloff_deg"]), p["invert"])


@operator("data.aspect", (H(),), OUT_M, (number("direction_deg", 270, 0, 360), number("sharpness", 2, 0.01, 100), number("min_slope_deg", 5, 0, 90), flag("invert", False)))
def aspect(c: Call):
    p = c.params
    steep = (F.col("gx") != 0) | (F.col("gy") != 0)
    v = F.pow(0.5 + 0.5 * facing(p["direction_deg"]), F.lit(p["sharpness"])) * smoothstep(0.0, p["min_slope_deg"], slope_degrees())
    return mask_out(_graded(c), F.when(steep, v).otherwise(0.0), p["invert"])


@operator("data.curvature", (H(),), OUT_M, (choice("mode", "convex", "concave", "both"), number("radius_m", 150, 0), number("range_m", 15, 1e-6), flag("invert", False)), reach=lambda p: 1.75 * p["radius_m"])
def curvature(c: Call):
    p = c.params
    t = (F.col("in") - F.col("blur")) / p["range_m"]
    t = {"convex": t, "concave": -t, "both": t * 0.5 + 0.5}[p["mode"]]
    return mask_out(_blurred(c, p["radius_m"] / 2), clamp(t), p["invert"])


@operator("data.occlusion", (H(),), OUT_M, (number("radius_m", 100, 0), number("strength", 1, 0, 10), flag("invert", False)), reach=lambda p: 3.5 * p["radius_m"])
def occlusion(c: Call):
    """1 in the open; darker below blurred surroundings at three scales."""
    p = c.params
    sigmas = {f"b{k}": share * p["radius_m"] for k, share in enumerate((0.25, 0.5, 1.0))}
    deep = F.lit(0.0)
    for n, sigma in sigmas.items():
        deep = deep + F.greatest(F.col(n) - F.col("in"), F.lit(0.0)) / max(sigma, 1e-9)
    return mask_out(_blurred(c, sigmas), clamp(1.0 - 4.0 * p["strength"] * (deep / 3.0)), p["invert"])


@operator("output.normal_map", (H(),), OUT_C, (choice("convention", "opengl", "directx"), number("strength", 1, 0, 100)))
def normal_map(c: Call):
    p, g = c.params, _graded(c)
    nx, ny = F.col("gx") * -p["strength"], F.col("gy") * -p["strength"]
    # rows grow downwards: green up for opengl is against +y
    ny = -ny if p["convention"] == "opengl" else ny
    length = F.sqrt(nx * nx + ny * ny + 1.0)
    return {"out": g.colours(nx / length * 0.5 + 0.5, ny / length * 0.5 + 0.5, 1.0 / length * 0.5 + 0.5, F.lit(1.0))}


# Distances: nearest target along columns by windows, then one lower envelope per row.

FAR = math.sqrt(1e20)


def _envelope(cell: float):
    """Per row: distance by sqrt(min over k of (x - k)^2 cell^2 + v^2), as the lower envelope of parabolas."""

    def row(table: pa.Table) -> pa.Table:
        order = np.argsort(table["i"].to_numpy())
        g = table["near"].to_numpy()[order] ** 2 / (cell * cell)
        n = len(g)
        at, edge = np.zeros(n, np.int64), np.zeros(n + 1)
        k, edge[0], edge[1] = 0, -np.inf, np.inf
        for q in range(1, n):
            while True:
                p = at[k]
                s = ((g[q] + q * q) - (g[p] + p * p)) / (2.0 * (q - p))
                if s > edge[k]:
                    break
                k -= 1
            k += 1
            at[k], edge[k], edge[k + 1] = q, s, np.inf
        own = at[np.searchsorted(edge[1 : k + 1], np.arange(n), "right")] if k else np.zeros(n, np.int64)
        d = np.sqrt((np.arange(n) - own) ** 2 + g[own]) * cell
        return pa.table([table["j"].take(pa.array(order)), table["i"].take(pa.array(order)), pa.array(np.minimum(d, FAR))], ["j", "i", "d"])

    return row


def distance_to(g: Raster, target: Column) -> Raster:
    """Metres to the nearest cell where ``target`` holds (itself included), exact; huge if there is none."""
    place = F.when(target, F.col("j"))
    above = F.last(place, ignorenulls=True).over(COLUMN().rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(place, ignorenulls=True).over(COLUMN().rowsBetween(0, Window.unboundedFollowing))
    step = F.least(F.col("j") - above, below - F.col("j")) * g.spec.cell[1]
    near = g.df.select("j", "i", F.coalesce(step, F.lit(FAR)).alias("near"))
    return Raster(near.groupBy("j").applyInArrow(_envelope(g.spec.cell[0]), "j int, i int, d double").withColumnRenamed("d", "v"), g.spec, g.world, MASK)


@operator("data.distance", (M(),), OUT_M, (choice("mode", "outside", "inside"), number("distance_m", 500, 1e-6), number("threshold", 0.5, 0, 1), choice("profile", "linear", "smooth", "round"), flag("invert", False)), reach=lambda p: p["distance_m"])
def distance(c: Call):
    """1 on the target, falling to 0 at ``distance_m`` outside it (or inside, towards its edge)."""
    p, g = c.params, c.frame()
    over = F.col("in") > p["threshold"]
    d = distance_to(g, over if p["mode"] == "outside" else ~over)
    t = clamp(1.0 - F.col("v") / p["distance_m"]) if p["mode"] == "outside" else clamp(F.col("v") / p["distance_m"])
    t = {"linear": t, "smooth": t * t * (3.0 - 2.0 * t), "round": F.sqrt(F.greatest(1.0 - (1.0 - t) * (1.0 - t), F.lit(0.0)))}[p["profile"]]
    return mask_out(d, t, p["invert"])


def waterline_band(g: Raster, wet: Column, width_m: float, outside: bool = True) -> Raster:
    """1 at the line, 0 ``width_m`` away on the dry (or wet) side."""
    d = distance_to(g, wet if outside else ~wet)
    return d.cells(1.0 - smoothstep(0.0, width_m, F.col("v")), MASK)


def dilate(g: Raster) -> Raster:
    """The largest of each cell's 3 x 3 neighbours."""

    def largest(w: Tile, a: Arrays) -> Arrays:
        v = np.pad(a["v"], 1, mode="edge")
        rows = np.maximum(np.maximum(v[:-2], v[1:-1]), v[2:])
        return {"v": np.maximum(np.maximum(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])}

    return g.around((1, 1), largest, ["v"])


def relief(g: Raster) -> Raster:
    """Height over its surroundings of 120 m, in units of 40 m."""
    cell = g.spec.cell
    return g.around(blur_halo(120.0, cell), lambda w, a: {"v": (a["v"] - blurred(a["v"], 120.0, cell)) / 40.0}, ["v"], MASK)


# Sampling at positions: each cell carries its three neighbours, so one equi-join serves four corners.


def _corners(g: Raster, columns: tuple[str, ...]) -> DataFrame:
    wide = g.df.select("j", "i", *(F.col(c).alias(f"{c}00") for c in columns), *(F.coalesce(F.lead(c).over(ROW()), F.col(c)).alias(f"{c}10") for c in columns))
    below = [F.coalesce(F.lead(f"{c}{k}0").over(COLUMN()), F.col(f"{c}{k}0")).alias(f"{c}{k}1") for c in columns for k in (0, 1)]
    return wide.select("*", *below)


def sample(g: Raster, at, nearest: bool = False):
    """``at`` (columns ``sx`` and ``sy`` in metres) with the raster's columns: clamped bilinear, or the nearest cell's."""
    s, columns = g.spec, g.columns
    fx = F.least(F.greatest((F.col("sx") - s.origin_m[0]) / s.extent_m[0] * float(s.width - 1), F.lit(0.0)), F.lit(float(s.width - 1)))
    fy = F.least(F.greatest((F.col("sy") - s.origin_m[1]) / s.extent_m[1] * float(s.height - 1), F.lit(0.0)), F.lit(float(s.height - 1)))
    if nearest:
        placed = at.withColumns({"_i": F.floor(fx + 0.5).cast("int"), "_j": F.floor(fy + 0.5).cast("int")})
        cells = g.df.select(F.col("j").alias("_j"), F.col("i").alias("_i"), *columns)
        return placed.join(cells, ["_j", "_i"]).drop("_j", "_i")
    placed = at.withColumns({"_fx": fx, "_fy": fy}).withColumns({"_i": F.least(F.floor("_fx"), F.lit(s.width - 2)).cast("int"), "_j": F.least(F.floor("_fy"), F.lit(s.height - 2)).cast("int")})
    corners = _corners(g, columns).withColumnsRenamed({"j": "_j", "i": "_i"})
    tx, ty = F.col("_fx") - F.col("_i"), F.col("_fy") - F.col("_j")
    own = {c: lerp(lerp(F.col(f"{c}00"), F.col(f"{c}10"), tx), lerp(F.col(f"{c}01"), F.col(f"{c}11"), tx), ty) for c in columns}
    return placed.join(corners, ["_j", "_i"]).withColumns(own).drop("_fx", "_fy", "_i", "_j", *(f"{c}{k}" for c in columns for k in ("00", "10", "01", "11")))


def bilinear(w: Tile, a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Clamped bilinear values of a window's array at positions that lie inside it."""
    s = w.spec
    fx = np.clip((x - s.origin_m[0]) / s.extent_m[0] * float(s.width - 1), 0.0, s.width - 1.0)
    fy = np.clip((y - s.origin_m[1]) / s.extent_m[1] * float(s.height - 1), 0.0, s.height - 1.0)
    i, j = np.minimum(fx.astype(np.int64), s.width - 2), np.minimum(fy.astype(np.int64), s.height - 2)
    tx, ty = fx - i, fy - j
    i, j = np.clip(i - w.i0, 0, a.shape[1] - 2), np.clip(j - w.j0, 0, a.shape[0] - 2)
    low = a[j, i] + (a[j, i + 1] - a[j, i]) * tx
    high = a[j + 1, i] + (a[j + 1, i + 1] - a[j + 1, i]) * tx
    return low + (high - low) * ty


def onto(g: Raster, spec: GridSpec, nearest: bool = False) -> Raster:
    """The raster's values at another grid's samples."""
    from .base import blank

    empty = blank(g.spark, spec, g.world)
    return Raster(sample(g, empty.df.withColumns({"sx": empty.x, "sy": empty.y}), nearest).select("j", "i", *g.columns), spec, g.world, g.kind)


def resample(g: Raster, spec: GridSpec) -> Raster:
    """Blurred by half a target cell, then bilinear."""
    return onto(gaussian(g, 0.5 * max(spec.cell)), spec)


def upsample_detail(fine: Raster, coarse_in: Raster, coarse_out: Raster) -> Raster:
    """The fine grid plus what the coarse simulation changed."""
    from .base import join_layers

    change = Raster(join_layers({"a": coarse_in, "b": coarse_out}), coarse_in.spec, coarse_in.world).cells(F.col("b") - F.col("a"))
    return Raster(join_layers({"v0": fine, "d": onto(change, fine.spec)}), fine.spec, fine.world).cells(F.col("v0") + F.col("d"), HEIGHT)


@operator("adjust.transform", (H(),), OUT_H, (number("move_x_m", 0), number("move_y_m", 0), number("rotation_deg", 0, -360, 360), number("scale", 1, 0.01, 100), number("height_scale", 1)), reach=None)
def transform(c: Call):
    """Moved, turned and scaled about the middle of the world; read back through the inverse."""
    p, g = c.params, c.frame()
    cx, cy = c.world.size_m[0] / 2, c.world.size_m[1] / 2
    a = math.radians(-p["rotation_deg"])
    dx, dy = g.x - (cx + p["move_x_m"]), g.y - (cy + p["move_y_m"])
    at = g.df.select("j", "i", (cx + (dx * math.cos(a) - dy * math.sin(a)) / p["scale"]).alias("sx"), (cy + (dx * math.sin(a) + dy * math.cos(a)) / p["scale"]).alias("sy"))
    got = sample(Raster(g.df.select("j", "i", F.col("in").alias("v")), c.spec, c.world), at)
    return {"out": Raster(got, c.spec, c.world).cells(F.col("v") * p["height_scale"], HEIGHT)}


@operator("adjust.warp", (H(),), OUT_H, (number("feature_size_m", 1500, 1e-3), number("strength_m", 300, 0, 20000, drivable=True), whole("octaves", 4, 1, 16), whole("seed", 0)), reach=lambda p: 1.4142135623730951 * p["strength_m"])
def warp(c: Call):
    from .sources import kernel

    p, seed = c.params, c.seed
    size, octaves, far = p["feature_size_m"], p["octaves"], p["strength_m"]
    ax, ay = noise.derive(seed, 1), noise.derive(seed, 2)
    halo = tuple(math.ceil(math.sqrt(2.0) * far / s) + 2 for s in c.spec.cell)
    if c.lone() is not None and max(halo) <= MAX_HALO:

        def moved_values(w: Tile, a: Arrays) -> Arrays:
            x, y = w.positions
            return {"v": bilinear(w, a["v"], x + far * noise.metres(x, y, size, ax, octaves), y + far * noise.metres(x, y, size, ay, octaves))}

        return {"out": c.lone().around(halo, moved_values, ["v"])}
    g = c.frame()
    moved = kernel(g, lambda x, y: (noise.metres(x, y, size, ax, octaves), noise.metres(x, y, size, ay, octaves)), ["nx", "ny"], ["p_strength_m"] if "strength_m" in c.driven else [])
    at = moved.df.select("j", "i", (g.x + c.value("strength_m") * F.col("nx")).alias("sx"), (g.y + c.value("strength_m") * F.col("ny")).alias("sy"))
    return {"out": Raster(sample(Raster(g.df.select("j", "i", F.col("in").alias("v")), c.spec, c.world), at).select("j", "i", "v"), c.spec, c.world)}


SNOW = (number("snow_line_m", 1200), number("transition_m", 250, 1e-6), number("max_slope_deg", 45, 0, 90), number("shade_direction_deg", 270, 0, 360), number("shade_m", 250), number("melt", 0.2, 0, 0.99), number("depth_m", 2, 0), number("smoothing_m", 20, 0))


@operator("simulate.snow", (H(),), (H("height"), M("snow")), SNOW, reach=lambda p: 1.75 * p["smoothing_m"])
def snow(c: Call):
    """Snow by altitude (lower on shaded sides), gone on steep ground, smoothed and partly melted."""
    p, g = c.params, _graded(c)
    half = p["transition_m"] / 2
    amount = smoothstep(p["snow_line_m"] - half, p["snow_line_m"] + half, F.col("in") + p["shade_m"] * facing(p["shade_direction_deg"]))
    amount = amount * (1.0 - smoothstep(p["max_slope_deg"] - 5.0, p["max_slope_deg"] + 5.0, slope_degrees()))
    sigma, cell, melt = p["smoothing_m"] / 2, c.spec.cell, p["melt"]
    fallen = Raster(g.df.select("j", "i", "in", amount.alias("v")), c.spec, c.world)
    halo = blur_halo(sigma, cell)
    if max(halo) <= MAX_HALO:
        lying = fallen.around(halo, lambda w, a: {"in": a["in"], "s": np.clip((blurred(a["v"], sigma, cell) - melt) / (1.0 - melt), 0.0, 1.0)}, ["in", "s"])
    else:
        soft = gaussian(Raster(fallen.df.select("j", "i", "v"), c.spec, c.world, MASK), sigma).df.select("j", "i", clamp((F.col("v") - melt) / (1.0 - melt)).alias("s"))
        lying = Raster(fallen.df.select("j", "i", "in").join(soft, ["j", "i"]), c.spec, c.world)
    return {"height": lying.cells(F.col("in") + F.col("s") * p["depth_m"], HEIGHT), "snow": lying.cells(F.col("s"), MASK)}
