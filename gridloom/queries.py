"""Every operator applied to grids made from tables, and the same in SQL for DuckDB.

Values are compared as whole numbers of millionths (``SCALE``), since engines
differ in the last bits of transcendental functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as fc
from . import noise_sql, water_sql
from .operators import Raster, apply
from .operators import focal, points, water
from .operators.base import CHANNELS, HEIGHT, MASK, blank, join_layers
from .operators.colour import ecosystem_view, snow_overlay, water_overlay
from .plans.world import GridSpec, World
from .sources import sinks
from .sources.tables import customers, events, line12

SCALE = 1e6
#: Not a half: values with few decimals would lie on the edge between two whole numbers.
NUDGE = 0.4637
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Grids in SQL. W, H: samples a side; the cell is 100 m in each.
LINE = """g0 AS (SELECT CAST(month(l_shipdate) - 1 AS INTEGER) AS j, CAST(l_quantity - 1 AS INTEGER) AS i,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 100 AS BIGINT) % 40000 AS c FROM lineitem GROUP BY 1, 2),
 g AS (SELECT j, i, 300.0 + CAST(i AS DOUBLE) * 16.0 + CAST(j AS DOUBLE) * 20.0 + c / 100.0 AS v FROM g0)"""
EVENTS = """g AS (SELECT CAST(b AS INTEGER) AS j, CAST(a AS INTEGER) AS i, coalesce(s, 0.0) AS v FROM range(24) t(a), range(31) u(b)
 LEFT JOIN (SELECT day(ts) - 1 AS dj, hour(ts) AS di, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS s FROM events GROUP BY 1, 2) ON dj = b AND di = a)"""
EMPTY = "g AS (SELECT CAST(b AS INTEGER) AS j, CAST(a AS INTEGER) AS i FROM range(50) t(a), range(12) u(b))"
X, Y = "(4900.0 * (i / 49.0))", "(1100.0 * (j / 11.0))"
DX, DY = f"({X} - 2450.0)", f"({Y} - 550.0)"


def whole(v, scale: float = SCALE):
    return F.floor(v * scale + NUDGE).cast("long")


def numbers(r: Raster, scale: float = SCALE) -> DataFrame:
    return r.df.select("j", "i", *(whole(F.col(c), scale).alias(c) for c in r.columns))


def sql_whole(e: str, scale: float = SCALE) -> str:
    return f"CAST(floor(({e}) * {scale:.1f} + {NUDGE}) AS BIGINT)"


def select(e: str | dict[str, str], grid: str = LINE, more: str = "", source: str = "g", scale: float = SCALE, recursive: bool = False) -> str:
    cols = {"v": e} if isinstance(e, str) else e
    shown = ", ".join(f"{sql_whole(x, scale)} AS {n}" for n, x in cols.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{grid}{', ' + more if more else ''} SELECT j, i, {shown} FROM {source}"


def smooth(e0: float, e1: float, v: str) -> str:
    if e0 == e1:
        return f"(CASE WHEN {v} < {e0} THEN 0.0 ELSE 1.0 END)"
    t = f"least(greatest(({v} - ({e0})) / ({e1 - e0}), 0.0), 1.0)"
    return f"({t} * {t} * (3.0 - 2.0 * {t}))"


def soft(v: str, low: float, high: float, fall: float) -> str:
    return f"({smooth(low - fall, low, v)} * (1.0 - {smooth(high, high + fall, v)}))"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def on_line(name: str, type_id: str, params: dict, sql: str | None = None, port: str = "out", source=line12, scale: float = SCALE, seed: int = 7) -> None:
    """An operator whose only input is the table's grid (or none)."""
    from .operators import OPERATORS

    def run(spark, sf_dir):
        g = source(spark, sf_dir)
        keys = [p.key for p in OPERATORS[type_id].inputs if not p.optional]
        out = apply(type_id, {k: g for k in keys}, params, spark=spark, spec=g.spec, world=g.world, seed=seed)[port]
        return numbers(out, scale) if isinstance(out, Raster) else out

    add(name, run, sql)


# Local operators.

_RANGE = "r AS (SELECT min(v) AS lo, max(v) AS hi FROM g), n AS (SELECT j, i, v, lo, hi FROM g, r)"
on_line("levels_auto", "adjust.levels", {}, select("(v - lo) / (hi - lo) * 2000.0", more=_RANGE, source="n"))
on_line("levels_gamma", "adjust.levels", {"auto_input": False, "in_low_m": 100, "in_high_m": 1500, "gamma": 2.2, "world_output": False, "out_high_m": 900}, select("pow(least(greatest((v - 100.0) / 1400.0, 0.0), 1.0), 2.2) * 900.0", scale=1e4), scale=1e4)
on_line("clamp", "adjust.clamp", {"low_m": 900, "high_m": 300}, select("least(greatest(v, 300.0), 900.0)"))
on_line("invert_world", "adjust.invert", {}, select("2000.0 - v"))
on_line("invert_input", "adjust.invert", {"around": "input"}, select("lo + hi - v", more=_RANGE, source="n"))
on_line("invert_pivot", "adjust.invert", {"around": "pivot", "pivot_m": 640}, select("1280.0 - v"))
on_line("terrace", "adjust.terrace", {"offset_m": 30}, select("(floor((v - 30.0) / 120.0) + pow((v - 30.0) / 120.0 - floor((v - 30.0) / 120.0), 8.7)) * 120.0 + 30.0", scale=1e4), scale=1e4)
on_line("height_mask", "data.height_mask", {"low_m": 400, "high_m": 900}, select(soft("v", 400.0, 900.0, 100.0)))
on_line("height_mask_inverted", "data.height_mask", {"low_m": 400, "high_m": 900, "invert": True}, select(f"1.0 - {soft('v', 400.0, 900.0, 100.0)}"))
on_line("select_range", "data.select_range", {}, select(soft("(v / 2000.0)", 0.4, 0.6, 0.05)))
on_line("rock_hardness", "data.rock_hardness", {}, select(f"0.1 + (0.9 - 0.1) * {smooth(0.0, 1.0, '(2.0 * sin(3.141592653589793 * v / 50.0) + 0.5)')}"))
on_line("portal", "portal.height", {}, select("v"))
on_line("portal_mask", "portal.mask", {}, select("v / 2000.0"))
add("to_mask", lambda s, d: numbers(line12(s, d).to(MASK)), select("v / 2000.0"))
add("to_height", lambda s, d: numbers(line12(s, d).to(MASK).to(HEIGHT)), select("v / 2000.0 * 2000.0"))

_CURVE = [(0.0, 0.0), (0.25, 0.5), (0.6, 0.55), (1.0, 1.0)]
# Its pieces rise by 2, 1/7 and 9/8. The mean slopes at the inner points are 7.5 and 4.4375 times the middle piece's, too steep together, and shrink to a length of 3.
_SHRINK = 3.0 / math.sqrt(7.5**2 + 4.4375**2)
_TANGENTS = (2.0, _SHRINK * 7.5 / 7.0, _SHRINK * 4.4375 / 7.0, 1.125)


def _curve_sql(v: str, pts) -> str:
    m, out = _TANGENTS, str(pts[-1][1])
    for k in range(len(pts) - 2, -1, -1):
        (a, b), (c, d) = pts[k], pts[k + 1]
        t = f"(({v} - {a}) / {c - a})"
        piece = f"(2*{t}*{t}*{t} - 3*{t}*{t} + 1) * {b} + ({t}*{t}*{t} - 2*{t}*{t} + {t}) * ({(c - a) * m[k]!r}) + (3*{t}*{t} - 2*{t}*{t}*{t}) * {d} + ({t}*{t}*{t} - {t}*{t}) * ({(c - a) * m[k + 1]!r})"
        out = f"CASE WHEN {v} < {c} THEN {piece} ELSE {out} END"
    return f"(CASE WHEN {v} <= {pts[0][0]} THEN {pts[0][1]} ELSE {out} END)"


on_line("curve", "adjust.curve", {"curve": _CURVE, "strength": 0.75}, select(f"v + ({_curve_sql('least(greatest(v / 2000.0, 0.0), 1.0)', _CURVE)} * 2000.0 - v) * 0.75", scale=1e4), scale=1e4)


def _driven(s, d):
    g = line12(s, d)
    return numbers(apply("primitive.cone", {}, {"height_m": 500}, spark=s, spec=g.spec, world=g.world, driven={"height_m": g})["out"])


add("driven_strength", _driven, select(f"least(greatest(500.0 * least(greatest(v / 2000.0, 0.0), 1.0), 0.0), 20000.0) * greatest(1.0 - sqrt({DX} * {DX} + {DY} * {DY}) / 2500.0, 0.0)"))


def _pair(s, d):
    """The grid, itself upside down, and a mask."""
    g = line12(s, d)
    return g, g.cells(1500.0 - F.col("v")), g.cells(F.col("j") / 11.0, MASK)


for _mode, _op in {"add": "a + b", "subtract": "a - b", "multiply": "a / 2000.0 * (b / 2000.0) * 2000.0", "max": "greatest(a, b)", "min": "least(a, b)", "blend": "b"}.items():
    add(f"combine_{_mode}", lambda s, d, m=_mode: numbers(apply("combine.combine", dict(zip(("a", "b", "mask"), _pair(s, d), strict=True)), {"mode": m, "ratio": 0.8})["out"]), select(f"a + (({_op}) - a) * (0.8 * (j / 11.0))", more="p AS (SELECT j, i, v AS a, 1500.0 - v AS b FROM g)", source="p"))


def _gradient_sql(t: str, k: int, stops) -> str:
    out = str(stops[0][1 + k])
    for n, s in enumerate(stops):
        e = stops[n + 1] if n + 1 < len(stops) else None
        piece = f"{s[1 + k]} + ({e[1 + k]} - {s[1 + k]}) * (({t} - {s[0]}) / ({e[0] - s[0]!r}))" if e else str(s[1 + k])
        out = f"CASE WHEN {t} >= {s[0]} THEN {piece} ELSE {out} END"
    return f"({out})"


# Stops (place, red, green, blue), as text of their own.
_STOPS = {
    "terrain": ((0.0, 0.2, 0.27, 0.13), (0.3, 0.36, 0.4, 0.2), (0.55, 0.47, 0.41, 0.31), (0.78, 0.55, 0.53, 0.5), (0.9, 0.88, 0.89, 0.91), (1.0, 0.97, 0.98, 1.0)),
    "desert": ((0.0, 0.42, 0.22, 0.13), (0.4, 0.7, 0.4, 0.22), (0.75, 0.84, 0.6, 0.38), (1.0, 0.93, 0.8, 0.62)),
}


def _rgb(name: str, t: str) -> dict[str, str]:
    return {n: _gradient_sql(t, k, _STOPS[name]) for k, n in enumerate("rgb")}


_T = "least(greatest(v / 2000.0, 0.0), 1.0)"
on_line("colourise", "colour.colourise", {"preset": "terrain"}, select(_rgb("terrain", _T) | {"a": "1.0"}))


def _two_colours(s, d):
    g = line12(s, d)
    paint = lambda name: apply("colour.colourise", {"in": g}, {"preset": name})["out"]
    return paint("terrain"), paint("desert"), g.cells(F.col("j") / 11.0, MASK)


_PAINTED = f"p AS (SELECT j, i, {', '.join(f'{e} AS a{n}' for n, e in _rgb('terrain', _T).items())}, {', '.join(f'{e} AS b{n}' for n, e in _rgb('desert', _T).items())} FROM g)"
_K = "(j / 11.0 * 0.7)"
for _mode, _f in {"normal": "b{0}", "multiply": "a{0} * b{0}", "screen": "1.0 - (1.0 - a{0}) * (1.0 - b{0})", "overlay": "CASE WHEN a{0} < 0.5 THEN 2.0 * a{0} * b{0} ELSE 1.0 - 2.0 * (1.0 - a{0}) * (1.0 - b{0}) END"}.items():
    add(f"blend_{_mode}", lambda s, d, m=_mode: numbers(apply("colour.blend", dict(zip(("a", "b", "mask"), _two_colours(s, d), strict=True)), {"mode": m, "opacity": 0.7})["out"]), select({n: f"a{n} + (({_f.format(n)}) - a{n}) * {_K}" for n in "rgb"} | {"a": "1.0"}, more=_PAINTED, source="p"))


def _layers(s, d):
    a, b, m = _two_colours(s, d)
    return numbers(apply("colour.layers", {"base": a, "colour1": b, "mask1": m, "colour2": a, "mask2": m.cells(1.0 - F.col("v"))})["out"])


add("layers", _layers, select({n: f"(a{n} + (b{n} - a{n}) * (j / 11.0)) + (a{n} - (a{n} + (b{n} - a{n}) * (j / 11.0))) * (1.0 - j / 11.0)" for n in "rgb"} | {"a": "1.0"}, more=_PAINTED, source="p"))


def _masks(s, d):
    g = line12(s, d)
    return g.to(MASK), g.cells(F.col("j") / 11.0, MASK), g.cells(F.col("i") / 49.0, MASK)


add("pack_masks", lambda s, d: numbers(apply("output.pack_masks", dict(zip("rga", _masks(s, d), strict=True)))["out"]), select({"r": _T, "g": "j / 11.0", "b": "0.0", "a": "i / 49.0"}))
_SPLAT = f"p AS (SELECT j, i, greatest(1.0 - {_T} - j / 11.0, 0.0) AS w1, {_T} AS w2, j / 11.0 AS w3 FROM g), q AS (SELECT *, w1 + w2 + w3 AS t FROM p)"
add("splat", lambda s, d: numbers(apply("output.splat", {"layer2": _masks(s, d)[0], "layer3": _masks(s, d)[1]})["weights_1_4"]), select({n: f"CASE WHEN t > 0 THEN {w} / t ELSE {z} END" for n, w, z in (("r", "w1", "1.0"), ("g", "w2", "0.0"), ("b", "w3", "0.0"), ("a", "0.0", "0.0"))}, more=_SPLAT, source="q"))
add("image_colour", lambda s, d: numbers(apply("colour.image", {"image": _two_colours(s, d)[0]}, {"brightness": 1.2, "saturation": 0.5})["out"]), select({n: f"least(greatest(((ar + ag + ab) / 3.0 + (a{n} - (ar + ag + ab) / 3.0) * 0.5) * 1.2, 0.0), 1.0)" for n in "rgb"} | {"a": "1.0"}, more=_PAINTED, source="p"))
add("image_height", lambda s, d: numbers(apply("primitive.file", {"image": line12(s, d).cells(F.col("v") / 2500.0)}, {"flip_y": True, "world_range": False, "low_m": 10, "high_m": 810})["out"]), f"WITH {LINE} SELECT CAST(11 - j AS INTEGER) AS j, i, {sql_whole('10.0 + v / 2500.0 * 800.0')} AS v FROM g")
for _name, _col, _ex in (
    ("srgb_to_linear", lambda: fc.srgb_to_linear(F.col("v") / 2000.0), "CASE WHEN v / 2000.0 <= 0.04045 THEN v / 2000.0 / 12.92 ELSE pow((v / 2000.0 + 0.055) / 1.055, 2.4) END"),
    ("log_mask", lambda: fc.log_mask(F.col("v"), 100.0, 1500.0), "CASE WHEN v <= 0 THEN 0.0 ELSE least(log10(greatest(v, 100.0) / 100.0) / log10(15.0), 1.0) END"),
    ("snap01", lambda: fc.snap01(F.col("i") / 49.0), "i / 49.0"),
    ("half_saturation", lambda: fc.half_saturation(F.col("v") - 500.0, 30.0), "CASE WHEN v > 500.0 THEN (v - 500.0) / (30.0 + v - 500.0) ELSE 0.0 END"),
    ("smoothstep_reversed", lambda: fc.smoothstep(900.0, 300.0, F.col("v")), smooth(900.0, 300.0, "v")),
):
    add(_name, lambda s, d, f=_col: numbers(line12(s, d).cells(f())), select(_ex))

# Sources.

on_line("constant", "primitive.constant", {"height_m": 12.5}, select("12.5", EMPTY))
on_line("ramp_linear", "primitive.gradient", {"angle_deg": 30, "length_m": 4000}, select(f"1000.0 * least(greatest(({DX} * cos(radians(30)) + {DY} * sin(radians(30))) / 4000.0 + 0.5, 0.0), 1.0)", EMPTY))
on_line("ramp_radial", "primitive.gradient", {"mode": "radial", "length_m": 3000, "profile": "smooth", "base_m": 5}, select(f"5.0 + 1000.0 * {smooth(0.0, 1.0, f'(sqrt({DX} * {DX} + {DY} * {DY}) / 3000.0)')}", EMPTY))
on_line("cone", "primitive.cone", {"pos_x_m": 200}, select(f"1500.0 * greatest(1.0 - sqrt(({DX} - 200.0) * ({DX} - 200.0) + {DY} * {DY}) / 2500.0, 0.0)", EMPTY))
on_line("hemisphere", "primitive.hemisphere", {}, select(f"1500.0 * sqrt(greatest(1.0 - ({DX} * {DX} + {DY} * {DY}) / 6250000.0, 0.0))", EMPTY, scale=1e4), scale=1e4)


def _polygon_sql(corners) -> str:
    lines, parts = [], []
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        ex, ey = bx - ax, by - ay
        long = math.hypot(ex, ey)
        lines.append(f"((u - ({ax!r})) * ({ey / long!r}) - (w - ({ay!r})) * ({ex / long!r}))")
        t = f"least(greatest(((u - ({ax!r})) * ({ex!r}) + (w - ({ay!r})) * ({ey!r})) / {long * long!r}, 0.0), 1.0)"
        parts.append(f"sqrt(pow(u - ({ax!r}) - {t} * ({ex!r}), 2) + pow(w - ({ay!r}) - {t} * ({ey!r}), 2))")
    return f"CASE WHEN greatest({', '.join(lines)}) <= 0 THEN greatest({', '.join(lines)}) ELSE least({', '.join(parts)}) END"


_TURNED = f"p AS (SELECT j, i, {DX} * cos(radians(20)) + {DY} * sin(radians(20)) AS u, {DY} * cos(radians(20)) - {DX} * sin(radians(20)) AS w FROM g)"
_W3 = 700.0 / math.sqrt(3)
for _shape, _d in {
    "circle": "sqrt(u * u + w * w) - 700.0",
    "square": "sqrt(pow(greatest(abs(u) - 700.0, 0.0), 2) + pow(greatest(abs(w) - 700.0, 0.0), 2)) + least(greatest(abs(u) - 700.0, abs(w) - 700.0), 0.0)",
    "diamond": "(abs(u) + abs(w) - 700.0) * sqrt(0.5)",
    "hexagon": _polygon_sql([(2 * _W3, 0.0), (_W3, 700.0), (-_W3, 700.0), (-2 * _W3, 0.0), (-_W3, -700.0), (_W3, -700.0)]),
    "triangle": _polygon_sql([(0.0, -2 * _W3), (700.0, _W3), (-700.0, _W3)]),
}.items():
    on_line(f"shape_{_shape}", "primitive.shape", {"shape": _shape, "size_m": 700, "rotation_deg": 20}, select(f"1000.0 * (1.0 - {smooth(0.0, 800.0, 'd')})", EMPTY, more=f"{_TURNED}, q AS (SELECT j, i, {_d} AS d FROM p)", source="q", scale=1e4), scale=1e4)
# Noise and landforms. The SQL computes lattice noise on its own, in ``noise_sql``.

SEED = 7
_U, _V = f"({X} / 700.0)", f"({Y} / 700.0)"
_SPREAD = "(n * 0.5 + 0.5) * 1000.0"


def noisy(e: str | dict[str, str], *more: str, source: str = "g", scale: float = 1e4, grid: str = EMPTY) -> str:
    return select(e, grid, more=", ".join(more), source=source, scale=scale)


for _t in ("perlin", "value", "simplex"):
    on_line("value_noise" if _t == "value" else _t if _t == "perlin" else f"noise_{_t}", f"noise.{_t}", {"feature_size_m": 700}, noisy(_SPREAD, noise_sql.one("f", "g", _U, _V, SEED, _t), source="f"), scale=1e4)
on_line("fbm", "noise.fbm", {"feature_size_m": 700}, noisy(_SPREAD, noise_sql.fbm("f", "g", _U, _V, SEED, 6), source="f"), scale=1e4)
on_line("noise_ridged", "noise.ridged", {"feature_size_m": 700}, noisy("((n * 2.0 - 1.0) * 0.5 + 0.5) * 1000.0", noise_sql.ridged("f", "g", _U, _V, SEED, 8), source="f"), scale=1e4)
on_line("noise_billow", "noise.billow", {"feature_size_m": 700}, noisy(_SPREAD, noise_sql.fbm("f", "g", _U, _V, SEED, 6, "abs(n) * 2.0 - 1.0"), source="f"), scale=1e4)
_BENT = "w AS (SELECT a.j, a.i, {u} + 2000.0 / 700.0 * a.n AS wu, {v} + 2000.0 / 700.0 * b.n AS wv FROM wa a JOIN wb b USING (j, i))"
on_line("noise_domain_warp", "noise.domain_warp", {"feature_size_m": 700}, noisy(_SPREAD, noise_sql.fbm("wa", "g", _U, _V, noise_sql.sub_seed(SEED, 1001), 4), noise_sql.fbm("wb", "g", f"{_U} + 5.2", f"{_V} + 1.3", noise_sql.sub_seed(SEED, 1002), 4), _BENT.format(u=_U.replace("i /", "a.i /"), v=_V.replace("j /", "a.j /")), noise_sql.fbm("f", "w", "wu", "wv", SEED, 6), source="f"), scale=1e4)
for _mode, _e in {"f1": "2.0 * least(near, 1.0) - 1.0", "f1_inverted": "1.0 - 2.0 * least(near, 1.0)", "f2_f1": "1.0 - 2.0 * least((second - near) * 2.0, 1.0)", "cells": "own * 2.0 - 1.0"}.items():
    on_line(f"voronoi_{_mode}", "noise.voronoi", {"feature_size_m": 700, "mode": _mode}, noisy(f"(({_e}) * 0.5 + 0.5) * 1000.0", noise_sql.cells("f", "g", _U, _V, SEED), source="f"), scale=1e4)


def _near(name: str, size: float, octaves: int, part: int) -> str:
    return noise_sql.fbm(name, "g", f"({X} / {size!r})", f"({Y} / {size!r})", noise_sql.sub_seed(SEED, part), octaves)


def _fields(name: str, src: str, columns: dict[str, str], **fields: str) -> str:
    """``src`` with noise fields joined to it and then more columns."""
    got = " ".join(f"JOIN (SELECT j, i, n AS {n} FROM {f}) USING (j, i)" for n, f in fields.items())
    extra = "".join(f", {e} AS {n}" for n, e in columns.items())
    return f"{name}0 AS (SELECT * FROM {src} {got}), {name} AS (SELECT *{extra} FROM {name}0)"


def _clamp(e: str) -> str:
    return f"least(greatest({e}, 0.0), 1.0)"


_CREST = "least(greatest(1.0 - 1.5 * abs({0}), 0.0), 1.0)"
_MIDDLE = f"c AS (SELECT j, i, {X} AS x, {Y} AS y, {DX} AS dx, {DY} AS dy, sqrt({DX} * {DX} + {DY} * {DY}) AS far FROM g)"


def _turned(angle: float, dx: str = "dx", dy: str = "dy") -> str:
    return f"c0 AS (SELECT j, i, {X} AS x, {Y} AS y, {DX} AS dx, {DY} AS dy FROM g), c AS (SELECT *, {dx} * cos(radians({angle})) + {dy} * sin(radians({angle})) AS u, {dy} * cos(radians({angle})) - {dx} * sin(radians({angle})) AS w FROM c0)"


def _on(name: str, src: str, u: str, v: str, octaves: int, part: int) -> str:
    return noise_sql.fbm(name, src, u, v, noise_sql.sub_seed(SEED, part), octaves)


for _style, _oct, _plain, _body in (("alpine", 4, 5, "pow(t, 1.7)"), ("rounded", 2, 3, "t * t * (3.0 - 2.0 * t)")):
    on_line(f"terrain_mountain_{_style}", "terrain.mountain", {"radius_m": 1500, "style": _style}, noisy(
        f"1800.0 * greatest({_body} * (1.0 - 0.6 * (1.0 - t * t) * (1.0 - {_CREST.format('(0.6 * spokes + 0.4 * plain)')})) + 0.025 * t * fine, 0.0)",
        _MIDDLE, _near("wave", 1200.0, 3, 11), _fields("d", "c", {"r": "far / 1500.0 * (1.0 + 0.3 * wave)"}, wave="wave"),
        _on("spokes", "d", "(dx * ((2.0 + r) / greatest(far, 1e-6)))", "(dy * ((2.0 + r) / greatest(far, 1e-6)))", _oct, 12), _near("plain", 600.0, _plain, 13), _near("fine", 187.5, 5, 14),
        _fields("e", "d", {"t": _clamp("1.0 - r")}, spokes="spokes", plain="plain", fine="fine"), source="e"), scale=1e4)
on_line("terrain_ridge", "terrain.ridge", {"length_m": 3000, "width_m": 700}, noisy(
    f"1200.0 * greatest(pow(1.0 - d, 1.6) * (1.0 - 0.25 * abs(sag)) * (1.0 - 0.5 * d * (1.0 - {_CREST.format('spurs')})) + 0.025 * (1.0 - d) * fine, 0.0)",
    _turned(30), _on("bend", "c", "(u / 1500.0)", "0.0", 3, 21), _on("sag", "c", "(u / 900.0)", "7.0", 3, 22), _near("fine", 700.0 / 6, 5, 24),
    _fields("e", "c", {"w2": "w + 500.0 * bend", "past": "greatest(abs(u) - 1500.0, 0.0)"}, bend="bend", sag="sag", fine="fine"), _on("spurs", "e", "(u / 280.0)", "(w2 / 1400.0)", 4, 23),
    _fields("k", "e", {"d": "least(sqrt(w2 * w2 + past * past) / 700.0, 1.0)"}, spurs="spurs"), source="k"), scale=1e4)
_WALL = "away AS (SELECT *, abs(w - 900.0 * bend) + 0.15 * (450.0 - 150.0) * ragged AS d FROM e), s AS (SELECT *, " + smooth(150.0, 450.0, "d") + " AS wall FROM away)"
for _name, _steps, _e in (("canyon", 3, f"wall + ((floor(wall * 3) + {smooth(0.6, 1.0, '(wall * 3 - floor(wall * 3))')}) / 3 - wall) * 0.75"), ("canyon_smooth", 0, "wall")):
    on_line(f"terrain_{_name}", "terrain.canyon", {"width_m": 900, "steps": _steps, "meander_size_m": 1500}, noisy(
        f"v + 450.0 * (({_e}) - 1.0)", _turned(0), _on("bend", "c", "(u / 1500.0)", "0.0", 3, 31), _near("ragged", 450.0, 4, 32), _fields("e", "c", {}, bend="bend", ragged="ragged") + ", " + _WALL, source="(SELECT s.*, 800.0 AS v FROM s)"), scale=1e4)
on_line("terrain_crater", "terrain.crater", {"radius_m": 900}, noisy(
    f"CASE WHEN r < 1 THEN 300.0 * ({smooth(0.3, 1.0, 'r')} - 1.0 + grain) + 120.0 * ({smooth(0.3, 1.0, 'r')} + grain) ELSE 300.0 * grain + 120.0 * (exp(-2.0 * pow((r - 1.0) / 0.6, 2)) + grain) END",
    _MIDDLE, _near("wave", 540.0, 3, 41), _near("fine", 150.0, 4, 42), _fields("d", "c", {"r": "far / 900.0 * (1.0 + 0.036 * wave)"}, wave="wave", fine="fine"),
    f"e AS (SELECT *, 0.024 * fine * (1.0 - {smooth(1.0, 2.2, 'r')}) AS grain FROM d)", source="e"), scale=1e4)
on_line("terrain_plateau", "terrain.plateau", {"radius_m": 900, "edge_m": 200}, noisy(
    f"500.0 * CASE WHEN d <= 0 THEN 1.0 + 0.012 * fine * (1.0 - {smooth(-90.0, 0.0, 'd')}) WHEN d < 150 THEN 0.35 + 0.65 * (0.5 + 0.5 * cos(pi() * d / 150.0)) ELSE 0.35 * pow({_clamp('1.0 - (d - 150.0) / 700.0')}, 2) END",
    _MIDDLE, _near("wave", 400.0, 4, 51), _near("fine", 225.0, 4, 52), _fields("e", "c", {"d": "far - 900.0 + 200.0 * wave"}, wave="wave", fine="fine"), source="e"), scale=1e4)
on_line("terrain_dunes", "terrain.dunes", {"angle_deg": 25}, noisy(
    f"35.0 * CASE WHEN f < 0.75 THEN 0.5 - 0.5 * cos(pi() * f / 0.75) ELSE pow((1.0 - f) / 0.25, 1.5) END * (1.0 - 0.5 * {_clamp('0.5 + 0.5 * swell')})",
    _turned(25, "x", "y").replace("x * cos", "(dx + 2450.0) * cos").replace("y * sin", "(dy + 550.0) * sin").replace("y * cos", "(dy + 550.0) * cos").replace("x * sin", "(dx + 2450.0) * sin"),
    _on("bend", "c", "(w / 900.0)", "(u / 2250.0)", 3, 61), _near("swell", 2250.0, 3, 62), _fields("e", "c", {"phase": "(u + 220.0 * bend) / 450.0"}, bend="bend", swell="swell"),
    "k AS (SELECT *, phase - floor(phase) AS f FROM e)", source="k"), scale=1e4)

# Focal operators.

_GRAD = """d AS (SELECT j, i, v, (coalesce(lead(v) OVER rw, v) - coalesce(lag(v) OVER rw, v)) / ((CASE WHEN i IN (0, 49) THEN 1.0 ELSE 2.0 END) * 100.0) AS gx,
 (coalesce(lead(v) OVER cw, v) - coalesce(lag(v) OVER cw, v)) / ((CASE WHEN j IN (0, 11) THEN 1.0 ELSE 2.0 END) * 100.0) AS gy
 FROM g WINDOW rw AS (PARTITION BY j ORDER BY i), cw AS (PARTITION BY i ORDER BY j))"""
_SLOPE = "degrees(atan(sqrt(gx * gx + gy * gy)))"


def _gradient_xy(s, d):
    g = focal.gradient(line12(s, d))
    return g.df.select("j", "i", whole(F.col("gx")).alias("gx"), whole(F.col("gy")).alias("gy"))


add("gradient_xy", _gradient_xy, select({"gx": "gx", "gy": "gy"}, more=_GRAD, source="d"))
on_line("slope", "data.slope", {"min_deg": 20, "max_deg": 60, "falloff_deg": 15}, select(soft(_SLOPE, 20.0, 60.0, 15.0), more=_GRAD, source="d"))
_FACE = "CASE WHEN gx * gx + gy * gy > 0 THEN (-gx * cos(radians({0})) - gy * sin(radians({0}))) / sqrt(gx * gx + gy * gy) ELSE 0.0 END"
on_line("aspect", "data.aspect", {}, select(f"CASE WHEN gx <> 0 OR gy <> 0 THEN pow(0.5 + 0.5 * ({_FACE.format(270)}), 2.0) * {smooth(0.0, 5.0, _SLOPE)} ELSE 0.0 END", more=_GRAD, source="d"))
on_line("normal_map", "output.normal_map", {"strength": 2}, select({"r": "0.5 - gx * 2.0 / n * 0.5", "g": "0.5 + gy * 2.0 / n * 0.5", "b": "0.5 + 0.5 / n", "a": "1.0"}, more=_GRAD + ", e AS (SELECT *, sqrt(gx * gx * 4.0 + gy * gy * 4.0 + 1.0) AS n FROM d)", source="e"))


def _taps_sql(name: str, src: str, sigma: float, width: int = 50, height: int = 12, cell: float = 100.0) -> str:
    """A Gaussian out to three sigmas with repeated borders, row by row and column by column."""
    out, prev = [], src
    for axis, n, other in (("i", width, "j"), ("j", height, "i")):
        s = sigma / cell
        if s < 0.2:
            continue
        far, cur = math.ceil(3 * s), f"{name}_{axis}"
        out.append(f"{cur} AS (SELECT a.{other}, a.{axis}, sum(b.v * exp(-0.5 * pow(k.o / {s!r}, 2))) / sum(exp(-0.5 * pow(k.o / {s!r}, 2))) AS v FROM {prev} a, range({-far}, {far + 1}) k(o) JOIN {prev} b ON b.{other} = a.{other} AND b.{axis} = least(greatest(a.{axis} + k.o, 0), {n - 1}) GROUP BY 1, 2)")
        prev = cur
    out.append(f"{name} AS (SELECT j, i, v AS b FROM {prev})")
    return ", ".join(out)


def _box_sql(name: str, src: str, radii: tuple[int, ...]) -> str:
    out, prev = [], src
    for axis, n, other in (("i", 50, "j"), ("j", 12, "i")):
        for t, r in enumerate(radii):
            cur = f"{name}_{axis}{t}"
            out.append(f"{cur} AS (SELECT a.{other}, a.{axis}, sum(b.v) / {2 * r + 1}.0 AS v FROM {prev} a, range({-r}, {r + 1}) k(o) JOIN {prev} b ON b.{other} = a.{other} AND b.{axis} = least(greatest(a.{axis} + k.o, 0), {n - 1}) GROUP BY 1, 2)")
            prev = cur
    out.append(f"{name} AS (SELECT j, i, v AS b FROM {prev})")
    return ", ".join(out)


_JOINED = ", z AS (SELECT g.j, g.i, v, b FROM g JOIN f ON f.j = g.j AND f.i = g.i)"
on_line("blur_taps", "adjust.blur", {"radius_m": 300, "strength": 0.5}, select("v + (b - v) * 0.5", more=_taps_sql("f", "g", 150.0) + _JOINED, source="z"))
on_line("blur_box", "adjust.blur", {"radius_m": 1500}, select("b", more=_box_sql("f", "g", (7, 7, 7)) + _JOINED, source="z"))
on_line("sharpen", "adjust.sharpen", {"radius_m": 400}, select("v + (v - b)", more=_taps_sql("f", "g", 200.0) + _JOINED, source="z"))
on_line("curvature", "data.curvature", {"mode": "both", "radius_m": 300, "range_m": 400}, select("least(greatest((v - b) / 400.0 * 0.5 + 0.5, 0.0), 1.0)", more=_taps_sql("f", "g", 150.0) + _JOINED, source="z"))
on_line("occlusion", "data.occlusion", {"radius_m": 400}, select("least(greatest(1.0 - 4.0 * ((greatest(f.b - v, 0.0) / 100.0 + greatest(f2.b - v, 0.0) / 200.0 + greatest(f3.b - v, 0.0) / 400.0) / 3.0), 0.0), 1.0)", more=f"{_taps_sql('f', 'g', 100.0)}, {_taps_sql('f2', 'g', 200.0)}, {_taps_sql('f3', 'g', 400.0)}", source="g JOIN f USING (j, i) JOIN f2 USING (j, i) JOIN f3 USING (j, i)"))
add("dilate", lambda s, d: numbers(focal.dilate(line12(s, d))), select("v", more="p AS (SELECT a.j, a.i, max(b.v) AS v FROM g a JOIN g b ON abs(a.j - b.j) <= 1 AND abs(a.i - b.i) <= 1 GROUP BY 1, 2)", source="p"))
add("relief", lambda s, d: numbers(focal.relief(line12(s, d))), select("(v - b) / 40.0", more=_taps_sql("f", "g", 120.0) + _JOINED, source="z"))
_NEAR = "n AS (SELECT a.j, a.i, sqrt(min(pow((a.i - b.i) * 100.0, 2) + pow((a.j - b.j) * 100.0, 2))) AS d FROM g a, g b WHERE {0} GROUP BY 1, 2)"
on_line("distance_outside", "data.distance", {"threshold": 0.5, "distance_m": 1500}, select("greatest(1.0 - d / 1500.0, 0.0)", more=_NEAR.format("b.v / 2000.0 > 0.5"), source="n"))
on_line("distance_inside", "data.distance", {"mode": "inside", "threshold": 0.3, "distance_m": 1500, "profile": "smooth", "invert": True}, select(f"1.0 - {smooth(0.0, 1.0, '(d / 1500.0)')}", more=_NEAR.format("NOT b.v / 2000.0 > 0.3"), source="n"))
add("waterline", lambda s, d: numbers(focal.waterline_band(line12(s, d), F.col("v") < 500.0, 800.0)), select(f"1.0 - {smooth(0.0, 800.0, 'd')}", more=_NEAR.format("b.v < 500.0"), source="n"))
_SNOW = f"w AS (SELECT j, i, v, {smooth(400.0, 700.0, f'(v + 150.0 * ({_FACE.format(270)}))')} * (1.0 - {smooth(75.0, 85.0, _SLOPE)}) AS s FROM d), h AS (SELECT j, i, s AS v FROM w)"
on_line("snow", "simulate.snow", {"snow_line_m": 550, "transition_m": 300, "max_slope_deg": 80, "shade_m": 150, "smoothing_m": 300}, select("least(greatest((b - 0.2) / 0.8, 0.0), 1.0)", more=f"{_GRAD}, {_SNOW}, {_taps_sql('f', 'h', 150.0)}", source="f"), port="snow")
add("crop", lambda s, d: numbers(line12(s, d).crop(10, 3, 20, 5)), select("v") + " WHERE i BETWEEN 10 AND 29 AND j BETWEEN 3 AND 7")

_BILINEAR = """q AS (SELECT *, least(greatest(sx / 4900.0 * 49.0, 0.0), 49.0) AS fx, least(greatest(sy / 1100.0 * 11.0, 0.0), 11.0) AS fy FROM p),
 c AS (SELECT *, CAST(least(floor(fx), 48) AS INTEGER) AS ci, CAST(least(floor(fy), 10) AS INTEGER) AS cj FROM q),
 e AS (SELECT c.j, c.i, (a.v + (b.v - a.v) * (fx - ci)) + ((k.v + (l.v - k.v) * (fx - ci)) - (a.v + (b.v - a.v) * (fx - ci))) * (fy - cj) AS v
 FROM c JOIN g a ON a.j = cj AND a.i = ci JOIN g b ON b.j = cj AND b.i = ci + 1 JOIN g k ON k.j = cj + 1 AND k.i = ci JOIN g l ON l.j = cj + 1 AND l.i = ci + 1)"""
_FINE = "p AS (SELECT CAST(b AS INTEGER) AS j, CAST(a AS INTEGER) AS i, 4900.0 * (a / 70.0) AS sx, 1100.0 * (b / 25.0) AS sy FROM range(71) t(a), range(26) u(b))"
_FINE_SPEC = GridSpec(71, 26, (4900.0, 1100.0))
add("bilinear", lambda s, d: numbers(focal.onto(line12(s, d), _FINE_SPEC)), select("v", more=f"{_FINE}, {_BILINEAR}", source="e"))
add("nearest", lambda s, d: numbers(focal.onto(line12(s, d), _FINE_SPEC, nearest=True)), select("v", more=f"{_FINE}, e AS (SELECT p.j, p.i, g.v FROM p JOIN g ON g.i = CAST(floor(sx / 4900.0 * 49.0 + 0.5) AS INTEGER) AND g.j = CAST(floor(sy / 1100.0 * 11.0 + 0.5) AS INTEGER))", source="e"))
_MOVED = f"p AS (SELECT j, i, 2450.0 + (({DX} - 300.0) * cos(radians(-15)) - {DY} * sin(radians(-15))) / 1.25 AS sx, 550.0 + (({DX} - 300.0) * sin(radians(-15)) + {DY} * cos(radians(-15))) / 1.25 AS sy FROM g)"
on_line("transform", "adjust.transform", {"move_x_m": 300, "rotation_deg": 15, "scale": 1.25, "height_scale": 0.5}, select("v * 0.5", more=f"{_MOVED}, {_BILINEAR}", source="e", scale=1e4), scale=1e4)
on_line("warp", "adjust.warp", {"strength_m": 200}, select("v", more=", ".join([_on("wa", "g", f"({X} / 1500.0)", f"({Y} / 1500.0)", 4, 1), _on("wb", "g", f"({X} / 1500.0)", f"({Y} / 1500.0)", 4, 2), "p AS (SELECT a.j, a.i, " + X.replace("i /", "a.i /") + " + 200.0 * a.n AS sx, " + Y.replace("j /", "a.j /") + " + 200.0 * b.n AS sy FROM wa a JOIN wb b USING (j, i))", _BILINEAR]), source="e", scale=1e4), scale=1e4)
_COARSE = GridSpec(25, 6, (4900.0, 1100.0))
_COARSE_SQL = "p AS (SELECT CAST(b AS INTEGER) AS j, CAST(a AS INTEGER) AS i, 4900.0 * (a / 24.0) AS sx, 1100.0 * (b / 5.0) AS sy FROM range(25) t(a), range(6) u(b))"
_SOFT = _taps_sql("f", "g", 0.5 * max(_COARSE.cell)) + ", s AS (SELECT j, i, b AS v FROM f)"
add("resample", lambda s, d: numbers(focal.resample(line12(s, d), _COARSE)), select("v", more=f"{_SOFT}, {_COARSE_SQL}, {_BILINEAR.replace('JOIN g ', 'JOIN s ')}", source="e"))


def _detail(s, d):
    g = line12(s, d)
    low = focal.onto(g, _COARSE)
    return numbers(focal.upsample_detail(g, low, low.cells(F.col("v") * 1.5)))


_LOW = f"low AS (SELECT * FROM (WITH {_COARSE_SQL}, {_BILINEAR} SELECT j, i, v * 0.5 AS v FROM e))"
_UP = f"""up AS (SELECT * FROM (WITH p AS (SELECT j, i, {X} AS sx, {Y} AS sy FROM g), q AS (SELECT *, least(greatest(sx / 4900.0 * 24.0, 0.0), 24.0) AS fx, least(greatest(sy / 1100.0 * 5.0, 0.0), 5.0) AS fy FROM p),
 c AS (SELECT *, CAST(least(floor(fx), 23) AS INTEGER) AS ci, CAST(least(floor(fy), 4) AS INTEGER) AS cj FROM q)
 SELECT c.j, c.i, (a.v + (b.v - a.v) * (fx - ci)) + ((k.v + (l.v - k.v) * (fx - ci)) - (a.v + (b.v - a.v) * (fx - ci))) * (fy - cj) AS v
 FROM c JOIN low a ON a.j = cj AND a.i = ci JOIN low b ON b.j = cj AND b.i = ci + 1 JOIN low k ON k.j = cj + 1 AND k.i = ci JOIN low l ON l.j = cj + 1 AND l.i = ci + 1))"""
add("upsample_detail", _detail, select("g.v + up.v", more=f"{_LOW}, {_UP}", source="g JOIN up USING (j, i)"))

# Water: whole-world operators.

_STEEP = """nb AS (SELECT a.j, a.i, a.v, b.j * 50 + b.i AS t, (a.v - b.v) / (100.0 * sqrt(pow(a.i - b.i, 2) + pow(a.j - b.j, 2))) AS s,
 CASE (b.j - a.j) * 3 + (b.i - a.i) WHEN -1 THEN 0 WHEN 1 THEN 1 WHEN -3 THEN 2 WHEN 3 THEN 3 WHEN -4 THEN 4 WHEN -2 THEN 5 WHEN 2 THEN 6 ELSE 7 END AS k
 FROM g a JOIN g b ON abs(a.j - b.j) <= 1 AND abs(a.i - b.i) <= 1 AND (a.j <> b.j OR a.i <> b.i)),
 rc AS (SELECT j, i, j * 50 + i AS me, CASE WHEN max(s) > 0 THEN arg_min(t, (-s, k)) ELSE j * 50 + i END AS r FROM nb GROUP BY j, i)"""


def _receiver(s, d):
    return water.d8_receiver(line12(s, d)).df.select("j", "i", F.col("to").alias("v"))


add("d8_receiver", _receiver, f"WITH {LINE}, {_STEEP.replace('arg_min(t, (-s, k))', 'arg_min(t, {{a: -s, b: k}})')} SELECT j, i, CAST(r AS BIGINT) AS v FROM rc".replace("{{", "{").replace("}}", "}"))


def _drained(s, d):
    r = water.drained(line12(s, d))
    return r.df.select("j", "i", F.round("area").cast("long").alias("area"), F.col("outlet").cast("long").alias("outlet"))


_ROUTE = ", ".join([water_sql.base(), "land0 AS (SELECT c, h AS x FROM cells)", water_sql.routed("way", "land0")])
_AREA8 = water_sql.gathered("area", water_sql.d8_edges("way"), "10000.0::DOUBLE")
_AREA2 = ", ".join([water_sql.split("two", "way"), water_sql.gathered("area", water_sql.split_edges("two"), "10000.0::DOUBLE")])
add("drained", _drained, f"WITH RECURSIVE {LINE}, {_ROUTE}, {_AREA8}, {water_sql.ends('outlet', 'way')} SELECT j, i, CAST(round(area.x) AS BIGINT) AS area, CAST(outlet.x AS BIGINT) AS outlet FROM cells JOIN area USING (c) JOIN outlet USING (c)")


def watery(e: str | dict[str, str], *more: str, source: str, scale: float = 1e5) -> str:
    return select(e, more=", ".join([_ROUTE, *more]), source=source, scale=scale, recursive=True)


_STRONG = f"bright AS (SELECT c, {water_sql.log_mask('x', 5e3, 5e7)} AS v FROM area), wide AS (SELECT m.j, m.i, greatest(any_value(o.v), max(b.v)) AS v FROM cells m JOIN bright o ON o.c = m.c JOIN links e ON e.c = m.c JOIN bright b ON b.c = e.t GROUP BY m.j, m.i), " + _taps_sql("f", "wide", 50.0)
for _method, _area, _angle in (("dinf", _AREA2, "angle"), ("d8", _AREA8 + ", " + water_sql.split("two", "way"), "plain")):
    on_line(f"flow_{_method}", "data.flow", {"method": _method}, watery("b", _area, _STRONG, source="f"), port="accumulation", scale=1e5)
    on_line(f"flow_direction_{_method}", "data.flow", {"method": _method}, watery(f"{_angle} / 360.0", _area, source="(SELECT j, i, two.* FROM two JOIN cells USING (c))"), port="direction", scale=1e5)
on_line("flow_basins", "data.flow", {}, watery("b_u", water_sql.ends("outlet", "way"), water_sql.unit_of("(SELECT j, i, x FROM outlet JOIN cells USING (c))", "b", f"xor(CAST(x AS UBIGINT), {0xBA515EED}::UBIGINT)"), source="b"), port="basins", scale=1e5)
_DAMP = f"{_GRAD}, damp AS (SELECT j, i, {_clamp('(ln(area.x / 100.0 / greatest(sqrt(gx * gx + gy * gy), 1e-3)) - 4.0) / 10.0')} AS v FROM area JOIN cells USING (c) JOIN d USING (j, i)), " + _taps_sql("f", "damp", 50.0)
_FARS = "far AS (SELECT a.j, a.i, least(min(sqrt(pow(a.i - b.i, 2) + pow(a.j - b.j, 2)) * 100.0) / 350.0, 1.0) AS d FROM cells a, cells b JOIN area USING (c) WHERE area.x >= 1e5 GROUP BY a.j, a.i)"
for _port, _e in (("wetness", f"1.0 - (1.0 - b) * {smooth(0.0, 1.0, 'd')}"), ("water_distance", "d")):
    on_line("wetness" if _port == "wetness" else "wetness_distance", "data.wetness", {"stream_area_km2": 0.1, "reach_m": 350}, watery(_e, _AREA2, _DAMP, _FARS, source="f JOIN far USING (j, i)"), port=_port, scale=1e5)
_LAKES = water_sql.lakes("held", 20.0, 15000.0) + ", seen AS (SELECT j, i, h, coalesce(level, -1e9) AS level, coalesce(depth, 0.0) AS depth FROM cells LEFT JOIN held USING (c))"
_SHORE = "edge AS (SELECT j, i, least(greatest((level - h) / 0.1, 0.0), 1.0) >= 0.5 AS wet FROM seen), line AS (SELECT a.j, a.i, any_value(a.wet) AS wet, min(sqrt(pow(a.i - b.i, 2) + pow(a.j - b.j, 2)) * 100.0) AS d FROM edge a, edge b WHERE a.wet <> b.wet GROUP BY a.j, a.i)"
for _port, _e in (("height", "CASE WHEN level > h THEN greatest(h, level - 0.7 * depth) ELSE h END"), ("water_surface", "greatest(level, h)"), ("lakes", _clamp("(level - h) / 0.1")), ("shore", f"1.0 - {smooth(0.0, 250.0, 'd')}")):
    on_line(f"lakes_{_port}", "simulate.lakes", {"min_depth_m": 20, "min_area_m2": 15000, "shore_width_m": 250}, watery(_e, _LAKES, *([_SHORE] if _port == "shore" else []), source="line" if _port == "shore" else "seen"), port=_port, scale=1e5)
_RIVER = {"source_area_km2": 0.08, "width_m": 260, "depth_m": 20, "bank_width_m": 90, "meander_m": 60}
_CARVED = ", ".join([
    water_sql.reaches("way", "area", SEED, 8e4, 260.0, 20.0, 60.0),
    "met0 AS (SELECT c, h, p.*, least(greatest(((i * 100.0 - x0) * (x1 - x0) + (j * 100.0 - y0) * (y1 - y0)) / greatest(pow(x1 - x0, 2) + pow(y1 - y0, 2), 1e-9), 0.0), 1.0) AS t, i * 100.0 AS px, j * 100.0 AS py FROM cells, reach p)",
    "met1 AS (SELECT c, h, sqrt(pow(px - x0 - t * (x1 - x0), 2) + pow(py - y0 - t * (y1 - y0), 2)) AS d, level0 + t * (level1 - level0) AS level, half0 + t * (half1 - half0) AS half, deep0 + t * (deep1 - deep0) AS deep FROM met0)",
    f"met AS (SELECT *, {smooth(0.0, 1.0, '((d - half) / 90.0)')} AS up FROM met1 WHERE d < half + 90.0)",
    "per AS (SELECT c, min(least(h, CASE WHEN d < half THEN level - deep * (1.0 - pow(d / half, 2)) ELSE level + (h - level) * up END)) AS bed, max(least(greatest((half - d) / 100.0 + 0.5, 0.0), 1.0)) AS cover, max(CASE WHEN d < half THEN level END) AS water, max(CASE WHEN d >= half THEN 1.0 - up END) AS bank FROM met GROUP BY c)",
    "cut AS (SELECT j, i, coalesce(bed, h) AS bed, coalesce(cover, 0.0) AS cover, coalesce(water, -1e9) AS water, coalesce(bank, 0.0) AS bank FROM cells LEFT JOIN per USING (c))",
])
for _port, _e in (("height", "bed"), ("water_surface", "greatest(bed, water)"), ("river", "cover"), ("riverbank", "bank * (1.0 - cover)")):
    on_line(f"rivers_{_port}", "simulate.rivers", _RIVER, watery(_e, _AREA8, _CARVED, source="cut", scale=1e4), port=_port, scale=1e4)
_CREEP = math.sqrt(2.0 * 0.002 * 25000.0)
_WORN = water_sql.eroded(2, 25000.0, lambda name, src: _taps_sql(name, src, _CREEP))
for _port, _e in (("height", "x"), ("wear", "greatest(h - x, 0.0) / (30.0 + greatest(h - x, 0.0))"), ("deposition", "greatest(x - h, 0.0) / (10.0 + greatest(x - h, 0.0))")):
    on_line(f"hydraulic_{_port}", "simulate.hydraulic", {"duration_kyr": 50}, watery(_e, _WORN, source="(SELECT j, i, h, x FROM cells JOIN ground2 USING (c))", scale=1e4), port=_port, scale=1e4)
for _port, _src, _e in (("flow", "q1", water_sql.log_mask("x", 5e3, 5e7)), ("sediment", "laid1", water_sql.log_mask("(out / 25000.0)", 1.0, 1e5))):
    on_line(f"hydraulic_{_port}", "simulate.hydraulic", {"duration_kyr": 50}, watery("b", _WORN, f"raw AS (SELECT j, i, {_e} AS v FROM {_src} JOIN cells USING (c))", _taps_sql("f", "raw", 100.0), source="f", scale=1e4), port=_port, scale=1e4)
_WET = "wet AS (SELECT j, i FROM g WHERE v < 500 AND (j IN (0, 11) OR i IN (0, 49)) UNION SELECT g.j, g.i FROM wet JOIN g ON abs(g.j - wet.j) + abs(g.i - wet.i) = 1 WHERE g.v < 500)"
on_line("sea_edges", "simulate.sea", {"sea_level_m": 500}, select("CASE WHEN w.j IS NULL THEN 0.0 ELSE least((500.0 - v) / 0.1, 1.0) END", more=_WET.replace("wet AS", "wet(j, i) AS"), source="g LEFT JOIN (SELECT j AS j, i AS i FROM wet) w USING (j, i)", recursive=True).replace("w.j IS NULL", "w.i IS NULL").replace("SELECT j AS j, i AS i FROM wet", "SELECT j, i FROM wet"), port="sea")
on_line("sea_all", "simulate.sea", {"sea_level_m": 500, "from_edges": False, "shallow_depth_m": 200}, select(f"CASE WHEN v < 500 THEN 1.0 - {smooth(0.0, 200.0, '(500.0 - v)')} ELSE 0.0 END"), port="shallow")
_FILL = """m AS (SELECT max(v) AS top FROM g), lv AS (SELECT DISTINCT v AS l FROM g),
 rch(l, j, i) AS (SELECT l, g.j, g.i FROM lv, g WHERE g.v <= l AND (g.j IN (0, 30) OR g.i IN (0, 23)) UNION SELECT rch.l, n.j, n.i FROM rch JOIN g n ON abs(n.j - rch.j) <= 1 AND abs(n.i - rch.i) <= 1 AND n.v <= rch.l),
 f AS (SELECT j, i, min(l) AS v FROM rch GROUP BY j, i)"""
add("fill_depressions", lambda s, d: numbers(water.fill_depressions(events(s, d))), select("v", EVENTS, more=_FILL, source="f", recursive=True))


def _thermal(s, d):
    g = line12(s, d)
    return numbers(apply("simulate.thermal", {"in": g}, {"duration_s": 8, "talus_angle_deg": 30, "diffusivity_m2_s": 100, "detail_m": 50})["height"])


def _thermal_sql() -> str:
    parts, prev = [], "g"
    for n in range(8):
        parts.append(f"""h{n} AS (SELECT a.j, a.i, any_value(a.v) + sum(
          greatest(b.v - a.v - tan(radians(30)) * dd, 0.0) * (100.0 * w / (dd * dd)) - greatest(a.v - b.v - tan(radians(30)) * dd, 0.0) * (100.0 * w / (dd * dd))) AS v
          FROM (SELECT a.*, b.v AS bv, 1 FROM {prev} a JOIN {prev} b ON false) z RIGHT JOIN {prev} a ON false JOIN {prev} b ON abs(a.j - b.j) <= 1 AND abs(a.i - b.i) <= 1 AND (a.j <> b.j OR a.i <> b.i),
          LATERAL (SELECT 100.0 * sqrt(pow(a.i - b.i, 2) + pow(a.j - b.j, 2)) AS dd, CASE WHEN a.i = b.i OR a.j = b.j THEN 2.0 / 3.0 ELSE 1.0 / 3.0 END AS w) q GROUP BY a.j, a.i)""".replace(f"(SELECT a.*, b.v AS bv, 1 FROM {prev} a JOIN {prev} b ON false) z RIGHT JOIN {prev} a ON false", f"{prev} a"))
        prev = f"h{n}"
    return select("v", more=", ".join(parts), source=prev)


add("thermal_steps", _thermal, _thermal_sql())
# Vegetation: density by habitat, noise and dead ground; points by nine phases of cells, three tries each.


def _habitat(slope_max: float, top: float, water: float, peaks: float, dead: float, patches: float, patch: float, spread: float, spacing: float) -> str:
    """``dens`` (j, i, v, z) of a population at its other defaults."""
    pref = f"(1.0 + (w - 1.0) * {water!r})" if water >= 0 else f"(1.0 + (1.0 - w - 1.0) * {-water!r})"
    return ", ".join([
        _GRAD, _taps_sql("soft120", "g", 120.0),
        f"site AS (SELECT d.j, d.i, d.v AS z, {_SLOPE} AS s, (d.v - b) / 40.0 AS rel FROM d JOIN soft120 USING (j, i))",
        f"site1 AS (SELECT *, {_clamp('0.5 - 0.5 * rel')} AS w, {smooth(32.0, 44.0, 's')} AS steep FROM site)",
        f"site2 AS (SELECT *, {soft('s', 0.0, slope_max, 6.0)} * {soft('z', 0.0, top, 100.0)} * {pref} * (1.0 - {peaks!r} * {_clamp('rel')}) AS home FROM site1)",
        "homes AS (SELECT j, i, home AS v FROM site2)", _taps_sql("homef", "homes", spread / 2), "steeps AS (SELECT j, i, steep AS v FROM site2)", _taps_sql("runf", "steeps", 60.0),
        _near("na", patch, 3, 1), _near("nb", max(4.0 * spacing, 4.0), 2, 2), _near("nc", 80.0, 2, 3),
        f"site3 AS (SELECT site2.*, h.b AS grown, r.b AS runout, {_clamp('na.n * 0.5 + 0.5')} AS n1, {_clamp('nb.n * 0.5 + 0.5')} AS n2, {_clamp('nc.n * 0.5 + 0.5')} AS n3 FROM site2 JOIN homef h USING (j, i) JOIN runf r USING (j, i) JOIN na USING (j, i) JOIN nb USING (j, i) JOIN nc USING (j, i))",
        f"dens AS MATERIALIZED (SELECT j, i, z, {_clamp(f"0.8 * {_clamp('(grown - 0.2) / 0.8')} * (1.0 + ({smooth(0.35, 0.65, 'n1')} - 1.0) * {patches!r}) * (1.0 + (n2 - 1.0) * 0.3) * (1.0 - {_clamp(f'{dead!r} * greatest(steep, least(runout * 1.6, 1.0) * 0.8) * (0.8 + 0.7 * n3)')})")} AS v FROM site3)",
    ])


def _scattered(spacing: float, low: float, high: float, species: str) -> str:
    """``points`` by ``dens``: cells whose side is the spacing over the root of two keep one point each."""
    side = spacing / math.sqrt(2.0)
    nx, ny = math.ceil(4900.0 / side), math.ceil(1100.0 / side)
    seed = noise_sql.sub_seed(SEED, 7)
    out = [f"sc AS (SELECT ci AS gx, cj AS gy, ci, cj FROM range({nx}) a(ci), range({ny}) b(cj))"]
    # a hash of the cell and the number of what it is for
    rolls = []
    for k in range(7):
        rolls.append(f"({k}, {seed ^ ((k * 0xD6E8FEB86659FD93) % (1 << 64))}::UBIGINT)")
    rolls += [f"({k}, {seed ^ ((k * 0xD6E8FEB86659FD93) % (1 << 64))}::UBIGINT)" for k in (10, 11)]
    out += [f"sr AS (SELECT sc.*, k, seed FROM sc, (VALUES {', '.join(rolls)}) r(k, seed))", noise_sql.lattice("sr", "sl")]
    out.append("roll AS MATERIALIZED (SELECT ci, cj, " + ", ".join(f"max(CAST(sl_h >> 11 AS DOUBLE) / 9007199254740992.0) FILTER (k = {k}) AS u{k}" for k in (*range(7), 10, 11)) + " FROM sl GROUP BY ci, cj)")
    at = lambda v, x, y: f"(SELECT q.*, least(greatest({x} / 100.0, 0.0), 49.0) AS fx, least(greatest({y} / 100.0, 0.0), 11.0) AS fy FROM {v} q)"
    lerp4 = lambda col: f"((a.{col} + (b.{col} - a.{col}) * (fx - a.i)) + ((k.{col} + (l.{col} - k.{col}) * (fx - a.i)) - (a.{col} + (b.{col} - a.{col}) * (fx - a.i))) * (fy - a.j))"
    four = "JOIN dens a ON a.j = least(floor(fy), 10) AND a.i = least(floor(fx), 48) JOIN dens b ON b.j = a.j AND b.i = a.i + 1 JOIN dens k ON k.j = a.j + 1 AND k.i = a.i JOIN dens l ON l.j = a.j + 1 AND l.i = a.i + 1"
    out.append(f"want AS MATERIALIZED (SELECT m.ci, m.cj, u1, u2, u3, u4, u5, u6, u10, u11 FROM {at('roll', f'((ci + 0.5) * {side!r})', f'((cj + 0.5) * {side!r})')} m {four} WHERE u0 < {lerp4('v')})")
    out.append("kept0 AS (SELECT ci, cj, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM want WHERE false)")
    n = 0
    for phase in range(9):
        for t in range(3):
            x, y = f"((w.ci + u{1 + 2 * t}) * {side!r})", f"((w.cj + u{2 + 2 * t}) * {side!r})"
            out.append(f"""kept{n + 1} AS MATERIALIZED (SELECT * FROM kept{n} UNION ALL SELECT w.ci, w.cj, {x}, {y} FROM want w WHERE w.ci % 3 + 3 * (w.cj % 3) = {phase} AND {x} <= 4900.0 AND {y} <= 1100.0 AND NOT EXISTS (SELECT 1 FROM kept{n} p WHERE p.ci = w.ci AND p.cj = w.cj)
 AND NOT EXISTS (SELECT 1 FROM kept{n} p WHERE p.ci BETWEEN w.ci - 2 AND w.ci + 2 AND p.cj BETWEEN w.cj - 2 AND w.cj + 2 AND abs(p.ci - w.ci) + abs(p.cj - w.cj) < 4 AND pow(p.x - {x}, 2) + pow(p.y - {y}, 2) < {spacing * spacing!r}))""")
            n += 1
    out.append(f"points AS (SELECT x, y, {lerp4('z')} AS z, u10 * 360.0 AS turn, {low!r} + {high - low!r} * u11 AS scale, '{species}' AS species FROM {at(f'(SELECT p.*, u10, u11 FROM kept{n} p JOIN want USING (ci, cj))', 'x', 'y')} m {four})")
    return ", ".join(out)


_POINT_COLUMNS = {"x": "x_m", "y": "y_m", "z": "z_m", "turn": "rotation_deg", "scale": "scale"}


def _placed(type_id: str, params: dict):
    def run(s, d):
        df = apply(type_id, {"in": line12(s, d)}, params, seed=SEED)["points"]
        return df.select(*(whole(F.col(c), 1e4).alias(n) for n, c in _POINT_COLUMNS.items()), "species")

    return run


_PLACED = "SELECT " + ", ".join(f"{sql_whole(n, 1e4)} AS {n}" for n in _POINT_COLUMNS) + ", species FROM points"
for _kind, _own, _low, _high, _params, _args in (
    ("trees", "tree", 0.8, 1.2, {"height_max_m": 1000, "slope_max_deg": 80, "spacing_m": 60}, (80.0, 1000.0, 0.2, 0.4, 0.5, 0.4, 150.0, 20.0, 60.0)),
    ("shrubs", "shrub", 0.7, 1.3, {"slope_max_deg": 80, "spacing_m": 60, "spread_m": 90, "water_preference": -0.4}, (80.0, 1800.0, -0.4, 0.2, 0.3, 0.5, 60.0, 90.0, 60.0)),
    ("grass", "grass", 0.6, 1.4, {"slope_max_deg": 80, "spacing_m": 50}, (80.0, 2200.0, 0.3, 0.0, 0.2, 0.3, 40.0, 5.0, 50.0)),
):
    on_line(f"{_kind}_density", f"vegetation.{_kind}", _params, select("v", more=_habitat(*_args), source="dens", scale=1e4), port="density", scale=1e4)
    add(f"{_kind}_points", _placed(f"vegetation.{_kind}", _params), f"WITH {LINE}, {_habitat(*_args)}, {_scattered(_params['spacing_m'], _low, _high, _own)} {_PLACED}")
_ROCKS = ", ".join([
    _GRAD, f"shed AS (SELECT j, i, v AS z, {smooth(26.0, 40.0, _SLOPE)} AS v FROM d)", _taps_sql("rolled", "shed", 40.0), _near("na", 40.0, 3, 1),
    f"dens AS MATERIALIZED (SELECT shed.j, shed.i, z, {_clamp(f"{_clamp('least(b * 1.8, 1.0) * (1.0 - 0.7 * shed.v)')} * (1.0 + ({smooth(0.35, 0.65, _clamp('na.n * 0.5 + 0.5'))} - 1.0) * 0.4)")} AS v FROM shed JOIN rolled USING (j, i) JOIN na USING (j, i))",
])
on_line("debris_density", "vegetation.debris", {"spacing_m": 40, "coverage": 1.0}, select("v", more=_ROCKS, source="dens", scale=1e4), port="density", scale=1e4)
add("debris_points", _placed("vegetation.debris", {"spacing_m": 40, "coverage": 1.0}), f"WITH {LINE}, {_ROCKS}, {_scattered(40.0, 0.5, 2.0, 'rock')} {_PLACED}")

# Points, sinks, overlays.

_CUST = "p AS (SELECT CAST(c_custkey AS DOUBLE) AS x_m, c_acctbal AS y_m, c_acctbal / 10.0 AS z_m, CAST(c_custkey % 360 AS DOUBLE) AS rotation_deg, 1.0 AS scale, c_mktsegment AS species FROM customer)"
add("points_within", lambda s, d: points.within(customers(s, d), 10.0, 0.0, 120.0, 5000.0).select(F.col("x_m").cast("long").alias("x"), whole(F.col("y_m"), 100.0).alias("y")), f"WITH {_CUST} SELECT CAST(x_m AS BIGINT) AS x, {sql_whole('y_m', 100.0)} AS y FROM p WHERE x_m BETWEEN 10 AND 120 AND y_m BETWEEN 0 AND 5000")
add("points_owned", lambda s, d: points.owned(customers(s, d), 10.0, 0.0, 120.0, 5000.0, False, True).select(F.col("x_m").cast("long").alias("x")), f"WITH {_CUST} SELECT CAST(x_m AS BIGINT) AS x FROM p WHERE x_m >= 10 AND x_m < 120 AND y_m BETWEEN 0 AND 5000")
add("points_range", lambda s, d: points.z_range(customers(s, d)).select(whole(F.col("low"), 1e3).alias("low"), whole(F.col("high"), 1e3).alias("high"), "n"), f"WITH {_CUST} SELECT {sql_whole('min(z_m)', 1e3)} AS low, {sql_whole('max(z_m)', 1e3)} AS high, count(*) AS n FROM p")
add("points_raster", lambda s, d: numbers(points.rasterise(customers(s, d), line12(s, d))), select("CASE WHEN h.j IS NULL THEN 0.0 ELSE 1.0 END", more=f"{_CUST}, h AS (SELECT DISTINCT CAST(floor(least(greatest(y_m / 1100.0 * 11.0, 0.0), 11.0) + 0.5) AS INTEGER) AS j, CAST(floor(least(greatest(x_m / 4900.0 * 49.0, 0.0), 49.0) + 0.5) AS INTEGER) AS i FROM p)", source="(SELECT g.j, g.i, h.j AS hj FROM g LEFT JOIN h ON h.j = g.j AND h.i = g.i)").replace("h.j IS NULL", "hj IS NULL"))
add("points_csv", lambda s, d: sinks.csv_points(customers(s, d)), f"WITH {_CUST} SELECT printf('%.3f,%.3f,%.3f,%.2f,%.4f,%s', x_m, y_m, z_m, rotation_deg, scale, species) AS line FROM p".replace("1.0 AS scale", "CAST(1.0 AS DOUBLE) AS scale"))
add("thin", lambda s, d: points.thin(customers(s, d), 200, ["x_m"]).select(F.col("x_m").cast("long").alias("x"), "species"), f"WITH {_CUST}, n AS (SELECT greatest(1, CAST(ceil(ln(greatest(count(*), 1) / 4096.0) / ln(16)) AS INTEGER)) AS digits FROM p), r AS (SELECT x_m, species, row_number() OVER (PARTITION BY species ORDER BY substr(md5(CAST(x_m AS VARCHAR)), 1, digits), x_m) - 1 AS k, count(*) OVER (PARTITION BY species) AS m FROM p, n), q AS (SELECT 200 // count(DISTINCT species) AS share FROM p) SELECT CAST(x_m AS BIGINT) AS x, species FROM r, q WHERE k % CAST(ceil(m / share) AS BIGINT) = 0")
add("minmax", lambda s, d: line12(s, d).min_max().select(whole(F.col("low")).alias("low"), whole(F.col("high")).alias("high")), f"WITH {LINE} SELECT {sql_whole('min(v)')} AS low, {sql_whole('max(v)')} AS high FROM g")
add("mean", lambda s, d: line12(s, d).mean().select(whole(F.col("mean"), 1e4).alias("mean")), f"WITH {LINE} SELECT {sql_whole('avg(v)', 1e4)} AS mean FROM g")
add("probe", lambda s, d: line12(s, d).probe(1234.0, 567.0).select(whole(F.col("v")).alias("v")), f"WITH {LINE} SELECT {sql_whole('sum(v * (1.0 - abs(i - 12.34)) * (1.0 - abs(j - 5.67)))')} AS v FROM g WHERE i IN (12, 13) AND j IN (5, 6)")
for _bits in (16, 8):
    add(f"png{_bits}", lambda s, d, b=_bits: sinks.png_cells(line12(s, d), b), f"WITH {LINE} SELECT j, i, CAST(floor({_T} * {(1 << _bits) - 1}.0 + 0.5) AS INTEGER) AS v FROM g")
add("tile_files", lambda s, d: sinks.tile_cells(line12(s, d), 8).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), whole(F.min("v")).alias("low"), whole(F.max("v")).alias("high"), F.sum(whole(F.col("v")) * (F.col("j") * 50 + F.col("i"))).alias("all")), f"WITH {LINE}, t AS (SELECT unnest(range(greatest(CAST(ceil((i - 7) / 7.0) AS BIGINT), 0), least(i // 7, 6) + 1)) AS tx, j, i, v FROM g), u AS (SELECT tx, j, i, v, unnest(range(greatest(CAST(ceil((j - 7) / 7.0) AS BIGINT), 0), least(j // 7, 1) + 1)) AS ty FROM t) SELECT CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, count(*) AS n, {sql_whole('min(v)')} AS low, {sql_whole('max(v)')} AS high, CAST(sum({sql_whole('v')} * (j * 50 + i)) AS BIGINT) AS all FROM u GROUP BY 1, 2".replace("AS all", 'AS "all"'))


def _tiles(s, d):
    """Cells by the tile that owns them, tiles of 16 x 16 with short ones merged."""
    g = line12(s, d)
    ti, tj = sinks.tile_number(g.spec, 16)
    return g.df.groupBy(ti.alias("ti"), tj.alias("tj")).agg(F.count(F.lit(1)).alias("n"), whole(F.min("v")).alias("low"), whole(F.max("v")).alias("high"))


add("tiles", _tiles, f"WITH {LINE} SELECT CAST(least(i // 16, 3) AS INTEGER) AS ti, CAST(j // 16 AS INTEGER) AS tj, count(*) AS n, {sql_whole('min(v)')} AS low, {sql_whole('max(v)')} AS high FROM g GROUP BY 1, 2")


def _summary(s, d):
    g = line12(s, d)
    df = sinks.build_summary({"height": g, "mask": g.to(MASK), "people": customers(s, d)}, g.world, g.spec)
    return df.select("output", "kind", "count", whole(F.col("low"), 1e3).alias("low"), whole(F.col("high"), 1e3).alias("high"), whole(F.col("cell_m")).alias("cell"), "seed")


_ROW = "SELECT '{0}' AS output, '{1}' AS kind, count(*) AS count, {2} AS low, {3} AS high, CAST(100000000 AS BIGINT) AS cell, CAST(12345 AS BIGINT) AS seed FROM {4}"
add("build_summary", _summary, f"WITH {LINE}, {_CUST} " + " UNION ALL ".join(_ROW.format(n, k, sql_whole(f"min({e})", 1e3), sql_whole(f"max({e})", 1e3), t) for n, k, e, t in (("height", "height", "v", "g"), ("mask", "mask", "v / 2000.0", "g"), ("people", "points", "z_m", "p"))))
add("sanitise", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", sinks.sanitised(F.concat_ws("/ ", "p_name", "p_type", "p_brand")).alias("name")), "SELECT p_partkey, trim(regexp_replace(lower(p_name || '/ ' || p_type || '/ ' || p_brand), '[^0-9a-z-]', '_', 'g'), '_') AS name FROM part")
add("water_overlay", lambda s, d: numbers(water_overlay(line12(s, d), [line12(s, d).cells(F.lit(500.0)), line12(s, d).cells(F.lit(700.0) - F.col("i") * 10.0)])), select("greatest(CASE WHEN 500.0 > v + 0.01 THEN 500.0 ELSE -1e6 END, CASE WHEN 700.0 - i * 10.0 > v + 0.01 THEN 700.0 - i * 10.0 ELSE -1e6 END)"))
add("snow_overlay", lambda s, d: numbers(snow_overlay(list(_masks(s, d)))), select("greatest(v / 2000.0, j / 11.0, i / 49.0, 0.0)"))
add("ecosystem_view", lambda s, d: numbers(ecosystem_view(*_masks(s, d))), select({"r": "v / 2000.0", "g": "j / 11.0", "b": "i / 49.0", "a": "1.0"}))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Where prices are both high and changing fast: Levels and Slope, masked, combined, in 16-bit steps."""
    g = line12(s, d)
    level = apply("adjust.levels", {"in": g})["out"]
    steep = apply("data.slope", {"in": level}, {"min_deg": 25, "max_deg": 90, "falloff_deg": 20})["out"]
    high = apply("data.height_mask", {"in": level}, {"low_m": 800, "high_m": 2000, "falloff_m": 300})["out"]
    both = apply("combine.combine", {"a": steep, "b": high}, {"mode": "multiply"})["out"]
    return sinks.png_cells(both, 16)


_LEVEL = f"r AS (SELECT min(v) AS lo, max(v) AS hi FROM g), l AS (SELECT j, i, (v - lo) / (hi - lo) * 2000.0 AS v FROM g, r), {_GRAD.replace('FROM g WINDOW', 'FROM l WINDOW')}"
add("flagship", flagship, f"WITH {LINE}, {_LEVEL} SELECT j, i, CAST(floor(least(greatest({soft(_SLOPE, 25.0, 90.0, 20.0)} * {soft('v', 800.0, 2000.0, 300.0)}, 0.0), 1.0) * 65535.0 + 0.5) AS INTEGER) AS v FROM d")
