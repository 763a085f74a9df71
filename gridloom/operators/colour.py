"""Colour rasters: painting masks, blending layers, and packing masks into channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cells import clamp, gradient_value, lerp
from ..plans.params import Param, choice, flag, number
from .base import CHANNELS, COLOUR, HEIGHT, MASK, OUT_C, C, Call, H, M, Port, Raster, operator
from .sources import file_cells

# Stops (t, r, g, b) of the built-in gradients, sRGB.
GRADIENTS = {
    "terrain": [(0.00, 0.20, 0.27, 0.13), (0.30, 0.36, 0.40, 0.20), (0.55, 0.47, 0.41, 0.31), (0.78, 0.55, 0.53, 0.50), (0.90, 0.88, 0.89, 0.91), (1.00, 0.97, 0.98, 1.00)],
    "grass": [(0.00, 0.13, 0.22, 0.08), (0.50, 0.28, 0.40, 0.14), (1.00, 0.55, 0.58, 0.28)],
    "rock": [(0.00, 0.22, 0.20, 0.18), (0.50, 0.42, 0.39, 0.35), (1.00, 0.66, 0.64, 0.60)],
    "sand": [(0.00, 0.55, 0.45, 0.31), (0.50, 0.76, 0.66, 0.48), (1.00, 0.91, 0.85, 0.70)],
    "snow": [(0.00, 0.62, 0.68, 0.78), (0.60, 0.88, 0.90, 0.94), (1.00, 0.98, 0.99, 1.00)],
    "desert": [(0.00, 0.42, 0.22, 0.13), (0.40, 0.70, 0.40, 0.22), (0.75, 0.84, 0.60, 0.38), (1.00, 0.93, 0.80, 0.62)],
    "water": [(0.00, 0.02, 0.10, 0.20), (0.60, 0.08, 0.30, 0.40), (1.00, 0.35, 0.60, 0.58)],
}


@operator("colour.colourise", (M(),), OUT_C, (choice("preset", *GRADIENTS, "custom"), Param("gradient", "gradient", [(0, 0, 0, 0), (1, 1, 1, 1)]), number("low", 0), number("high", 1)))
def colourise(c: Call):
    p = c.params
    span = p["high"] - p["low"]
    t = clamp((F.col("in") - p["low"]) / (span if abs(span) > 1e-9 else 1.0))
    stops = p["gradient"] if p["preset"] == "custom" else GRADIENTS[p["preset"]]
    return {"out": c.frame().colours(*(gradient_value(t, stops, k) for k in range(3)), F.lit(1.0))}


def _mixed(mode: str, a: Column, b: Column) -> Column:
    if mode == "multiply":
        return a * b
    if mode == "screen":
        return 1.0 - (1.0 - a) * (1.0 - b)
    if mode == "overlay":
        return F.when(a < 0.5, 2.0 * a * b).otherwise(1.0 - 2.0 * (1.0 - a) * (1.0 - b))
    return b


def _painted(under: dict[str, Column], over: dict[str, Column], k: Column, mode: str = "normal") -> dict[str, Column]:
    out = {n: lerp(under[n], _mixed(mode, under[n], over[n]), k) for n in "rgb"}
    return out | {"a": under["a"] + (1.0 - under["a"]) * k}


def _layer(name: str) -> dict[str, Column]:
    return {n: F.col(f"{name}_{n}") for n in CHANNELS}


@operator("colour.blend", (C("a"), C("b"), M("mask", True)), OUT_C, (choice("mode", "normal", "multiply", "screen", "overlay"), number("opacity", 1, 0, 1, drivable=True)))
def blend(c: Call):
    k = clamp((clamp(F.col("mask")) if c.has("mask") else F.lit(1.0)) * c.value("opacity") * F.col("b_a"))
    return {"out": c.frame().colours(*_painted(_layer("a"), _layer("b"), k, c.params["mode"]).values())}


@operator("colour.layers", (C("base"), *(Port(f"{kind}{k}", t, True) for k in range(1, 5) for kind, t in (("colour", COLOUR), ("mask", MASK)))), OUT_C)
def layers(c: Call):
    """Up to four colours painted over a base, in order, each through its mask."""
    out = _layer("base")
    for k in range(1, 5):
        if c.has(f"colour{k}"):
            over = _layer(f"colour{k}")
            mask = clamp(F.col(f"mask{k}")) if c.has(f"mask{k}") else F.lit(1.0)
            out = _painted(out, over, clamp(mask * over["a"]))
    return {"out": c.frame().colours(*out.values())}


@operator("colour.image", (C("image", optional=True),), OUT_C, (Param("path", "file", ""), flag("flip_y", False), number("brightness", 1, 0, 10), number("saturation", 1, 0, 10)), reach=None)
def image(c: Call):
    """A colour image stretched over the world, or the cells of one that is decoded already, with brightness and saturation."""
    p = c.params
    if c.has("image"):
        g, px = c.frame(), _layer("image")
        j = F.lit(c.spec.height - 1) - F.col("j") if p["flip_y"] else F.col("j")
    else:
        g, px, j = file_cells(c, p["flip_y"], COLOUR)[0], {n: F.col(n) for n in CHANNELS}, F.col("j")
    grey = (px["r"] + px["g"] + px["b"]) / 3.0
    rgb = [clamp((grey + (px[n] - grey) * p["saturation"]) * p["brightness"]) for n in "rgb"]
    moved = g.df.select(j.cast("int").alias("j"), "i", *(v.alias(n) for v, n in zip([*rgb, px["a"]], CHANNELS, strict=True)))
    return {"out": Raster(moved, c.spec, c.world, COLOUR)}


@operator("output.pack_masks", tuple(M(n, True) for n in CHANNELS), OUT_C)
def pack_masks(c: Call):
    return {"out": c.frame().colours(*(clamp(F.col(n)) if c.has(n) else F.lit(0.0) for n in CHANNELS))}


@operator("output.splat", tuple(M(f"layer{k}", True) for k in range(1, 9)), (C("weights_1_4"), C("weights_5_8"), *(M(f"weight_{k}") for k in range(1, 9))))
def splat(c: Call):
    """Weights that sum to 1: an unconnected first layer fills what is left, cells without any go to it."""
    raw = {k: clamp(F.col(f"layer{k}")) if c.has(f"layer{k}") else F.lit(0.0) for k in range(1, 9)}
    if not c.has("layer1"):
        raw[1] = F.greatest(1.0 - sum((raw[k] for k in range(3, 9)), raw[2]), F.lit(0.0))
    total = sum((raw[k] for k in range(2, 9)), raw[1])
    weight = {k: F.when(total > 0, v / total).otherwise(1.0 if k == 1 else 0.0) for k, v in raw.items()}
    g = c.frame()
    out = {f"weight_{k}": g.cells(v, MASK) for k, v in weight.items()}
    return out | {"weights_1_4": g.colours(*(weight[k] for k in range(1, 5))), "weights_5_8": g.colours(*(weight[k] for k in range(5, 9)))}


def ecosystem_view(dead: Raster, density: Raster, water: Raster) -> Raster:
    """Dead zones, density and water as red, green and blue."""
    from .base import join_layers

    g = Raster(join_layers({"dead": dead, "density": density, "water": water}), dead.spec, dead.world)
    return g.colours(F.col("dead"), F.col("density"), F.col("water"), F.lit(1.0))


def water_overlay(height: Raster, surfaces: list[Raster], above: float = 0.01, nothing: float = -1e6) -> Raster:
    """The highest water surface that stands above the ground, else ``nothing``."""
    from .base import join_layers

    g = Raster(join_layers({"h": height} | {f"s{k}": s for k, s in enumerate(surfaces)}), height.spec, height.world)
    seen = [F.when(F.col(f"s{k}") > F.col("h") + above, F.col(f"s{k}")).otherwise(nothing) for k in range(len(surfaces))]
    return g.cells(F.greatest(*seen, F.lit(nothing)), HEIGHT)


def snow_overlay(layers: list[Raster]) -> Raster:
    from .base import join_layers

    g = Raster(join_layers({f"s{k}": s for k, s in enumerate(layers)}), layers[0].spec, layers[0].world)
    return g.cells(F.greatest(*(F.col(f"s{k}") for k in range(len(layers))), F.lit(0.0)), MASK)
