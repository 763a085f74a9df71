"""Cell-wise operators: one projection each, so Catalyst fuses a run of them into one stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.cells import clamp, curve_value, lerp, signed_pow, smoothstep, soft_range
from ..plans.params import Param, choice, flag, number
from .base import HEIGHT, MASK, OUT_H, OUT_M, Call, H, M, Raster, operator

STRENGTH = (number("strength", 1, 0, 1, drivable=True),)


def by_strength(c: Call, effect: Column) -> Column:
    return lerp(F.col("in"), effect, c.value("strength"))


def mask_out(g: Raster, v: Column, invert: bool = False) -> dict:
    return {"out": g.cells(1.0 - v if invert else v, MASK)}


@operator("adjust.levels", (H(),), OUT_H, (flag("auto_input", True), number("in_low_m", 0), number("in_high_m", 2000), flag("world_output", True), number("out_low_m", 0), number("out_high_m", 2000), number("gamma", 1, 0.01, 100), flag("clamp", True)), reach=None)
def levels(c: Call):
    """The input range (its own where ``auto_input``) to the output range, by a power that keeps the sign."""
    p, g = c.params, c.frame()
    if p["auto_input"]:
        g = Raster(Raster(g.df.withColumnRenamed("in", "v"), c.spec, c.world).with_range().withColumnRenamed("v", "in"), c.spec, c.world)
        low, span = F.col("low"), F.col("high") - F.col("low")
        t = (F.col("in") - low) / F.when(F.abs(span) < 1e-6, 1.0).otherwise(span)
    else:
        span = p["in_high_m"] - p["in_low_m"]
        t = (F.col("in") - p["in_low_m"]) / (1.0 if abs(span) < 1e-6 else span)
    t = clamp(t) if p["clamp"] else t
    t = t if p["gamma"] == 1 else signed_pow(t, p["gamma"])
    low, high = c.world.height_range_m if p["world_output"] else (p["out_low_m"], p["out_high_m"])
    return {"out": g.cells(low + t * (high - low), HEIGHT)}


@operator("adjust.curve", (H(),), OUT_H, (Param("curve", "curve", [(0, 0), (1, 1)]), *STRENGTH))
def response(c: Call):
    low, span = c.world.height_range_m[0], c.world.span
    shaped = low + curve_value(clamp((F.col("in") - low) / span), c.params["curve"]) * span
    return {"out": c.frame().cells(by_strength(c, shaped))}


@operator("adjust.clamp", (H(),), OUT_H, (number("low_m", 0), number("high_m", 1500)))
def limit(c: Call):
    low, high = sorted((c.params["low_m"], c.params["high_m"]))
    return {"out": c.frame().cells(clamp(F.col("in"), low, high))}


@operator("adjust.invert", (H(),), OUT_H, (choice("around", "world", "input", "pivot"), number("pivot_m", 0)), reach=None)
def invert(c: Call):
    g, around = c.frame(), c.params["around"]
    if around == "input":
        ranged = Raster(g.df.withColumnRenamed("in", "v"), c.spec, c.world).with_range()
        return {"out": Raster(ranged, c.spec, c.world).cells(F.col("low") + F.col("high") - F.col("v"))}
    total = 2 * c.params["pivot_m"] if around == "pivot" else sum(c.world.height_range_m)
    return {"out": g.cells(total - F.col("in"))}


@operator("adjust.terrace", (H(),), OUT_H, (number("step_m", 120, 1e-3), number("sharpness", 0.7, 0, 1), number("offset_m", 0), *STRENGTH))
def terrace(c: Call):
    p = c.params
    s = (F.col("in") - p["offset_m"]) / p["step_m"]
    k = F.floor(s).cast("double")
    stepped = (k + F.pow(s - k, F.lit(1.0 + 11.0 * p["sharpness"]))) * p["step_m"] + p["offset_m"]
    return {"out": c.frame().cells(by_strength(c, stepped))}


@operator("data.height_mask", (H(),), OUT_M, (number("low_m", 1000), number("high_m", 2000), number("falloff_m", 100, 0), flag("invert", False)))
def height_mask(c: Call):
    p = c.params
    return mask_out(c.frame(), soft_range(F.col("in"), p["low_m"], p["high_m"], p["falloff_m"]), p["invert"])


@operator("data.select_range", (M(),), OUT_M, (number("low", 0.4, 0, 1), number("high", 0.6, 0, 1), number("falloff", 0.05, 0, 1), flag("invert", False)))
def select_range(c: Call):
    p = c.params
    return mask_out(c.frame(), soft_range(F.col("in"), p["low"], p["high"], p["falloff"]), p["invert"])


@operator("data.rock_hardness", (H(),), OUT_M, (number("layer_thickness_m", 50, 1e-3), number("offset_m", 0), number("soft_hardness", 0.1, 0, 1), number("hard_hardness", 0.9, 0, 1)))
def rock_hardness(c: Call):
    """Bands of soft and hard rock by height."""
    p = c.params
    wave = F.sin(F.lit(3.141592653589793) * (F.col("in") - p["offset_m"]) / p["layer_thickness_m"])
    return mask_out(c.frame(), lerp(p["soft_hardness"], p["hard_hardness"], smoothstep(0.0, 1.0, 2.0 * wave + 0.5)))


@operator("combine.combine", (H("a"), H("b"), M("mask", True)), OUT_H, (choice("mode", "blend", "add", "subtract", "multiply", "max", "min"), number("ratio", 1, 0, 1)))
def combine(c: Call):
    """a + (op(a, b) - a) * ratio * mask; products are of normalised heights."""
    a, b, low, span = F.col("a"), F.col("b"), c.world.height_range_m[0], c.world.span
    made = {"add": a + b, "subtract": a - b, "multiply": low + (a - low) / span * ((b - low) / span) * span, "max": F.greatest(a, b), "min": F.least(a, b), "blend": b}[c.params["mode"]]
    k = F.lit(c.params["ratio"]) * (clamp(F.col("mask")) if c.has("mask") else 1.0)
    return {"out": c.frame().cells(a + (made - a) * k, HEIGHT)}


@operator("portal.height", (H(),), OUT_H)
def portal_height(c: Call):
    return {"out": c.inputs["in"]}


@operator("portal.mask", (M(),), OUT_M)
def portal_mask(c: Call):
    return {"out": c.inputs["in"]}
