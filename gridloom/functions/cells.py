"""Functions of one cell as Spark columns; all of them stay in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.params import tangents

Value = Column | float


def col(v: Value) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def clamp(v: Value, low: Value = 0.0, high: Value = 1.0) -> Column:
    return F.least(F.greatest(col(v), col(low)), col(high))


def lerp(a: Value, b: Value, t: Value) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def smoothstep(e0: float, e1: float, v: Value) -> Column:
    """Hermite step; a hard step where the edges meet; falling where they are reversed."""
    if e0 == e1:
        return F.when(col(v) < e0, 0.0).otherwise(1.0)
    t = clamp((col(v) - e0) / (e1 - e0))
    return t * t * (3.0 - 2.0 * t)


def soft_range(v: Value, low: float, high: float, falloff: float) -> Column:
    """1 inside, a smooth fall outside; swapped bounds are put right; no falloff is a hard range."""
    low, high = min(low, high), max(low, high)
    if falloff <= 0:
        return F.when((col(v) >= low) & (col(v) <= high), 1.0).otherwise(0.0)
    return smoothstep(low - falloff, low, v) * (1.0 - smoothstep(high, high + falloff, v))


def normalise(v: Value, low: float, span: float) -> Column:
    return (col(v) - low) / span


def denormalise(v: Value, low: float, span: float) -> Column:
    return low + col(v) * span


def signed_pow(v: Value, gamma: float) -> Column:
    return F.signum(col(v)) * F.pow(F.abs(col(v)), F.lit(float(gamma)))


def curve_value(v: Value, points: list[tuple[float, float]]) -> Column:
    """Monotone cubic through the points; held at the ends."""
    m = tangents(points)
    out = F.lit(points[-1][1])
    for k in range(len(points) - 2, -1, -1):
        (x0, y0), (x1, y1) = points[k], points[k + 1]
        h = x1 - x0
        t = (col(v) - x0) / h
        t2, t3 = t * t, t * t * t
        piece = (2.0 * t3 - 3.0 * t2 + 1.0) * y0 + (t3 - 2.0 * t2 + t) * (h * m[k]) + (-2.0 * t3 + 3.0 * t2) * y1 + (t3 - t2) * (h * m[k + 1])
        out = F.when(col(v) < x1, piece).otherwise(out)
    return F.when(col(v) <= points[0][0], F.lit(points[0][1])).otherwise(out)


def gradient_value(v: Value, stops: list[tuple[float, float, float, float]], channel: int) -> Column:
    """Piecewise linear between stops; held at the ends; the last stop at or below the value counts."""
    out = F.lit(stops[0][1 + channel])
    for k, s in enumerate(stops):
        if k + 1 < len(stops) and stops[k + 1][0] > s[0]:
            e = stops[k + 1]
            piece = lerp(s[1 + channel], e[1 + channel], (col(v) - s[0]) / (e[0] - s[0]))
        else:
            piece = F.lit(s[1 + channel])
        out = F.when(col(v) >= s[0], piece).otherwise(out)
    return out


def srgb_to_linear(v: Value) -> Column:
    return F.when(col(v) <= 0.04045, col(v) / 12.92).otherwise(F.pow((col(v) + 0.055) / 1.055, F.lit(2.4)))


def log_mask(v: Value, low: float, high: float) -> Column:
    """0 at ``low`` and below, 1 at ``high`` and above, by decades."""
    t = F.log10(F.greatest(col(v), F.lit(low)) / low) / F.log10(F.lit(high / low))
    return F.when(col(v) <= 0, 0.0).otherwise(F.least(t, F.lit(1.0)))


def snap01(v: Value, near: float = 1e-6) -> Column:
    return F.when(F.abs(col(v)) < near, 0.0).when(F.abs(col(v) - 1.0) < near, 1.0).otherwise(col(v))


def half_saturation(d: Value, half: float) -> Column:
    """d / (half + d), 0 for nothing or less."""
    return F.when(col(d) > 0, col(d) / (half + col(d))).otherwise(0.0)


def quantise(v: Value, steps: int) -> Column:
    """Whole steps of 0..1, as image files hold them."""
    return F.floor(clamp(v) * float(steps) + 0.5).cast("int")


# 64-bit hashing without a multiplication that overflows: products of 16-bit limbs.
_M16 = 0xFFFF


def _s64(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def let(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with ``v`` computed once: expressions that use a value many times would else grow with every step."""
    return F.transform(F.array(v), f)[0]


def _long(k: int) -> Column:
    return F.lit(k).cast("long")


def mul64(v: Column, k: int) -> Column:
    """v * k modulo 2**64 on the bits of a BIGINT, under ANSI arithmetic too."""
    b = [(k >> (16 * n)) & _M16 for n in range(4)]

    def product(x: Column) -> Column:
        a = [F.shiftrightunsigned(x, 16 * n).bitwiseAND(_long(_M16)) for n in range(4)]
        columns = [sum((a[m] * _long(b[n - m]) for m in range(1, n + 1)), a[0] * _long(b[n])) for n in range(4)]
        # below 2**35 each, so two of them make a sum without a carry lost
        low = columns[0] + F.shiftleft(columns[1].bitwiseAND(_long(_M16)), 16)
        high = F.shiftrightunsigned(columns[1], 16) + columns[2] + F.shiftleft(columns[3].bitwiseAND(_long(_M16)), 16)
        return let(low, lambda lo: F.shiftleft((high + F.shiftrightunsigned(lo, 32)).bitwiseAND(_long(0xFFFFFFFF)), 32).bitwiseOR(lo.bitwiseAND(_long(0xFFFFFFFF))))

    return let(v, product)


def add64(v: Column, k: int) -> Column:
    """v + k modulo 2**64 by halves."""

    def total(x: Column) -> Column:
        lo = x.bitwiseAND(_long(0xFFFFFFFF)) + _long(k & 0xFFFFFFFF)
        hi = F.shiftrightunsigned(x, 32) + _long((k >> 32) & 0xFFFFFFFF) + F.shiftrightunsigned(lo, 32)
        return F.shiftleft(hi.bitwiseAND(_long(0xFFFFFFFF)), 32).bitwiseOR(lo.bitwiseAND(_long(0xFFFFFFFF)))

    return let(v, total)


def mix64(v: Column) -> Column:
    """SplitMix64 of a BIGINT's bits."""
    fold = lambda n: lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, n))
    z = let(add64(v, 0x9E3779B97F4A7C15), fold(30))
    z = let(mul64(z, 0xBF58476D1CE4E5B9), fold(27))
    return let(mul64(z, 0x94D049BB133111EB), fold(31))


def unit64(h: Column) -> Column:
    """The top 53 bits as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def lattice_hash(seed: int, ix: Column, iy: Column) -> Column:
    inner = mul64(ix.cast("long"), 0x9E3779B97F4A7C15).bitwiseXOR(F.lit(_s64(seed)).cast("long"))
    return mix64(mix64(inner).bitwiseXOR(mul64(iy.cast("long"), 0xC2B2AE3D27D4EB4F)))
