"""Parameters of operators: kinds, checks, curves and gradients."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from .world import InvalidParam


@dataclass(frozen=True)
class Param:
    """``kind``: float, int, bool, enum, curve, gradient, file or text. Numbers are clamped, unknown choices are errors."""

    key: str
    kind: str
    default: Any
    low: float = -1e9
    high: float = 1e9
    choices: tuple[str, ...] = ()
    drivable: bool = False

    def check(self, value: Any) -> Any:
        if self.kind in ("float", "int"):
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                raise InvalidParam(f"{self.key}: {value!r} is no finite number")
            value = min(max(value, self.low), self.high)
            return float(value) if self.kind == "float" else int(round(value))
        if self.kind == "bool":
            if not isinstance(value, bool):
                raise InvalidParam(f"{self.key}: {value!r} is neither true nor false")
            return value
        if self.kind == "enum":
            if value not in self.choices:
                raise InvalidParam(f"{self.key}: {value!r} is none of {', '.join(self.choices)}")
            return value
        if self.kind == "curve":
            return curve(value)
        if self.kind == "gradient":
            return gradient(value)
        if not isinstance(value, str):
            raise InvalidParam(f"{self.key}: {value!r} is no text")
        return value.strip()


def number(key: str, default: float, low: float = -1e9, high: float = 1e9, drivable: bool = False) -> Param:
    return Param(key, "float", float(default), low, high, drivable=drivable)


def whole(key: str, default: int, low: int = -(2**31), high: int = 2**31 - 1) -> Param:
    return Param(key, "int", default, low, high)


def flag(key: str, default: bool) -> Param:
    return Param(key, "bool", default)


def choice(key: str, *choices: str) -> Param:
    return Param(key, "enum", choices[0], choices=choices)


def curve(points: list) -> list[tuple[float, float]]:
    """At least two and at most 64 sorted points in 0..1, one for each x (within 1e-6)."""
    if not 2 <= len(points) <= 64:
        raise InvalidParam("a curve has 2 to 64 points")
    kept: list[tuple[float, float]] = []
    for x, y in sorted((min(max(float(a), 0.0), 1.0), min(max(float(b), 0.0), 1.0)) for a, b in points):
        if not kept or x - kept[-1][0] > 1e-6:
            kept.append((x, y))
    if len(kept) < 2:
        raise InvalidParam("a curve has two different points")
    return kept


def tangents(points: list[tuple[float, float]]) -> list[float]:
    """Slopes at the points of a monotone cubic (Fritsch and Carlson)."""
    n = len(points)
    d = [(points[k + 1][1] - points[k][1]) / (points[k + 1][0] - points[k][0]) for k in range(n - 1)]
    m = [d[0], *((d[k - 1] + d[k]) / 2 if d[k - 1] * d[k] > 0 else 0.0 for k in range(1, n - 1)), d[-1]]
    for k in range(n - 1):
        if d[k] == 0:
            m[k] = m[k + 1] = 0.0
            continue
        a, b = m[k] / d[k], m[k + 1] / d[k]
        if (s := a * a + b * b) > 9:
            t = 3 / math.sqrt(s)
            m[k], m[k + 1] = t * a * d[k], t * b * d[k]
    return m


def gradient(stops: list) -> list[tuple[float, float, float, float]]:
    """1 to 64 stops (t, r, g, b), sorted by t; equal ones keep their order."""
    if not 1 <= len(stops) <= 64:
        raise InvalidParam("a gradient has 1 to 64 stops")
    return sorted((tuple(min(max(float(x), 0.0), 1.0) for x in s) for s in stops), key=lambda s: s[0])


def checked(params: tuple[Param, ...], given: dict[str, Any]) -> dict[str, Any]:
    """Values of all parameters; keys that no parameter has are dropped."""
    return {p.key: p.check(given[p.key]) if p.key in given else (p.check(p.default) if p.kind in ("curve", "gradient") else p.default) for p in params}
