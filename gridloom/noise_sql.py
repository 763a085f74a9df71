"""Lattice noise in SQL for DuckDB, written apart from ``functions.noise`` so that one can check the other.

A field is one or more named queries of a WITH clause; the last bears the
field's name and holds (j, i, n). Seeds are derived here, in whole numbers.
"""

from __future__ import annotations

_ALL = 1 << 64
_MOD = f"{_ALL}::UHUGEINT"
_CORNERS = {"perlin": "(0, 0), (1, 0), (0, 1), (1, 1)", "value": "(0, 0), (1, 0), (0, 1), (1, 1)", "simplex": "(0, 0), (1, 0), (2, 0)"}


def split_mix(z: int) -> int:
    z = (z + 0x9E3779B97F4A7C15) % _ALL
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % _ALL
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % _ALL
    return z ^ (z >> 31)


def sub_seed(seed: int, *parts: int) -> int:
    for k in parts:
        seed = split_mix(seed ^ split_mix((k + 0x5851F42D4C957F2D) % _ALL))
    return seed


def mixed(prev: str, name: str, src: str) -> str:
    """Queries that add ``{name}_h``, the SplitMix64 of the UBIGINT column ``src``."""
    step = lambda k, e, frm: f"{k} AS (SELECT *, CAST(({e}) % {_MOD} AS UBIGINT) AS {k}_z FROM {frm})"
    a, b, c = f"{name}a", f"{name}b", f"{name}c"
    return ", ".join([
        step(a, f"{src}::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT", prev),
        step(b, f"xor({a}_z, {a}_z >> 30)::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT", a),
        step(c, f"xor({b}_z, {b}_z >> 27)::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT", b),
        f"{name} AS (SELECT *, xor({c}_z, {c}_z >> 31) AS {name}_h FROM {c})",
    ])


def lattice(prev: str, name: str) -> str:
    """Queries that add ``{name}_h``, the hash of (gx, gy) under ``seed``."""
    times = lambda e, k: f"CAST((CASE WHEN {e} < 0 THEN {_MOD} - ((-({e}))::UHUGEINT * {k}::UHUGEINT) % {_MOD} ELSE ({e})::UHUGEINT * {k}::UHUGEINT END) % {_MOD} AS UBIGINT)"
    return ", ".join([
        f"{name}s AS (SELECT *, xor(seed, {times('gx', 0x9E3779B97F4A7C15)}) AS {name}_x FROM {prev})",
        mixed(f"{name}s", f"{name}m", f"{name}_x"),
        f"{name}t AS (SELECT *, xor({name}m_h, {times('gy', 0xC2B2AE3D27D4EB4F)}) AS {name}_y FROM {name}m)",
        mixed(f"{name}t", name, f"{name}_y"),
    ])


_FADE = "({0} * {0} * {0} * ({0} * ({0} * 6.0 - 15.0) + 10.0))"


def octaves(name: str, src: str, u: str, v: str, seed: int, count: int, basis: str = "perlin", lacunarity: float = 2.0, turned: bool = True) -> str:
    """(j, i, k, n): ``count`` octaves of noise at (u, v), each turned by the 3-4-5 angle, stretched and shifted from the one before."""
    rows, (a, b, c), (d, e, f) = [], (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)
    for k in range(count):
        rows.append(f"({k}, {sub_seed(seed, k) if turned else seed}::UBIGINT, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE, {e!r}::DOUBLE, {f!r}::DOUBLE)")
        (a, b, c), (d, e, f) = [[lacunarity * (0.8 * p - 0.6 * q) for p, q in zip((a, b, c), (d, e, f), strict=True)], [lacunarity * (0.6 * p + 0.8 * q) for p, q in zip((a, b, c), (d, e, f), strict=True)]]
        c, f = c + 17.31, f + 43.17
    n = name
    out = [f"{n}o AS (SELECT j, i, k, seed, xa * ({u}) + xb * ({v}) + xc AS px, ya * ({u}) + yb * ({v}) + yc AS py FROM {src}, (VALUES {', '.join(rows)}) o(k, seed, xa, xb, xc, ya, yb, yc))"]
    turn = f"CAST({n}l_h >> 60 AS DOUBLE) * 22.5"
    if basis == "simplex":
        out += [
            f"{n}k AS (SELECT *, floor(px + (px + py) * (sqrt(3.0) - 1.0) / 2.0) AS si, floor(py + (px + py) * (sqrt(3.0) - 1.0) / 2.0) AS sj FROM {n}o)",
            f"{n}d AS (SELECT *, px - si + (si + sj) * (3.0 - sqrt(3.0)) / 6.0 AS dx, py - sj + (si + sj) * (3.0 - sqrt(3.0)) / 6.0 AS dy FROM {n}k)",
            f"{n}e AS (SELECT *, CASE cx WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN CASE WHEN dx > dy THEN 1 ELSE 0 END END AS ax, CASE cx WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN CASE WHEN dx > dy THEN 0 ELSE 1 END END AS ay FROM {n}d, (VALUES {_CORNERS[basis]}) c(cx, cy))",
            f"{n}f AS (SELECT *, CAST(si AS BIGINT) + ax AS gx, CAST(sj AS BIGINT) + ay AS gy, dx - ax + cx * (3.0 - sqrt(3.0)) / 6.0 AS ex, dy - ay + cx * (3.0 - sqrt(3.0)) / 6.0 AS ey FROM {n}e)",
            lattice(f"{n}f", f"{n}l"),
            f"{n} AS (SELECT j, i, k, least(greatest(99.20433458271871 * sum(pow(greatest(0.5 - ex * ex - ey * ey, 0.0), 4) * (cos(radians({turn})) * ex + sin(radians({turn})) * ey)), -1.0), 1.0) AS n FROM {n}l GROUP BY j, i, k)",
        ]
        return ", ".join(out)
    out += [
        f"{n}c AS (SELECT *, CAST(floor(px) AS BIGINT) + cx AS gx, CAST(floor(py) AS BIGINT) + cy AS gy, px - floor(px) AS fx, py - floor(py) AS fy FROM {n}o, (VALUES {_CORNERS[basis]}) c(cx, cy))",
        lattice(f"{n}c", f"{n}l"),
    ]
    at = f"(cos(radians({turn})) * (fx - cx) + sin(radians({turn})) * (fy - cy)) * sqrt(2.0)" if basis == "perlin" else f"CAST({n}l_h >> 11 AS DOUBLE) / 9007199254740992.0 * 2.0 - 1.0"
    out.append(f"{n} AS (SELECT j, i, k, sum(({at}) * (CASE cx WHEN 1 THEN {_FADE.format('fx')} ELSE 1.0 - {_FADE.format('fx')} END) * (CASE cy WHEN 1 THEN {_FADE.format('fy')} ELSE 1.0 - {_FADE.format('fy')} END)) AS n FROM {n}l GROUP BY j, i, k)")
    return ", ".join(out)


def one(name: str, src: str, u: str, v: str, seed: int, basis: str) -> str:
    """(j, i, n): noise of one octave, under the seed itself."""
    return octaves(f"{name}q", src, u, v, seed, 1, basis, turned=False) + f", {name} AS (SELECT j, i, n FROM {name}q)"


def fbm(name: str, src: str, u: str, v: str, seed: int, count: int, of: str = "n") -> str:
    """(j, i, n): the mean of ``of`` over octaves that weigh half the one before each."""
    return octaves(f"{name}q", src, u, v, seed, count) + f", {name} AS (SELECT j, i, sum(({of}) * pow(0.5, k)) / sum(pow(0.5, k)) AS n FROM {name}q GROUP BY j, i)"


def ridged(name: str, src: str, u: str, v: str, seed: int, count: int) -> str:
    """(j, i, n): squared creases, each octave weighted by the crease of the one before."""
    wide = ", ".join(f"max(n) FILTER (k = {k}) AS n{k}" for k in range(count))
    signals, carry = [], "1.0"
    for k in range(count):
        signals.append(f"pow(1.0 - abs(n{k}), 2) * {carry} AS s{k}")
        carry = f"least(greatest(s{k} * 2.0, 0.0), 1.0)"
    total = " + ".join(f"s{k} * {0.5**k!r}" for k in range(count))
    return octaves(f"{name}q", src, u, v, seed, count) + f", {name}w AS (SELECT j, i, {wide} FROM {name}q GROUP BY j, i), {name}v AS (SELECT j, i, {', '.join(signals)} FROM {name}w), {name} AS (SELECT j, i, ({total}) / {sum(0.5**k for k in range(count))!r} AS n FROM {name}v)"


def cells(name: str, src: str, u: str, v: str, seed: int) -> str:
    """(j, i, near, second, own): distances to the nearest two of one jittered point a cell, and the value of the nearest one's cell."""
    spread = ", ".join(f"({a}, {b})" for b in range(-2, 3) for a in range(-2, 3))
    n = name
    return ", ".join([
        f"{n}o AS (SELECT j, i, {seed}::UBIGINT AS seed, {u} AS px, {v} AS py, CAST(floor({u}) AS BIGINT) + cx AS gx, CAST(floor({v}) AS BIGINT) + cy AS gy FROM {src}, (VALUES {spread}) o(cx, cy))",
        lattice(f"{n}o", f"{n}l"),
        mixed(f"{n}l", f"{n}r", f"{n}l_h"),
        f"{n}d AS (SELECT j, i, {n}l_h AS h, sqrt(pow(gx + CAST({n}l_h >> 11 AS DOUBLE) / 9007199254740992.0 - px, 2) + pow(gy + CAST({n}r_h >> 11 AS DOUBLE) / 9007199254740992.0 - py, 2)) AS d FROM {n}r)",
        f"{n}n AS (SELECT j, i, list_sort(list(d)) AS ds, arg_min(xor(h, {0x5BD1E995}::UBIGINT), d) AS owner FROM {n}d GROUP BY j, i)",
        mixed(f"{n}n", f"{n}e", "owner"),
        f"{n} AS (SELECT j, i, ds[1] AS near, ds[2] AS second, CAST({n}e_h >> 11 AS DOUBLE) / 9007199254740992.0 AS own FROM {n}e)",
    ])
