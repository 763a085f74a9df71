"""Kernels that need a whole grid at once, on 2-D NumPy arrays: filling, routing, flooding, erosion, scattering."""

from __future__ import annotations

import heapq
import math

import numpy as np

from ..plans.world import PlanError
from .noise import GOLDEN, U, derive, mix, unit

#: Neighbours as (dj, di): edges W E N S, then diagonals NW NE SW SE. Ties go to the first.
D8 = ((0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1))

# Fixed values.
FLOW_LOW, FLOW_HIGH = 5e3, 5e7  # m^2 of drained area from black to white
SEDIMENT_LOW, SEDIMENT_HIGH = 1.0, 1e5  # m^3 a year
WEAR_HALF, DEPOSITION_HALF = 30.0, 10.0  # metres at half brightness
FLAT_SLOPE = 1e-5  # by which a filled cell stands above the one it drains to
CUT_RATE = 1e-5  # a year, at full softness
STEP_KYR = 25.0
BASIN_SALT = 0xBA515EED

DRY = -1e9
MOST_STEPS = 100_000
ROUNDING = 1e-9  # of a sum, far above what its floats lose


def jitter(n: int) -> np.ndarray:
    """0.25 to 1.75 per cell, so that flats drain in no direction of their own."""
    return 0.25 + 1.5 * unit(mix(np.arange(n, dtype=U) ^ U(GOLDEN)))


#: The same neighbours by rising index.
_RASTER = tuple(sorted(D8))


def fill(h: np.ndarray, cell: tuple[float, float] | None = None) -> np.ndarray:
    """Heights filled up to where they spill over the borders, as by a priority flood in (height, index) order.

    With ``cell`` each filled cell stands above the one that it drains to, by
    a small slope times the length of their link and the cell's jitter.

    A cell whose lowest neighbour is low enough, and so on down to a border,
    keeps its height: these are found by pointer jumping. Only the others go
    through a heap, which begins at their neighbours among the first.
    """
    rows, cols = h.shape
    n, flat = h.size, h.astype(np.float64).ravel()
    own = np.arange(n).reshape(h.shape)
    lift = FLAT_SLOPE * jitter(n) if cell else np.zeros(n)
    low, to, far = np.full(h.shape, np.inf), own.copy(), np.zeros(h.shape)
    for dj, di in _RASTER:
        near = shifted(h.astype(np.float64), dj, di, np.inf)
        better = near < low
        low, to = np.where(better, near, low), np.where(better, own + dj * cols + di, to)
        far = np.where(better, math.hypot(dj * cell[1], di * cell[0]) if cell else 0.0, far)
    border = np.ones(h.shape, bool)
    border[1:-1, 1:-1] = False
    border, low = border.ravel(), low.ravel()
    falls = (flat > low) & (flat >= low + far.ravel() * lift)
    sure = border[outlets(np.where(border | ~falls, own.ravel(), to.ravel()))]
    if sure.all():
        return h.astype(np.float64)
    wide = cols + 2
    ring = lambda a, edge: np.pad(a.reshape(h.shape), 1, constant_values=edge).ravel()
    todo = ring(~sure, False)
    links = [(dj * wide + di, math.hypot(dj * cell[1], di * cell[0]) if cell else 0.0) for dj, di in D8]
    beside = np.zeros(len(todo), bool)
    at = np.flatnonzero(todo)
    for off, _ in links:
        beside[at + off] = True
    seeds = np.flatnonzero(beside & ring(sure, False)).tolist()
    level, up, todo = ring(flat, np.nan).tolist(), ring(lift, 0.0).tolist(), todo.tolist()
    heap = [(level[k], k) for k in seeds]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        top, k = pop(heap)
        for off, d in links:
            m = k + off
            if todo[m]:
                todo[m] = False
                floor = top + d * up[m]
                if level[m] < floor:
                    level[m] = floor
                push(heap, (level[m], m))
    return np.array(level).reshape(rows + 2, wide)[1:-1, 1:-1].copy()


def shifted(a: np.ndarray, dj: int, di: int, outside=np.nan) -> np.ndarray:
    """The neighbour's value at each cell."""
    out = np.full(a.shape, outside, a.dtype)
    rows, cols = a.shape
    out[max(0, -dj) : rows - max(0, dj), max(0, -di) : cols - max(0, di)] = a[max(0, dj) : rows + min(0, dj), max(0, di) : cols + min(0, di)]
    return out


def steepest(h: np.ndarray, cell: tuple[float, float]) -> np.ndarray:
    """Index of the neighbour down the steepest drop, the cell's own if none is lower."""
    rows, cols = h.shape
    best = np.zeros(h.shape)
    to = np.arange(h.size).reshape(h.shape)
    own = to.copy()
    for dj, di in D8:
        drop = (h - shifted(h, dj, di, np.inf)) / math.hypot(dj * cell[1], di * cell[0])
        better = drop > best
        best, to = np.where(better, drop, best), np.where(better, own + dj * cols + di, to)
    return to


def route(h: np.ndarray, cell: tuple[float, float]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(receiver, cells by how many links they are from their outlet, filled): every cell drains to a border cell."""
    filled = fill(h, cell)
    to = steepest(filled, cell)
    own = np.arange(h.size).reshape(h.shape)
    for edge in (np.s_[0], np.s_[-1], np.s_[:, 0], np.s_[:, -1]):
        to[edge] = own[edge]
    to = to.ravel()
    return to, by_depth(to), filled


def by_depth(to: np.ndarray) -> list[np.ndarray]:
    """The cells of a forest by their number of links to the root, roots first: what a level needs is settled by the levels beside it."""
    depth, far = (to != np.arange(len(to))).astype(np.int64), to
    while True:
        on = far[far]
        if (on == far).all():
            break
        depth, far = depth + depth[far], on
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


def gather_down(to: np.ndarray, levels: list[np.ndarray], own: np.ndarray, keep: float | np.ndarray = 1.0) -> np.ndarray:
    """Each cell's own amount and what its donors pass on, ridges first."""
    total = own.astype(np.float64).copy()
    kept = np.broadcast_to(np.asarray(keep, float), total.shape)
    for cells in levels[:0:-1]:
        np.add.at(total, to[cells], total[cells] * kept[cells])
    return total


def outlets(to: np.ndarray) -> np.ndarray:
    """The last cell downstream of each, by pointer jumping."""
    while True:
        on = to[to]
        if (on == to).all():
            return to
        to = on


#: Facets in the numbering of the paper on D-infinity (Tarboton 1997): edge and corner neighbour as (dj, di).
FACETS = (((0, 1), (-1, 1)), ((-1, 0), (-1, 1)), ((-1, 0), (-1, -1)), ((0, -1), (-1, -1)), ((0, -1), (1, -1)), ((1, 0), (1, -1)), ((1, 0), (1, 1)), ((0, 1), (1, 1)))


def link_angle(to: np.ndarray, shape: tuple[int, int], cell: tuple[float, float]) -> np.ndarray:
    """Degrees of each cell's link (0 is +x, 90 is +y); outlets drain off the nearest edge, W, E, N or S."""
    j, i = np.divmod(np.arange(len(to)), shape[1])
    off = np.array([180.0, 0.0, 270.0, 90.0])[np.argmin([i, shape[1] - 1 - i, j, shape[0] - 1 - j], axis=0)]
    own = np.degrees(np.arctan2((to // shape[1] - j) * cell[1], (to % shape[1] - i) * cell[0])) % 360.0
    return np.where(to == np.arange(len(to)), off, own)


def spread_two(h: np.ndarray, cell: tuple[float, float], fallback: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Direction of flow by the steepest of eight triangular facets: (first receiver, second, share of the first, angle).

    Cells without a falling facet drain to ``fallback``; those that are their own fallback are outlets.
    """
    cols = h.shape[1]
    own = np.arange(h.size).reshape(h.shape)
    inside = fallback.reshape(h.shape) != own
    best = np.zeros(h.shape)
    one, two, share, angle = fallback.reshape(h.shape).copy(), own.copy(), np.ones(h.shape), link_angle(fallback, h.shape, cell).reshape(h.shape)
    for edge, corner in FACETS:
        d1, d2 = cell if edge[0] == 0 else cell[::-1]
        e1, e2 = shifted(h, *edge, np.nan), shifted(h, *corner, np.nan)
        top = math.atan2(d2, d1)
        with np.errstate(invalid="ignore"):
            s1, s2 = (h - e1) / d1, (e1 - e2) / d2
            r = np.arctan2(s2, s1)
            slope = np.where(r < 0, s1, np.where(r > top, (h - e2) / math.hypot(d1, d2), np.hypot(s1, s2)))
            better = inside & (slope > best)
        r = np.clip(r, 0.0, top)
        a0 = math.atan2(*edge)
        turn = (math.atan2(*corner) - a0 + math.pi) % (2 * math.pi) - math.pi
        best = np.where(better, slope, best)
        one = np.where(better, own + edge[0] * cols + edge[1], one)
        two = np.where(better, own + corner[0] * cols + corner[1], two)
        share = np.where(better, 1.0 - r / top, share)
        angle = np.where(better, np.degrees(a0 + math.copysign(1.0, turn) * r) % 360.0, angle)
    return one.ravel(), two.ravel(), share.ravel(), angle.ravel()


def gather_two(one: np.ndarray, two: np.ndarray, share: np.ndarray, own: np.ndarray) -> np.ndarray:
    """As ``gather_down`` with two receivers: in waves, each of the cells whose donors have all been heard."""
    total, n = own.astype(np.float64).copy(), np.arange(len(own))
    first, second = one != n, (two != n) & (share < 1.0)
    waits = np.bincount(one[first], minlength=len(n)) + np.bincount(two[second], minlength=len(n))
    ready = np.flatnonzero(waits == 0)
    while len(ready):
        a, b = ready[first[ready]], ready[second[ready]]
        np.add.at(total, one[a], total[a] * share[a])
        np.add.at(total, two[b], total[b] * (1.0 - share[b]))
        heard = np.concatenate([one[a], two[b]])
        np.subtract.at(waits, heard, 1)
        heard = np.unique(heard)
        ready = heard[waits[heard] == 0]
    return total


def reaches(area: np.ndarray, least: float) -> np.ndarray:
    """Where ``area`` is ``least`` or more. Shares that add up to a whole number of cells may fall short of it by their rounding, which doesn't count."""
    return area >= least * (1.0 - ROUNDING)


def parts(low: np.ndarray) -> np.ndarray:
    """A number from 0 for each 4-connected part of the marked cells, -1 elsewhere: runs of rows, tied where they touch."""
    rows, cols = low.shape
    begins = low.copy()
    begins[:, 1:] &= ~low[:, :-1]
    run = np.where(low, np.cumsum(begins.ravel()).reshape(low.shape) - 1, -1)
    touch = low[1:] & low[:-1]
    pairs = np.unique(np.stack([run[:-1][touch], run[1:][touch]], 1), axis=0)
    parent = list(range(int(begins.sum())))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    named = np.array([root(x) for x in range(len(parent))] + [-1], np.int64)
    return named[run]


def lakes(h: np.ndarray, cell: tuple[float, float], min_depth: float, min_area: float) -> tuple[np.ndarray, np.ndarray]:
    """(label of each cell's lake or -1, water level): 8-connected flooded cells at one level, large enough ones."""
    level = fill(h)
    flooded = level > h
    label = np.where(flooded, np.arange(h.size).reshape(h.shape), -1)
    while True:
        low = label.copy()
        for dj, di in D8:
            near, at = shifted(label, dj, di, -1), shifted(level, dj, di, np.nan)
            low = np.where(flooded & (near >= 0) & (at == level), np.minimum(low, near), low)
        if (low == label).all():
            break
        label = low
    ids, inverse, count = np.unique(label, return_inverse=True, return_counts=True)
    deep = np.zeros(len(ids))
    np.maximum.at(deep, inverse.ravel(), (level - h).ravel())
    good = (ids >= 0) & (deep >= min_depth) & (count * cell[0] * cell[1] >= min_area)
    return np.where(good[inverse].reshape(h.shape), label, -1), level


def spread(label: np.ndarray, level: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, depth) of each cell's lake, grown by one cell (towards the higher lake where two meet); DRY and 0 elsewhere. A lake's depth is its deepest cell's."""
    ids, inverse = np.unique(label, return_inverse=True)
    deep = np.zeros(len(ids))
    np.maximum.at(deep, inverse.ravel(), (level - h).ravel())
    own = np.where(label >= 0, level, DRY), np.where(label >= 0, deep[inverse.reshape(h.shape)], 0.0)
    top, depth = own
    for dj, di in D8:
        near = shifted(own[0], dj, di, DRY)
        higher = (label < 0) & (near > top)
        top, depth = np.where(higher, near, top), np.where(higher, shifted(own[1], dj, di, 0.0), depth)
    return top, depth


def thermal_steps(cell: tuple[float, float], duration_s: float, diffusivity: float) -> int:
    """Steps short enough to be stable; an error beyond 100,000 of them."""
    if duration_s <= 0:
        return 0
    size = min(cell)
    steps = max(1, math.ceil(duration_s / min(0.2 * size * size / max(diffusivity, 1e-12), 1.0)))
    if steps > MOST_STEPS:
        raise PlanError(f"erosion needs more than {MOST_STEPS:,} steps; reduce the duration or take a larger extent or detail")
    return steps


def thermal(h: np.ndarray, cell: tuple[float, float], duration_s: float, talus_deg: float, diffusivity: float, strength=1.0, hardness=0.0) -> np.ndarray:
    """Material above the angle of rest moves to lower neighbours; what leaves a cell arrives in another."""
    steps = thermal_steps(cell, duration_s, diffusivity)
    dt = duration_s / steps if steps else 0.0
    strength, soft = np.broadcast_to(strength, h.shape).astype(float), 1.0 - np.broadcast_to(hardness, h.shape)
    rest = math.tan(math.radians(talus_deg))
    h = h.astype(np.float64).copy()
    for _ in range(steps):
        change = np.zeros(h.shape)
        for dj, di in D8:
            d = math.hypot(dj * cell[1], di * cell[0])
            w = 2.0 / 3.0 if 0 in (dj, di) else 1.0 / 3.0
            low, near = shifted(h, dj, di, np.inf), shifted(strength, dj, di, 0.0)
            out = np.maximum(h - low - rest * d, 0.0) * (diffusivity * dt * w / (d * d)) * np.minimum(strength, near) * soft
            change += shifted(out, -dj, -di, 0.0) - out
        h += change
    return h


def blur(a: np.ndarray, sigma: tuple[float, float]) -> np.ndarray:
    """Gaussian with repeated borders; sigma in cells along columns and rows (x, y)."""
    for axis, s in ((1, sigma[0]), (0, sigma[1])):
        if s < 0.2:
            continue
        r = math.ceil(3 * s)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        w /= w.sum()
        pad = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = np.apply_along_axis(lambda v, w=w: np.convolve(v, w, "valid"), axis, pad)
    return a


def _carve(now: np.ndarray, to: np.ndarray, levels: list[np.ndarray], factor: np.ndarray) -> np.ndarray:
    """Stream power by one implicit step: outlets first, each cell against its receiver's new height."""
    out = now.copy()
    for cells in levels[1:]:
        low = out[to[cells]]
        cut = (now[cells] + factor[cells] * low) / (1.0 + factor[cells])
        out[cells] = np.where((factor[cells] > 0) & (now[cells] > low), cut, now[cells])
    return out


def _settle(now: np.ndarray, to: np.ndarray, levels: list[np.ndarray], loose: np.ndarray, able: np.ndarray, span: np.ndarray, share: np.ndarray, filled: np.ndarray, area: float) -> tuple[np.ndarray, np.ndarray]:
    """Ridges first, sediment goes down; ``share`` of what is beyond ``able`` times the slope settles, in lakes up to their level, elsewhere up to half the drop."""
    out, load = now.copy(), np.zeros(len(now))
    for cells in levels[::-1]:
        r = to[cells]
        carried = load[cells] + loose[cells]
        drop = np.maximum(out[cells] - out[r], 0.0)
        beyond = carried - able[cells] * drop / np.maximum(span[cells], 1e-9)
        room = np.maximum(np.maximum(filled[cells] - out[cells], 0.0), 0.5 * drop) * area
        laid = np.where((r != cells) & (carried > 0) & (beyond > 0), np.minimum(beyond * share[cells], room), 0.0)
        out[cells] += laid / area
        load[cells] = carried - laid
        moves = r != cells
        np.add.at(load, r[moves], load[cells[moves]])
    return out, load


def hydraulic(h: np.ndarray, cell: tuple[float, float], p: dict, strength=1.0, hardness=0.0) -> dict[str, np.ndarray]:
    """Stream power with sediment: per step of at most 25 kyr route, gather, cut (downstream first), carry, creep."""
    area = cell[0] * cell[1]
    years = p["duration_kyr"] * 1000.0
    steps = max(1, math.ceil(p["duration_kyr"] / STEP_KYR)) if years > 0 else 0
    dt = years / steps if steps else 0.0
    strength = np.broadcast_to(strength, h.shape).astype(float).ravel()
    weight = strength * (1.0 - np.broadcast_to(hardness, h.shape).ravel())
    start = h.astype(np.float64).ravel().copy()
    now, q, load = start.copy(), np.zeros(h.size), np.zeros(h.size)
    j, i = np.divmod(np.arange(h.size), h.shape[1])
    kept, unsettled = 1.0 - p["evaporation"] / 1000.0, 1.0 - p["deposition_rate"]
    for _ in range(steps):
        to, levels, filled = route(now.reshape(h.shape), cell)
        span = np.hypot((j - j[to]) * cell[1], (i - i[to]) * cell[0])
        q = gather_down(to, levels, np.full(h.size, p["rainfall_m_yr"] * area), kept**span)
        power = np.sqrt(q)
        before, now = now, _carve(now, to, levels, CUT_RATE * p["rock_softness"] * p["downcutting"] * weight * dt * power / np.maximum(span, 1e-9))
        able = p["sediment_capacity"] * CUT_RATE * dt * power * area
        now, load = _settle(now, to, levels, np.maximum(before - now, 0.0) * area, able, span, (1.0 - unsettled ** (span / 100.0)) * strength, filled.ravel(), area)
        load /= dt
        sigma = math.sqrt(2.0 * p["creep_m2_yr"] * dt)
        if sigma > 0:
            soft = blur(now.reshape(h.shape), (sigma / cell[0], sigma / cell[1])).ravel()
            now = now + (soft - now) * weight
    log = lambda v, lo, hi: np.clip(np.log10(np.maximum(v, lo) / lo) / math.log10(hi / lo), 0.0, 1.0)
    worn, laid = np.maximum(start - now, 0.0), np.maximum(now - start, 0.0)
    rain = p["rainfall_m_yr"]
    out = {"height": now, "flow": log(q / rain, FLOW_LOW, FLOW_HIGH) if rain > 0 else np.zeros(h.size), "wear": worn / (WEAR_HALF + worn), "deposition": laid / (DEPOSITION_HALF + laid), "sediment": log(load, SEDIMENT_LOW, SEDIMENT_HIGH)}
    return {k: v.reshape(h.shape) for k, v in out.items()}


def cell_random(ci: np.ndarray, cj: np.ndarray, seed: int, stream: int) -> np.ndarray:
    inner = U(seed) ^ ci.astype(np.int64).view(U) * U(GOLDEN) ^ U((stream * 0xD6E8FEB86659FD93) & ((1 << 64) - 1))
    return unit(mix(mix(inner) ^ cj.astype(np.int64).view(U) * U(0xC2B2AE3D27D4EB4F)))


TRIES = 3
MAX_CELLS = 40_000_000


def scatter(density, size_m: tuple[float, float], spacing: float, seed: int, origin=(0, 0), shape: tuple[int, int] | None = None) -> tuple[np.ndarray, ...]:
    """(x, y, ci, cj) of points at least ``spacing`` apart, from world-fixed cells in nine phases.

    ``density(x, y)`` gives 0..1 at positions. A cell keeps its point if its
    hash is below the density at its middle; up to three places are tried.
    ``origin`` and ``shape`` (in cells) restrict the work to a tile.
    """
    side = spacing / math.sqrt(2.0)
    full = (math.ceil(size_m[0] / side), math.ceil(size_m[1] / side))
    nx, ny = shape or full
    if nx * ny > MAX_CELLS:
        raise ValueError("too many cells; a larger spacing is needed")
    seed = derive(seed, 7)
    cj, ci = np.mgrid[origin[1] : origin[1] + ny, origin[0] : origin[0] + nx]
    mx, my = (ci + 0.5) * side, (cj + 0.5) * side
    with np.errstate(over="ignore"):
        wanted = (cell_random(ci, cj, seed, 0) < density(mx, my)) & (ci < full[0]) & (cj < full[1])
        tries = [(np.stack([(ci + cell_random(ci, cj, seed, 1 + 2 * t)) * side, (cj + cell_random(ci, cj, seed, 2 + 2 * t)) * side])) for t in range(TRIES)]
    px = np.full((ny + 4, nx + 4), np.inf)
    py = px.copy()
    near = [(b, a) for b in range(-2, 3) for a in range(-2, 3) if abs(a) + abs(b) < 4 and (a or b)]
    for phase in range(9):
        turn = wanted & ((ci % 3) + 3 * (cj % 3) == phase)
        for t in range(TRIES):
            j, i = np.nonzero(turn)
            if not len(j):
                break
            x, y = tries[t][0][j, i], tries[t][1][j, i]
            free = (x <= size_m[0]) & (y <= size_m[1])
            for b, a in near:
                free &= (px[j + 2 + b, i + 2 + a] - x) ** 2 + (py[j + 2 + b, i + 2 + a] - y) ** 2 >= spacing * spacing
            px[j[free] + 2, i[free] + 2], py[j[free] + 2, i[free] + 2] = x[free], y[free]
            turn[j[free], i[free]] = False
    j, i = np.nonzero(np.isfinite(px[2:-2, 2:-2]))
    return px[j + 2, i + 2], py[j + 2, i + 2], ci[j, i], cj[j, i]
