import heapq
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import queries
from gridloom.functions import hydro, noise
from gridloom.operators import OPERATORS, apply, focal, points, water
from gridloom.operators.base import MASK, Raster, blank
from gridloom.plans.world import GridSpec, PlanError, World
from gridloom.sources import images, sinks
from gridloom.sources.tables import events, line12

ORACLE = ["flagship", "levels_auto", "terrace", "curve", "driven_strength", "combine_multiply", "colourise", "blend_overlay", "layers", "splat", "slope", "normal_map", "blur_taps", "blur_box", "occlusion", "distance_inside", "snow", "bilinear", "transform", "resample", "upsample_detail", "shape_hexagon", "perlin", "sea_edges", "fill_depressions", "d8_receiver", "drained", "flow_dinf", "lakes_height", "rivers_height", "hydraulic_height", "wetness", "terrain_mountain_alpine", "terrain_dunes", "fbm", "noise_ridged", "noise_simplex", "voronoi_cells", "warp", "trees_points", "debris_density", "thermal_steps", "points_raster", "thin", "tiles", "tile_files", "build_summary"]


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", ORACLE)
def test_same_as_sql(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (sorted(map(tuple, df[columns].values.tolist())) for df in (got, want))
    assert a == b


def array(r: Raster, name="v"):
    out = np.full((r.spec.height, r.spec.width), np.nan)
    for j, i, v in r.df.select("j", "i", name).collect():
        out[j, i] = v
    return out


def grid(spark, f, n=17, size=1024.0, low=0.0, high=1000.0):
    world, spec = World((size, size), (low, high)), GridSpec(n, n, (size, size))
    g = blank(spark, spec, world)
    return g.cells(f(g.x, g.y))


def test_registry_is_complete():
    assert len(OPERATORS) == 59


@pytest.mark.parametrize("type_id", ["adjust.blur", "data.slope", "noise.fbm", "terrain.mountain", "simulate.sea"])
def test_partitioning_does_not_show(spark, type_id):
    g = grid(spark, lambda x, y: F.sin(x / 90) * 100 + y * 0.2)
    keys = [p.key for p in OPERATORS[type_id].inputs if not p.optional]

    def run():
        return array(next(iter(apply(type_id, {k: g for k in keys}, spark=spark, spec=g.spec, world=g.world, seed=5).values())))

    one = run()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert np.array_equal(one, run())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_masks_stay_in_range(spark, data):
    for name in ("height_mask", "aspect", "curvature", "occlusion", "wetness", "flow_dinf", "lakes_lakes", "trees_density"):
        got = queries.QUERIES[name](spark, data).agg(F.min("v"), F.max("v")).first()
        assert got[0] >= 0 and got[1] <= queries.SCALE, name


def test_blur_keeps_the_mean_and_planes(spark):
    spike = grid(spark, lambda x, y: F.when((x == 512) & (y == 512), 1000.0).otherwise(0.0))
    soft = array(focal.gaussian(spike, 100.0))
    assert math.isclose(soft.sum(), 1000.0, rel_tol=1e-9) and soft.max() < 1000
    flat = array(focal.gaussian(grid(spark, lambda x, y: x * 0 + 5.0), 500.0))
    assert np.allclose(flat, 5.0)


def test_gradient_of_a_plane(spark):
    got = focal.gradient(grid(spark, lambda x, y: 0.5 * x - 0.25 * y)).df.select("gx", "gy").distinct().collect()
    assert all(math.isclose(r.gx, 0.5) and math.isclose(r.gy, -0.25) for r in got)


def test_distance_three_four_five(spark):
    g = grid(spark, lambda x, y: F.when((x == 512) & (y == 512), 1.0).otherwise(0.0))
    d = array(focal.distance_to(g, F.col("v") > 0.5))
    assert d[8 + 3, 8 + 4] == 5 * 64.0
    assert array(focal.distance_to(g, F.col("v") > 2)).min() > 1e9


def test_noise_is_bounded_and_seeded():
    x, y = np.random.default_rng(1).uniform(-50, 50, (2, 4000))
    with np.errstate(over="ignore"):
        for f in (noise.perlin, noise.simplex, noise.value, noise.fbm, noise.billow):
            assert np.abs(f(x, y, 3)).max() <= 1.0 + 1e-9
            assert not np.allclose(f(x, y, 3), f(x, y, 4))
        r = noise.ridged(x, y, 3)
        assert 0 <= r.min() and r.max() <= 1
        near, second, _ = noise.worley(x, y, 3, 1.0)
        assert (near <= second).all()




def test_hashes_match_published_ones():
    assert noise.fnv1a(b"") == 0xCBF29CE484222325 and noise.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert noise.mix_int(0) == 0xE220A8397B1DCDAF  # the first number of SplitMix64 from seed 0


def test_column_hash_equals_the_kernel(spark):
    from gridloom.functions import cells as fc

    rows = [(int(a), int(b)) for a, b in np.random.default_rng(2).integers(-1000, 1000, (50, 2))]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", fc.lattice_hash(7, F.col("a"), F.col("b")).alias("h")).collect()
    with np.errstate(over="ignore"):
        for r in got:
            assert r.h & ((1 << 64) - 1) == int(noise.lattice(np.array([r.a]), np.array([r.b]), 7)[0])


def test_chains_by_tile_equal_the_whole_grid(spark):
    from gridloom.operators import tiles

    world = World((3000.0, 2800.0))
    spec = GridSpec(601, 561, world.size_m)
    made = apply("noise.fbm", {}, {"octaves": 3}, spark=spark, spec=spec, world=world, seed=3)["out"]
    chain = apply("data.slope", {"in": apply("adjust.blur", {"in": apply("adjust.warp", {"in": made}, {"strength_m": 60}, seed=5)["out"]}, {"radius_m": 90})["out"]}, {"min_deg": 5})["out"]
    got = array(chain)
    plan = made.source.then((20, 20), lambda w, a: a, ["v"])
    assert plan.base is None and len(plan.steps) == 2
    window = tiles.Window(spec, 0, 0, 601, 561)
    with np.errstate(over="ignore"):
        h = made.source.steps[0][2](window, {})["v"]
        x, y = window.positions
        w = focal.bilinear(window, h, x + 60 * noise.metres(x, y, 1500, noise.derive(5, 1), 4), y + 60 * noise.metres(x, y, 1500, noise.derive(5, 2), 4))
    soft = focal.blurred(w, 45.0, spec.cell)
    gy, gx = np.gradient(soft, spec.cell[1], spec.cell[0])
    deg = np.degrees(np.arctan(np.hypot(gx, gy)))
    t = np.clip(deg / 5.0, 0, 1)
    assert np.allclose(got, t * t * (3 - 2 * t), atol=1e-9)
    dealt = Raster(made.df, spec, world)
    assert np.allclose(array(apply("adjust.blur", {"in": dealt}, {"radius_m": 90})["out"]), focal.blurred(h, 45.0, spec.cell))
    part = dealt.crop(200, 100, 300, 200)
    inside = np.full((561, 601), np.nan)
    inside[100:300, 200:500] = focal.blurred(h[100:300, 200:500], 45.0, spec.cell)
    assert np.allclose(array(focal.gaussian(part, 45.0)), inside, equal_nan=True)


def test_fill_is_the_minimax_path():
    h = np.random.default_rng(3).uniform(0, 100, (12, 15))
    level = np.full(h.shape, np.inf)
    heap = [(h[j, i], j, i) for j in range(12) for i in range(15) if j in (0, 11) or i in (0, 14)]
    for v, j, i in heap:
        level[j, i] = v
    heapq.heapify(heap)
    while heap:
        v, j, i = heapq.heappop(heap)
        if v > level[j, i]:
            continue
        for dj, di in hydro.D8:
            a, b = j + dj, i + di
            if 0 <= a < 12 and 0 <= b < 15 and max(v, h[a, b]) < level[a, b]:
                level[a, b] = max(v, h[a, b])
                heapq.heappush(heap, (level[a, b], a, b))
    assert np.array_equal(hydro.fill(h), level)


def test_filled_ground_equals_a_plain_priority_flood():
    rng = np.random.default_rng(8)
    for shape, cell in (((14, 17), (10.0, 10.0)), ((9, 30), (5.0, 20.0)), ((25, 25), (8.0, 8.0))):
        j, i = np.mgrid[0 : shape[0], 0 : shape[1]]
        for h in (rng.uniform(0, 100, shape), np.round(rng.uniform(0, 3, shape)), 3.0 * i + rng.uniform(0, 4, shape), np.zeros(shape)):
            lift, n = 1e-5 * hydro.jitter(h.size), h.size
            level, done = h.ravel().copy(), {k for k in range(n) if k // shape[1] in (0, shape[0] - 1) or k % shape[1] in (0, shape[1] - 1)}
            heap = [(level[k], k) for k in done]
            heapq.heapify(heap)
            while heap:
                v, k = heapq.heappop(heap)
                for dj, di in hydro.D8:
                    a, b = k // shape[1] + dj, k % shape[1] + di
                    m = a * shape[1] + b
                    if 0 <= a < shape[0] and 0 <= b < shape[1] and m not in done:
                        done.add(m)
                        level[m] = max(level[m], v + math.hypot(dj * cell[1], di * cell[0]) * lift[m])
                        heapq.heappush(heap, (level[m], m))
            assert np.array_equal(hydro.fill(h, cell).ravel(), level)


def test_every_cell_drains_and_area_is_kept():
    h = np.random.default_rng(4).uniform(0, 100, (20, 20))
    with np.errstate(over="ignore", invalid="ignore"):
        to, levels, _ = hydro.route(h, (10.0, 10.0))
    ends = hydro.outlets(to)
    j, i = np.divmod(ends, 20)
    assert ((j == 0) | (j == 19) | (i == 0) | (i == 19)).all()
    area = hydro.gather_down(to, levels, np.full(400, 100.0))
    assert math.isclose(area[to == np.arange(400)].sum(), 400 * 100.0)


def test_thermal_keeps_mass_and_rests():
    h = np.zeros((21, 21))
    h[9:12, 9:12] = 40.0
    with np.errstate(invalid="ignore"):
        out = hydro.thermal(h, (1.0, 1.0), 60, 35, 1.0)
    assert math.isclose(out.sum(), h.sum(), rel_tol=1e-9) and out.max() < 40
    assert np.allclose(out, out.T) and np.array_equal(hydro.thermal(h, (1.0, 1.0), 0, 35, 1.0), h)


def test_lakes_reach_their_shore_on_the_fine_grid(spark):
    g = grid(spark, lambda x, y: F.least(F.sqrt((x - 500.0) * (x - 500.0) + (y - 530.0) * (y - 530.0)), F.lit(300.0)), n=65)
    out = {k: array(v) for k, v in apply("simulate.lakes", {"in": g}, {"detail_m": 64, "infill": 0.3, "shore_width_m": 50}).items()}
    h, level = array(g), out["water_surface"].max()
    assert level > 250 and ((out["lakes"] > 0) == (h < level)).all()
    floor = out["height"].min()
    assert floor > 50 and np.array_equal(out["height"], np.where(h < level, np.maximum(h, floor), h))
    assert (out["shore"][h < level - 10].max() > 0.5) and (out["shore"][h >= level].max() > 0.5) and out["shore"][h < 200].max() == 0


def test_lakes_grow_to_the_higher_one():
    label, level = np.array([[0, -1, 2, -1, -1]]), np.array([[5.0, 1.0, 7.0, 1.0, 1.0]])
    top, depth = hydro.spread(label, level, np.array([[2.0, 1.0, 3.0, 1.0, 1.0]]))
    assert top.tolist() == [[5.0, 7.0, 7.0, 7.0, hydro.DRY]] and depth.tolist() == [[3.0, 4.0, 4.0, 4.0, 0.0]]


def test_streams_begin_at_their_area_whatever_the_sum_rounds_to(spark):
    h = np.random.default_rng(5).integers(0, 1000, (8, 8)).astype(float)
    cell = (100.0, 100.0)
    to, _, filled = hydro.route(h, cell)
    one, two, share, _ = hydro.spread_two(filled, cell, to)
    area = hydro.gather_two(one, two, share, np.full(64, 1e4))
    assert 9e4 - 1e-6 < area[16] < 9e4  # nine cells, of which some reach it in two parts
    g = Raster(spark.createDataFrame([(j, i, float(h[j, i])) for j in range(8) for i in range(8)], "j int, i int, v double"), GridSpec(8, 8, (700.0, 700.0)), World((700.0, 700.0), (0.0, 1000.0)))
    far = apply("data.wetness", {"in": g}, {"stream_area_km2": 0.09, "reach_m": 350}, spark=spark, spec=g.spec, world=g.world)["water_distance"]
    assert array(far)[2, 0] == 0.0
    assert hydro.reaches(np.array([8.9999e4, 9e4]), 9e4).tolist() == [False, True]


def test_narrow_rivers_show_from_their_heads(spark):
    g = grid(spark, lambda x, y: F.abs(x - 512.0) + 100.0 + y * 0.1)
    p = {"source_area_km2": 0.02, "width_m": 40, "depth_m": 4, "bank_width_m": 0, "meander_m": 0, "detail_m": 8}
    out = {k: array(v) for k, v in apply("simulate.rivers", {"in": g}, p).items()}
    river = out["river"][1:15, 8]
    assert (river > 0.5).all() and (river < 1).all() and (np.diff(river) <= 1e-9).all()
    assert (out["height"] <= array(g)).all() and (out["water_surface"] >= out["height"]).all() and out["riverbank"].max() == 0
    pieces = water.reaches(g, p).toPandas()
    starts, ends = (set(zip(pieces[f"x{k}"].round(6), pieces[f"y{k}"].round(6))) for k in (0, 1))
    assert {s for s in starts - ends if (s[0] % 64, s[1] % 64) == (0, 0)}
    assert (pieces.half0 != pieces.half1).any() and (pieces.level1 <= pieces.level0 + 1e-9).all()
    bent = water.reaches(g, p | {"meander_m": 300}).toPandas()
    assert bent[["x0", "x1"]].min().min() >= 0 and bent[["y0", "y1"]].min().min() >= 0 and bent[["x0", "x1", "y0", "y1"]].max().max() <= 1024


def test_shorelines_lie_on_both_sides(spark):
    g = grid(spark, lambda x, y: x)
    out = {k: array(v) for k, v in apply("simulate.sea", {"in": g}, {"sea_level_m": 500, "shore_width_m": 200, "beach_height_m": 100, "coastal_erosion": 1}).items()}
    assert out["shoreline"][5, 6] > 0.2 and out["shoreline"][5, 9] > 0.2 and out["shoreline"][5, 1] == out["shoreline"][5, 14] == 0
    assert np.array_equal(out["water_surface"][:, 8:], out["height"][:, 8:]) and out["height"][5, 8] < array(g)[5, 8]


def test_the_sea_finds_its_way_across_tiles(spark):
    world = World((599.0, 299.0))
    spec = GridSpec(600, 300, world.size_m)
    made = apply("noise.perlin", {}, {"feature_size_m": 9}, spark=spark, spec=spec, world=world, seed=8)["out"]
    h = array(made)
    low = h < 520
    wet = np.zeros(low.shape, bool)
    wet[0], wet[-1], wet[:, 0], wet[:, -1] = low[0], low[-1], low[:, 0], low[:, -1]
    todo = list(zip(*np.nonzero(wet), strict=True))
    while todo:
        j, i = todo.pop()
        for b, a in ((j - 1, i), (j + 1, i), (j, i - 1), (j, i + 1)):
            if 0 <= b < 300 and 0 <= a < 600 and low[b, a] and not wet[b, a]:
                wet[b, a] = True
                todo.append((b, a))
    assert 0 < wet.sum() < low.sum()
    assert np.array_equal(array(water.reached(made, F.col("v") < 520)) > 0, wet)
    assert array(water.reached(made, F.col("v") < -1e9)).max() == 0
    label = hydro.parts(low)
    assert (label[low] >= 0).all() and (label[~low] < 0).all()


def test_thermal_says_when_it_takes_too_many_steps(spark):
    with pytest.raises(PlanError):
        hydro.thermal(np.zeros((3, 3)), (1.0, 1.0), 2100, 35, 10)
    with pytest.raises(PlanError):
        apply("simulate.thermal", {"in": grid(spark, lambda x, y: x, n=65, size=64.0)}, {"duration_s": 2100, "detail_m": 1})


def test_points_keep_their_distance(spark):
    g = grid(spark, lambda x, y: x * 0 + 1.0).to(MASK)
    ground = grid(spark, lambda x, y: x * 0.5)
    p = {"spacing_m": 12.0, "scale_min": 1.0, "scale_max": 2.0, "species": "tree"}
    full = g.cells(F.lit(0.9), MASK)
    got = points.scatter_points(full, ground, p, 11).toPandas()
    xy = got[["x_m", "y_m"]].to_numpy()
    d = np.hypot(*(xy[:, None, :] - xy[None, :, :]).transpose(2, 0, 1)) + np.eye(len(xy)) * 1e9
    assert len(xy) > 2000 and d.min() >= 12.0
    assert np.allclose(got.z_m, got.x_m * 0.5)
    before, points.TILE_CELLS = points.TILE_CELLS, 32
    try:
        again = points.scatter_points(full, ground, p, 11).toPandas()
    finally:
        points.TILE_CELLS = before
    assert sorted(map(tuple, again[["x_m", "y_m"]].round(9).values)) == sorted(map(tuple, got[["x_m", "y_m"]].round(9).values))


def test_images_round_trip(spark, tmp_path):
    v = np.random.default_rng(5).uniform(0, 1, (9, 7))
    assert np.allclose(images.decode_png(images.encode_png(v))[:, :, 0], np.floor(v * 65535 + 0.5) / 65535)
    rgba = np.random.default_rng(6).uniform(0, 1, (5, 6, 4))
    assert np.allclose(images.decode_png(images.encode_png(rgba, 8)), np.floor(rgba * 255 + 0.5) / 255)
    back = images.decode_exr(images.encode_exr({"Y": (v * 3000).astype(np.float32)}))
    assert np.array_equal(back["Y"], (v * 3000).astype(np.float32))
    (tmp_path / "a.png").write_bytes(images.encode_png(v))
    assert images.read_images(spark, str(tmp_path / "a.png")).count() == 63
    g = grid(spark, lambda x, y: x / 1024, n=9).to(MASK)
    files = images.image_files(sinks.tile_cells(Raster(g.df.select("j", "i", (F.col("i") / 8.0).alias("v")), g.spec, g.world, MASK), 5), ["tx", "ty"], ["v"], 5, 5).collect()
    assert len(files) == 4 and all(images.decode_png(bytes(f.content)).shape == (5, 5, 1) for f in files)


def test_whole_images_are_written_by_bands(spark, tmp_path):
    from gridloom.sources import streamed

    world = World((900.0, 1500.0))
    spec = GridSpec(91, 151, world.size_m)
    g = apply("noise.fbm", {}, {"octaves": 2}, spark=spark, spec=spec, world=world, seed=2)["out"]
    h = array(g)
    streamed.write_png(g, f"file://{tmp_path}/h.png")
    assert np.array_equal(np.round(images.decode_png((tmp_path / "h.png").read_bytes())[:, :, 0] * 65535), np.floor(np.clip(h / 2000, 0, 1) * 65535 + 0.5))
    streamed.write_exr(g, f"file://{tmp_path}/h.exr")
    assert np.array_equal(images.decode_exr((tmp_path / "h.exr").read_bytes())["Y"], h.astype(np.float32))
    paint = apply("colour.colourise", {"in": g})["out"]
    streamed.write_png(paint, f"file://{tmp_path}/c.png", 8)
    streamed.write_exr(paint, f"file://{tmp_path}/c.exr")
    assert np.array_equal(images.decode_exr((tmp_path / "c.exr").read_bytes())["G"], array(paint, "g").astype(np.float32))
    assert images.decode_png((tmp_path / "c.png").read_bytes()).shape == (151, 91, 4)
    part = g.crop(10, 70, 30, 75)
    streamed.write_exr(part, f"file://{tmp_path}/p.exr")
    assert np.array_equal(images.decode_exr((tmp_path / "p.exr").read_bytes())["Y"], h[70:145, 10:40].astype(np.float32))


def test_image_files_are_stretched_over_the_world(spark, tmp_path):
    v = np.random.default_rng(9).uniform(0, 1, (5, 9))
    (tmp_path / "h.png").write_bytes(images.encode_png(v))
    (tmp_path / "h.exr").write_bytes(images.encode_exr({"Y": (v * 3000).astype(np.float32)}))
    px = np.random.default_rng(10).uniform(0, 1, (4, 6, 4))
    (tmp_path / "c.png").write_bytes(images.encode_png(px, 16))
    world = World((800.0, 400.0))
    spec = GridSpec(17, 9, world.size_m)
    make = {"spark": spark, "spec": spec, "world": world}
    fine = np.empty((9, 17))
    for j in range(9):
        for i in range(17):
            a, b = min(i // 2, 7), min(j // 2, 3)
            t, u = i / 2 - a, j / 2 - b
            fine[j, i] = (v[b, a] * (1 - t) + v[b, a + 1] * t) * (1 - u) + (v[b + 1, a] * (1 - t) + v[b + 1, a + 1] * t) * u
    got = array(apply("primitive.file", {}, {"path": str(tmp_path / "h.png")}, **make)["out"])
    assert np.allclose(got, fine * 2000, atol=0.05)
    assert np.allclose(array(apply("primitive.file", {}, {"path": str(tmp_path / "h.png"), "flip_y": True, "world_range": False, "low_m": 10, "high_m": 20}, **make)["out"]), 10 + 10 * fine[::-1], atol=0.01)
    assert np.allclose(array(apply("primitive.file", {}, {"path": str(tmp_path / "h.exr")}, **make)["out"]), fine * 3000, atol=0.05)
    colour = apply("colour.image", {}, {"path": str(tmp_path / "c.png")}, **make)["out"]
    assert abs(array(colour, "g")[0, 0] - px[0, 0, 1]) < 1e-4 and abs(array(colour, "b")[8, 16] - px[3, 5, 2]) < 1e-4
    with pytest.raises(PlanError):
        apply("primitive.file", {}, {}, **make)


def test_points_and_tiles_are_written(spark, data, tmp_path):
    from gridloom.sources.tables import customers

    sinks.write_csv(customers(spark, data), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["x", "y", "z", "rotation_deg", "scale", "species"]
    sinks.write_json(customers(spark, data), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == customers(spark, data).count()
    sinks.write_tiles(line12(spark, data), 8, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).select("tx", "ty").distinct().count() == 14
    with pytest.raises(PlanError):
        sinks.check_format("points", "png16")


def test_missing_cells_are_filled(spark, data):
    assert events(spark, data).df.count() == 744


def test_streams_fold_like_batches(spark, data):
    from gridloom.streaming import folded

    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{data}/events.parquet*")
    j, i, v = F.dayofmonth("ts") - 1, F.hour("ts"), F.col("value")
    q = folded(stream, j, i, v).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted(map(tuple, df.select("j", "i", "v", "n").collect()))
    assert rows(spark.table("cells")) == rows(folded(spark.read.schema(schema).parquet(f"{data}/events.parquet"), j, i, v))


def test_world_passes_are_bounded(spark):
    world = World((1e6, 1e6))
    g = blank(spark, GridSpec(20000, 20000, world.size_m), world).cells(F.lit(0.0))
    with pytest.raises(PlanError):
        water.fill_depressions(g)
