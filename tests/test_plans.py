import json

import pytest
from pyspark.sql import functions as F

from gridloom.operators import apply
from gridloom.operators.base import blank
from gridloom.plans.graph import Evaluator, Graph, History, Project, preset, preset_text
from gridloom.plans.params import curve, gradient, tangents
from gridloom.plans.store import ResultStore
from gridloom.plans.world import Cancelled, GridSpec, InvalidLink, InvalidParam, NodeNotFound, PlanError, ProjectError, World, halo, runs, tiles, tiles_even


def test_grids():
    spec = GridSpec(5, 3, (400.0, 100.0))
    assert spec.cell == (100.0, 50.0) and spec.x(4) == 400.0 and spec.y(0) == 0.0
    part = spec.crop(1, 0, 3, 3)
    assert part.bounds == (1, 0, 4, 3) and part.x(2) == spec.x(2)
    assert spec.crop(0, 0, 5, 3).window is None
    with pytest.raises(PlanError):
        spec.crop(3, 0, 3, 3)
    with pytest.raises(PlanError):
        World((0.0, 1.0))
    with pytest.raises(PlanError):
        World((1.0, 1.0), (5.0, float("nan")))


def test_tiles_cover_each_sample_once():
    assert runs(9, 4) == [(0, 4), (4, 9)] and runs(10, 4) == [(0, 4), (4, 8), (8, 10)]
    spec = GridSpec(9, 10, (1.0, 1.0))
    assert sum((c - a) * (d - b) for a, b, c, d in tiles(spec, 4)) == 90
    assert halo((4, 4, 9, 8), 3, spec) == (1, 1, 9, 10) and tiles_even(9, 5) and not tiles_even(10, 5)


def test_curves_and_gradients():
    assert curve([(1, 1), (0, 0), (0, 0.5)])[0] == (0.0, 0.0)
    with pytest.raises(PlanError):
        curve([(0, 0)])
    assert all(m >= 0 for m in tangents(curve([(0, 0), (0.2, 0.8), (1, 1)])))
    assert [s[0] for s in gradient([(0.5, 1, 1, 1), (0, 0, 0, 0)])] == [0.0, 0.5]


def test_graph_rules():
    g = Graph()
    a, b, c = g.add("noise.fbm"), g.add("adjust.levels"), g.add("data.slope")
    assert (a, b) == ("n_0001", "n_0002")
    g.connect((a, "out"), (b, "in"))
    g.connect((b, "out"), (c, "in"))
    assert g.order([c]) == [a, b, c] and g.upstream(c) == {a, b}
    with pytest.raises(PlanError):
        g.connect((b, "out"), (b, "in"))
    with pytest.raises(PlanError):
        g.connect((c, "out"), (b, "nothing"))
    d = g.add("vegetation.trees")
    g.connect((a, "out"), (d, "in"))
    with pytest.raises(PlanError):
        g.connect((d, "points"), (b, "in"))
    g.set(b, "gamma", 1e9)
    assert g.nodes[b].params["gamma"] == 100
    with pytest.raises(PlanError):
        g.set(a, "basis", "cubic")
    g.expose(a, "height_m")
    assert g.waves([c]) == [[b]] and g.reaches([c])[a] is None
    assert g.base_terrain(c) == (b, "out")
    g.remove(b)
    assert g.order([c]) == [c]


def test_undo():
    g = Graph()
    h = History(g)
    h.record()
    n = g.add("primitive.cone")
    assert h.undo() and n not in g.nodes and h.redo() and n in g.nodes and not h.redo()


def test_editing_downstream_keeps_upstream(spark):
    g = Graph()
    a, b = g.add("noise.fbm"), g.add("adjust.clamp")
    g.connect((a, "out"), (b, "in"))
    e, spec = Evaluator(spark, g, World()), GridSpec(9, 9, (8192.0, 8192.0))
    first = e.outputs(b, spec)["out"].df.collect()
    assert (e.hits, e.misses) == (0, 2)
    g.set(b, "high_m", 400)
    e.outputs(b, spec)
    assert (e.hits, e.misses) == (1, 3)
    assert len(first) == 81


def test_drive_and_convert(spark):
    world, spec = World((800.0, 800.0)), GridSpec(9, 9, (800.0, 800.0))
    mask = blank(spark, spec, world).cells(F.lit(0.5), "mask")
    out = apply("primitive.constant", {}, {"height_m": 10}, spark=spark, spec=spec, world=world)["out"]
    assert out.df.agg(F.max("v")).first()[0] == 10
    driven = apply("primitive.cone", {}, {"height_m": 100, "radius_m": 1e9}, spark=spark, spec=spec, world=world, driven={"height_m": mask})["out"]
    assert abs(driven.df.agg(F.max("v")).first()[0] - 50) < 1e-3
    with pytest.raises(PlanError):
        apply("primitive.constant", {}, {}, spark=spark, spec=spec, world=world, driven={"height_m": mask})
    assert mask.to("height").df.first().v == 1000.0


def test_projects(tmp_path):
    p = Project.from_json('{"world": {"seed": 3}, "nodes": [{"id": "n_0001", "type": "noise.fbm", "params": {"octaves": 3, "old": 1}}, {"id": "x", "type": "no.such"}, {"id": "n_0002", "type": "adjust.blur"}], "links": [{"from": ["n_0001", "out"], "to": ["n_0002", "in"]}, {"from": ["x", "out"], "to": ["n_0002", "in"]}], "exports": [{"node": "n_0002", "port": "out", "format": "png16"}]}')
    assert len(p.warnings) == 3 and p.world.seed == 3 and p.exports == [("n_0002", "out", "png16")]
    p.save(str(tmp_path / "p.json"))
    assert Project.from_json((tmp_path / "p.json").read_text()).graph.links == p.graph.links


def test_presets():
    text = preset_text("vegetation.trees", {"species": "pine", "spacing_m": 6.5, "seed": 4})
    assert preset(text) == {"node": "vegetation.trees", "species": "pine", "spacing_m": 6.5}
    for bad in ("a: 1", "node: x\nnode: y", "node: x\n  deep: 1"):
        with pytest.raises(PlanError):
            preset(bad)


def test_the_rest_works_without_the_optional_folder():
    import pathlib
    import subprocess
    import sys

    code = "import sys; sys.modules['gridloom.llm'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=pathlib.Path(__file__).resolve().parent.parent)


def test_portals_and_tabs():
    g = Graph()
    a, t = g.add("noise.fbm"), g.add("vegetation.trees", pos=(500.0, 40.0))
    b = g.add("vegetation.grass", pos=(900.0, 0.0))
    g.connect((a, "out"), (t, "in"))
    g.connect((a, "out"), (b, "in"))
    g.connect((t, "occupied"), (b, "occupied"))
    assert g.move_vegetation() == 2 and g.move_vegetation() == 0
    portals = [n for n in g.nodes.values() if n.type_id == "portal.height"]
    assert len(portals) == 1 and portals[0].tab == "vegetation" and portals[0].pos == (160.0, 0.0)
    assert g.links[(t, "in")] == g.links[(b, "in")] == (portals[0].id, "out") and g.links[(b, "occupied")] == (t, "occupied")
    with pytest.raises(InvalidLink):
        g.add_portal((t, "points"), "output")
    with pytest.raises(InvalidParam):
        g.set_tab(a, "nowhere")
    with pytest.raises(NodeNotFound):
        g.remove("n_none")


def test_undo_merges_quick_edits_of_one_thing():
    g = Graph()
    h = History(g)
    h.record(now=0.0)
    n = g.add("noise.fbm")
    for k in range(5):
        h.record(f"{n}.octaves", now=1.0 + k * 0.5)
        g.set(n, "octaves", k + 1)
    h.record(f"{n}.octaves", now=9.0)
    g.set(n, "octaves", 9)
    with h.group():
        for k in range(3):
            h.record()
            g.add("noise.perlin")
    assert len(h.past) == 4 and h.undo() and len(g.nodes) == 1 and g.nodes[n].params["octaves"] == 9
    assert h.undo() and g.nodes[n].params["octaves"] == 5 and h.undo() and "octaves" not in g.nodes[n].params
    assert h.redo() and h.redo() and g.nodes[n].params["octaves"] == 9


def test_projects_of_other_versions(monkeypatch):
    from dataclasses import replace

    from gridloom.operators import OPERATORS

    monkeypatch.setitem(OPERATORS, "noise.fbm", replace(OPERATORS["noise.fbm"], version=3, migrate=lambda v, p: p | {"octaves": 2 * v}))
    text = json.dumps({"nodes": [{"id": "a", "type": "noise.fbm", "type_version": 1, "params": {"gain": 0.25}}, {"id": "b", "type": "noise.perlin", "type_version": 9}]})
    project = Project.from_json(text)
    assert project.graph.nodes["a"].params == {"gain": 0.25, "octaves": 2} and len(project.warnings) == 2
    with pytest.raises(ProjectError):
        Project.from_json("{")


def test_known_erosion_parameters_load_without_a_warning():
    params = {
        "simulate.thermal": ["talus_angle_deg", "diffusivity_m2_s"], "simulate.hydraulic": ["rainfall_m_yr", "rock_softness", "sediment_capacity", "deposition_rate", "creep_m2_yr"], "simulate.rivers": ["bank_width_m"], "simulate.lakes": ["shore_width_m"],
        "simulate.sea": ["beach_height_m", "coastal_erosion", "shallow_depth_m", "shore_width_m"], "data.rock_hardness": ["soft_hardness", "hard_hardness"], "vegetation.trees": ["rotation_min_deg", "rotation_max_deg"],
    }
    project = Project.from_json(json.dumps({"nodes": [{"id": t, "type": t, "type_version": 1, "params": dict.fromkeys(keys, 0.5)} for t, keys in params.items()]}))
    assert not project.warnings and len(project.graph.nodes) == len(params)


def test_results_are_stored_by_content_and_leave_by_age(spark, tmp_path):
    g = Graph()
    a, b = g.add("noise.fbm", {"octaves": 2}), g.add("adjust.blur")
    g.connect((a, "out"), (b, "in"))
    world = World((1000.0, 1000.0))
    spec = GridSpec(40, 40, world.size_m)
    store, told = ResultStore(spark, f"file://{tmp_path}/store"), []
    first = Evaluator(spark, g, world, store, told.append)
    want = sorted(map(tuple, first.outputs(b, spec)["out"].df.collect()))
    assert (first.hits, first.misses) == (0, 2) and told == [0.5, 1.0] and len(store.sizes()) == 2
    again = Evaluator(spark, g, world, ResultStore(spark, f"file://{tmp_path}/store"))
    assert sorted(map(tuple, again.outputs(b, spec)["out"].df.collect())) == want and (again.hits, again.misses) == (2, 0)
    g.set(b, "radius_m", 50)
    again.outputs(b, spec)
    assert (again.hits, again.misses) == (3, 1) and len(store.sizes()) == 3
    small = ResultStore(spark, f"file://{tmp_path}/store", max(store.sizes().values()) + 10)
    small.get(next(iter(store.sizes())), spec, world)
    assert len(small.evict()) == small.evictions == 2 and len(small.sizes()) == 1


def test_an_older_evaluation_is_cancelled(spark):
    g = Graph()
    a = g.add("noise.fbm")
    world = World((1000.0, 1000.0))
    e = Evaluator(spark, g, world)
    e.progress = lambda _: e.cancel()
    b = g.add("adjust.clamp")
    g.connect((a, "out"), (b, "in"))
    with pytest.raises(Cancelled):
        e.outputs(b, GridSpec(20, 20, world.size_m))
    e.progress = None
    assert e.outputs(b, GridSpec(20, 20, world.size_m))["out"].df.count() == 400
