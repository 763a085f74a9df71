"""Graphs of operators: editing, checks, projects in JSON, and compiling an output to DataFrames."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
from collections.abc import Callable
from contextlib import contextmanager
from copy import deepcopy
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from ..functions.noise import node_seed
from .store import ResultStore
from .world import Cancelled, Cycle, GridSpec, InvalidLink, InvalidParam, NodeFailed, NodeNotFound, PlanError, PortNotFound, PresetError, ProjectError, UnknownOperator, World

FITS = {("height", "mask"), ("mask", "height")}
UNDO_STEPS = 500
MERGE_S = 1.0  # edits of one thing within this time are one step of undo
TABS = ("terrain", "vegetation", "colour", "output")
PORTALS = {"height": "portal.height", "mask": "portal.mask"}
PORTAL_LEFT, PORTAL_DOWN = 340.0, 120.0


@dataclass
class Node:
    id: str
    type_id: str
    version: int = 1
    pos: tuple[float, float] = (0.0, 0.0)
    params: dict[str, Any] = field(default_factory=dict)
    exposed: set[str] = field(default_factory=set)
    tab: str = "terrain"


class Graph:
    """Nodes by id and at most one link into each input; never a cycle."""

    def __init__(self):
        from ..operators import OPERATORS

        self.operators = OPERATORS
        self.nodes: dict[str, Node] = {}
        self.links: dict[tuple[str, str], tuple[str, str]] = {}  # (node, input) -> (node, output)
        self._next = 1

    def add(self, type_id: str, params: dict | None = None, node_id: str | None = None, **more) -> str:
        if type_id not in self.operators:
            raise UnknownOperator(f"no operator {type_id}")
        if node_id is None:
            while (node_id := f"n_{self._next:04x}") in self.nodes:
                self._next += 1
            self._next += 1
        self.nodes[node_id] = Node(node_id, type_id, self.operators[type_id].version, **more)
        for k, v in (params or {}).items():
            self.set(node_id, k, v)
        return node_id

    def set_tab(self, node_id: str, tab: str) -> None:
        """Shows the node in another tab; results stay."""
        if node_id not in self.nodes:
            raise NodeNotFound(f"no node {node_id}")
        if tab not in TABS:
            raise InvalidParam(f"{tab!r} is none of {', '.join(TABS)}")
        self.nodes[node_id].tab = tab

    def add_portal(self, source: tuple[str, str], tab: str, pos: tuple[float, float] = (0.0, 0.0)) -> str:
        """Brings a height or mask output into another tab through a node that passes it on."""
        kind = self._kind(*source, out=True)
        if kind not in PORTALS:
            raise InvalidLink(f"{kind} has no portal")
        portal = self.add(PORTALS[kind], pos=pos)
        self.set_tab(portal, tab)
        self.connect(source, (portal, "in"))
        return portal

    def move_vegetation(self) -> int:
        """Puts vegetation that stands among the terrain in its own tab; heights and masks that cross tabs then go through portals, one for each output and tab. How many nodes moved."""
        moved = [n for n in self.nodes.values() if n.tab == "terrain" and n.type_id.startswith("vegetation.")]
        for n in moved:
            n.tab = "vegetation"
        portals: dict[tuple, str] = {}
        for target, source in list(self.links.items()) if moved else []:
            a, b = self.nodes[source[0]], self.nodes[target[0]]
            if a.tab == b.tab or b.type_id in PORTALS.values() or self._kind(*source, out=True) not in PORTALS:
                continue
            key = (source, b.tab)
            if key not in portals:
                there = [n.pos for n in self.nodes.values() if n.tab == b.tab and n.id not in portals.values()]
                done = sum(k[1] == b.tab for k in portals)
                portals[key] = self.add_portal(source, b.tab, (min(x for x, _ in there) - PORTAL_LEFT, min(y for _, y in there) + PORTAL_DOWN * done))
            self.connect((portals[key], "out"), target)
        return len(moved)

    def remove(self, node_id: str) -> None:
        if node_id not in self.nodes:
            raise NodeNotFound(f"no node {node_id}")
        self.nodes.pop(node_id)
        self.links = {t: f for t, f in self.links.items() if node_id not in (t[0], f[0])}

    def set(self, node_id: str, key: str, value: Any) -> None:
        found = next((p for p in self.operators[self.nodes[node_id].type_id].params if p.key == key), None)
        if found is None:
            raise InvalidParam(f"{self.nodes[node_id].type_id} has no parameter {key}")
        self.nodes[node_id].params[key] = found.check(value)

    def expose(self, node_id: str, key: str, on: bool = True) -> None:
        """Gives a drivable parameter an input ``p:<key>``, or takes it away with its link."""
        op = self.operators[self.nodes[node_id].type_id]
        if not any(p.key == key and p.drivable for p in op.params):
            raise InvalidParam(f"{op.type_id}.{key} can't be driven")
        if on:
            self.nodes[node_id].exposed.add(key)
        else:
            self.nodes[node_id].exposed.discard(key)
            self.links.pop((node_id, f"p:{key}"), None)

    def _kind(self, node_id: str, port: str, out: bool) -> str:
        if node_id not in self.nodes:
            raise NodeNotFound(f"no node {node_id}")
        node = self.nodes[node_id]
        op = self.operators[node.type_id]
        if not out and port.startswith("p:") and port[2:] in node.exposed:
            return "mask"
        found = next((p for p in (op.outputs if out else op.inputs) if p.key == port), None)
        if found is None:
            raise PortNotFound(f"{node.type_id} has no {'output' if out else 'input'} {port}")
        return found.kind

    def connect(self, source: tuple[str, str], target: tuple[str, str]) -> None:
        """Replaces what was linked to the input; kinds must fit and no cycle may close."""
        a, b = self._kind(*source, out=True), self._kind(*target, out=False)
        if a != b and (a, b) not in FITS:
            raise InvalidLink(f"{a} can't feed {b}")
        if source[0] == target[0] or target[0] in self.upstream(source[0]):
            raise Cycle("a link would close a cycle")
        self.links[target] = source

    def disconnect(self, target: tuple[str, str]) -> None:
        self.links.pop(target, None)

    def inputs(self, node_id: str) -> dict[str, tuple[str, str]]:
        return {t[1]: f for t, f in sorted(self.links.items()) if t[0] == node_id}

    def upstream(self, node_id: str) -> set[str]:
        """All nodes that this one depends on."""
        seen, todo = set(), [node_id]
        while todo:
            for f in self.inputs(todo.pop()).values():
                if f[0] not in seen:
                    seen.add(f[0])
                    todo.append(f[0])
        return seen

    def order(self, targets: list[str]) -> list[str]:
        """The targets and all they need, each after its inputs."""
        out: list[str] = []

        def visit(n: str) -> None:
            if n not in out:
                for f in self.inputs(n).values():
                    visit(f[0])
                out.append(n)

        for t in targets:
            visit(t)
        return out

    def base_terrain(self, node_id: str) -> tuple[str, str] | None:
        """A height output of the node, else of the nearest node upstream."""
        level = [node_id]
        while level:
            for n in level:
                for p in self.operators[self.nodes[n].type_id].outputs:
                    if p.kind == "height":
                        return n, p.key
            level = [f[0] for n in level for f in self.inputs(n).values()]
        return None

    def sources_of(self, node_id: str, output: str) -> list[tuple[str, str]]:
        """Nodes upstream (or this one) that have an output of that name."""
        return [(n, output) for n in sorted(self.upstream(node_id) | {node_id}) if any(p.key == output for p in self.operators[self.nodes[n].type_id].outputs)]

    def reaches(self, targets: list[str]) -> dict[str, float | None]:
        """Metres of surroundings that each node must supply to its consumers; None: the whole world."""
        need: dict[str, float | None] = dict.fromkeys(self.order(targets), 0.0)
        for n in reversed(self.order(targets)):
            node = self.nodes[n]
            op = self.operators[node.type_id]
            own = op.reach(self.values(n)) if op.reach else None
            for f in self.inputs(n).values():
                add = None if own is None or need[n] is None else need[n] + own
                have = need[f[0]]
                need[f[0]] = None if add is None or have is None else max(have, add)
        return need

    def waves(self, targets: list[str]) -> list[list[str]]:
        """Nodes that see the whole world, by how many of them stand upstream; each wave needs the ones before."""
        depth: dict[str, int] = {}
        for n in self.order(targets):
            far = [depth[f[0]] + (self.operators[self.nodes[f[0]].type_id].reach is None) for f in self.inputs(n).values()]
            depth[n] = max(far, default=0)
        whole = [n for n in depth if self.operators[self.nodes[n].type_id].reach is None]
        return [[n for n in whole if depth[n] == d] for d in sorted({depth[n] for n in whole})]

    def values(self, node_id: str) -> dict[str, Any]:
        from .params import checked

        node = self.nodes[node_id]
        return checked(self.operators[node.type_id].params, node.params)


class History:
    """Undo and redo by whole copies, ``UNDO_STEPS`` at most.

    ``record`` comes before an edit. Edits that name the same thing within
    ``MERGE_S`` seconds, and all those of a ``group``, are one step.
    """

    def __init__(self, graph: Graph):
        self.graph, self.past, self.future = graph, [], []
        self._last: tuple[str | None, float] = (None, 0.0)
        self._depth = 0

    def record(self, what: str | None = None, now: float | None = None) -> None:
        now = time.monotonic() if now is None else now
        same = what is not None and self._last[0] == what and now - self._last[1] <= MERGE_S
        self._last = (what, now)
        if not same and not self._depth:
            self.past = [*self.past[-(UNDO_STEPS - 1) :], self._copy()]
        self.future = []

    @contextmanager
    def group(self):
        """All edits inside are one step."""
        if not self._depth:
            self.record()
        self._depth += 1
        try:
            yield
        finally:
            self._depth -= 1
            self._last = (None, 0.0)

    def _copy(self):
        return deepcopy(self.graph.nodes), dict(self.graph.links)

    def _swap(self, here: list, there: list) -> bool:
        self._last = (None, 0.0)
        if not here:
            return False
        there.append(self._copy())
        self.graph.nodes, self.graph.links = here.pop()
        return True

    def undo(self) -> bool:
        return self._swap(self.past, self.future)

    def redo(self) -> bool:
        return self._swap(self.future, self.past)


class Evaluator:
    """Compiles outputs of a graph; a node whose key (type, version, seed, grid, world, parameters, inputs) is known is reused.

    With a ``store``, results are tables that are written once and read by
    whoever needs them, in this session or a later one. ``cancel`` stops the
    jobs of an evaluation that runs in another thread; a newer evaluation
    makes an older one stop likewise. ``progress`` is told the share of nodes
    that are done.
    """

    def __init__(self, spark: SparkSession, graph: Graph, world: World, store: ResultStore | None = None, progress: Callable[[float], None] | None = None):
        self.spark, self.graph, self.world, self.store, self.progress = spark, graph, world, store, progress
        self.known: dict[str, dict[str, Any]] = {}
        self.hits = self.misses = 0
        self.generation = 0

    def _tag(self, generation: int) -> str:
        return f"gridloom-{id(self):x}-{generation}"

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobsWithTag(self._tag(self.generation))
        self.generation += 1

    def _check(self, generation: int) -> None:
        if generation != self.generation:
            raise Cancelled("a newer evaluation has begun, or this one was cancelled")

    def outputs(self, node_id: str, spec: GridSpec) -> dict[str, Any]:
        self.cancel()
        mine, tag = self.generation, self._tag(self.generation)
        self.spark.addTag(tag)
        try:
            return self._outputs(node_id, spec, mine)
        finally:
            self.spark.removeTag(tag)

    def _outputs(self, node_id: str, spec: GridSpec, mine: int) -> dict[str, Any]:
        from ..operators import apply

        made: dict[str, tuple[str, dict]] = {}
        order = self.graph.order([node_id])
        for done, n in enumerate(order):
            self._check(mine)
            node, links = self.graph.nodes[n], self.graph.inputs(n)
            seed = node_seed(self.world.seed, n, int(node.params.get("seed", 0)))
            values = self.graph.values(n)
            text = json.dumps([node.type_id, node.version, seed, repr(spec), repr(self.world), values, sorted((k, made[f[0]][0], f[1]) for k, f in links.items())], sort_keys=True, default=str)
            key = hashlib.sha256(text.encode()).hexdigest()
            if key in self.known or (self.store and self._stored(key, spec)):
                self.hits += 1
            else:
                self.misses += 1
                given = {k: made[f[0]][1][f[1]] for k, f in links.items()}
                driven = {k[2:]: v for k, v in given.items() if k.startswith("p:")}
                own = {k: v for k, v in given.items() if not k.startswith("p:")}
                try:
                    self.known[key] = apply(node.type_id, own, values, spark=self.spark, spec=spec, world=self.world, seed=seed, driven=driven)
                    if self.store:
                        self.store.put(key, self.known[key])
                        self._stored(key, spec)
                except PlanError:
                    raise
                except Exception as e:
                    self._check(mine)
                    raise NodeFailed(f"{node.type_id} {n} failed: {e}") from e
            made[n] = key, self.known[key]
            if self.progress:
                self.progress((done + 1) / len(order))
        return made[node_id][1]

    def _stored(self, key: str, spec: GridSpec) -> bool:
        got = self.store.get(key, spec, self.world)
        if got:
            self.known[key] = got
        return bool(got)


@dataclass
class Project:
    """World, graph, outputs marked for export [(node, port, format)], and build settings."""

    world: World
    graph: Graph
    exports: list[tuple[str, str, str]] = field(default_factory=list)
    build: dict[str, Any] = field(default_factory=dict)
    ui: Any = None
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> Project:
        """Unknown operators, parameters and bad links are dropped with a warning."""
        try:
            data = json.loads(text)
        except json.JSONDecodeError as e:
            raise ProjectError(f"no project: {e}") from e
        w = data.get("world", {})
        world = World(tuple(w.get("size_m", (8192.0, 8192.0))), tuple(w.get("height_range_m", (0.0, 2000.0))), int(w.get("seed", 12345)))
        project = cls(world, Graph(), build=data.get("build", {}), ui=data.get("ui"))
        for n in data.get("nodes", []):
            try:
                project.graph.add(n["type"], node_id=n["id"], pos=tuple(n.get("pos", (0, 0))), tab=n.get("tab") or "terrain")
            except PlanError as e:
                project.warnings.append(str(e))
                continue
            params, op, saved = n.get("params", {}), project.graph.operators[n["type"]], n.get("type_version", 1)
            if saved < op.version:
                params = op.migrate(saved, dict(params)) if op.migrate else params
                project.warnings.append(f"{n['id']} was brought from version {saved} to {op.version}")
            elif saved > op.version:
                project.warnings.append(f"{n['id']} was saved by a newer version of {n['type']}; results may differ")
            for action, items in ((project.graph.set, params.items()), (project.graph.expose, [(k,) for k in n.get("exposed", [])])):
                for item in items:
                    try:
                        action(n["id"], *item)
                    except PlanError as e:
                        project.warnings.append(str(e))
        for link in data.get("links", []):
            try:
                project.graph.connect(tuple(link["from"]), tuple(link["to"]))
            except (PlanError, KeyError) as e:
                project.warnings.append(str(e))
        for e in data.get("exports", []):
            mark = (e["node"], e["port"], e.get("format", "parquet"))
            if e["node"] in project.graph.nodes and mark not in project.exports:
                project.exports.append(mark)
        return project

    def to_json(self) -> str:
        g = self.graph
        return json.dumps({
            "world": {"size_m": list(self.world.size_m), "height_range_m": list(self.world.height_range_m), "seed": self.world.seed},
            "nodes": [{"id": n.id, "type": n.type_id, "type_version": n.version, "pos": list(n.pos), "params": n.params, "exposed": sorted(n.exposed), "tab": n.tab} for _, n in sorted(g.nodes.items())],
            "links": [{"from": list(f), "to": list(t)} for t, f in sorted(g.links.items())],
            "exports": [dict(zip(("node", "port", "format"), e, strict=True)) for e in self.exports],
            "build": self.build,
            "ui": self.ui,
        }, indent=2)

    def save(self, path: str) -> None:
        """Through a file beside it, so a reader never sees half."""
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False) as f:
            f.write(self.to_json())
        os.replace(f.name, path)


def preset(text: str) -> dict[str, Any]:
    """A flat list of ``key: value`` lines; nested or repeated keys are errors, ``node`` is required."""
    out: dict[str, Any] = {}
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if line[0] in " \t-" or not colon or not value.strip():
            raise PresetError(f"not a flat key and value: {line!r}")
        if key.strip() in out:
            raise PresetError(f"{key.strip()} stands twice")
        v = value.strip().strip("\"'")
        try:
            out[key.strip()] = {"true": True, "false": False}[v] if v in ("true", "false") else float(v) if "." in v or "e" in v else int(v)
        except ValueError:
            out[key.strip()] = v
    if "node" not in out:
        raise PresetError("a preset names its node")
    return out


def preset_text(node: str, values: dict[str, Any]) -> str:
    """The flat list that ``preset`` reads; the seed stays out, numbers have four decimals at most."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    return "".join(f"{k}: {show(v)}\n" for k, v in {"node": node, **values}.items() if k != "seed")
