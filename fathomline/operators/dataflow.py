"""A typed graph of DataFrame functions: registry, composition, order of execution, content keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter


class GraphError(ValueError):
    pass


def accepts(want: str, got: str) -> bool:
    """Port types Base[a,b]: equal bases, and arguments that are equal or `*`; a bare base takes all."""
    parse = lambda t: (t.partition("[")[0], [x.strip() for x in t.partition("[")[2].rstrip("]").split(",") if x.strip()])
    (b1, a1), (b2, a2) = parse(want), parse(got)
    return b1 == b2 and (not a1 or len(a1) == len(a2) and all(x in (y, "*") for x, y in zip(a1, a2, strict=True)))


@dataclass
class NodeType:
    run: Callable
    inputs: dict[str, str]
    outputs: dict[str, str]
    params: dict = field(default_factory=dict)


class Registry:
    def __init__(self):
        self.types: dict[str, NodeType] = {}

    def register(self, name: str, run: Callable, inputs: dict | None = None, outputs: dict | None = None, **params) -> None:
        if name in self.types:
            raise GraphError(f"{name} is registered already")
        self.types[name] = NodeType(run, inputs or {}, outputs or {"out": "Frame"}, params)

    def order(self, graph: dict) -> list[str]:
        """Checks nodes {id, type, params} and edges {from: [id, port], to: [id, port]}; ids in order of execution."""
        nodes = {n["id"]: n for n in graph["nodes"]}
        if len(nodes) != len(graph["nodes"]):
            raise GraphError("a node id occurs twice")
        for n in nodes.values():
            if n["type"] not in self.types:
                raise GraphError(f"unknown type {n['type']}")
            if more := set(n.get("params", {})) - set(self.types[n["type"]].params):
                raise GraphError(f"{n['id']}: unknown parameters {sorted(more)}")
        fed: dict = {}
        for e in graph.get("edges", []):
            (a, out), (b, port) = e["from"], e["to"]
            have, want = self.types[nodes[a]["type"]].outputs.get(out), self.types[nodes[b]["type"]].inputs.get(port)
            if have is None or want is None or not accepts(want, have):
                raise GraphError(f"{a}.{out} does not fit {b}.{port}")
            if (b, port) in fed:
                raise GraphError(f"{b}.{port} is fed twice")
            fed[b, port] = (a, out)
        for n in nodes.values():
            for port in self.types[n["type"]].inputs:
                if (n["id"], port) not in fed:
                    raise GraphError(f"{n['id']}.{port} is not fed")
        self.fed = fed
        try:
            return list(TopologicalSorter({i: sorted({a for (b, _), (a, _) in fed.items() if b == i}) for i in sorted(nodes)}).static_order())
        except CycleError as e:
            raise GraphError("the graph has a cycle") from e

    def execute(self, graph: dict, cache: dict | None = None) -> dict[str, dict]:
        """Outputs of all nodes by id; nodes whose content key is in the cache are not run again."""
        nodes, out, keys = {n["id"]: n for n in graph["nodes"]}, {}, {}
        cache = {} if cache is None else cache
        for i in self.order(graph):
            kind = self.types[nodes[i]["type"]]
            params = kind.params | nodes[i].get("params", {})
            feeds = {port: self.fed[i, port] for port in kind.inputs}
            keys[i] = hashlib.sha256(json.dumps([nodes[i]["type"], params, {p: [keys[a], o] for p, (a, o) in feeds.items()}], sort_keys=True).encode()).hexdigest()
            if keys[i] not in cache:
                got = kind.run({p: out[a][o] for p, (a, o) in feeds.items()}, params)
                cache[keys[i]] = got if isinstance(got, dict) else {next(iter(kind.outputs)): got}
            out[i] = cache[keys[i]]
        return out


@dataclass(frozen=True)
class Diagram:
    """Nodes and edges with what is open on either side: `wants` holds (node, port, type) of unfed inputs by port name,
    `gives` the output of each name. a >> b feeds b's inputs from a's outputs of the same names; a @ b puts both side by
    side."""

    nodes: tuple = ()
    edges: tuple = ()
    wants: dict = field(default_factory=dict)
    gives: dict = field(default_factory=dict)

    def _with(self, other: Diagram, edges: list, wants: dict) -> Diagram:
        if clash := {n["id"] for n in self.nodes} & {n["id"] for n in other.nodes}:
            raise GraphError(f"node ids occur twice: {sorted(clash)}")
        both = {k: (*self.wants.get(k, ()), *wants.get(k, ())) for k in [*self.wants, *wants]}
        return Diagram(self.nodes + other.nodes, (*self.edges, *other.edges, *edges), both, self.gives | other.gives)

    def __rshift__(self, other: Diagram) -> Diagram:
        edges = []
        for name in other.wants.keys() & self.gives.keys():
            a, out, have = self.gives[name]
            for b, port, want in other.wants[name]:
                if not accepts(want, have):
                    raise GraphError(f"{a}.{out}: {have} does not fit {b}.{port}: {want}")
                edges.append({"from": [a, out], "to": [b, port]})
        return self._with(other, sorted(edges, key=str), {k: v for k, v in other.wants.items() if k not in self.gives})

    def __matmul__(self, other: Diagram) -> Diagram:
        if clash := self.gives.keys() & other.gives.keys():
            raise GraphError(f"ambiguous outputs: {sorted(clash)}")
        return self._with(other, [], other.wants)

    def signature(self) -> str:
        wants = sorted({f"{k}: {t}" for k, v in self.wants.items() for *_, t in v})
        return f"({', '.join(wants)}) -> ({', '.join(sorted(f'{k}: {t}' for k, (*_, t) in self.gives.items()))})"

    def graph(self) -> dict:
        if self.wants:
            raise GraphError(f"open inputs: {sorted(f'{n}.{p}' for v in self.wants.values() for n, p, _ in v)}")
        return {"nodes": [dict(n) for n in self.nodes], "edges": [dict(e) for e in self.edges]}


def box(registry: Registry, kind: str, name: str | None = None, **params) -> Diagram:
    """One node of a registered type."""
    if kind not in registry.types:
        raise GraphError(f"unknown type {kind}")
    t, name = registry.types[kind], name or kind
    if more := set(params) - set(t.params):
        raise GraphError(f"{name}: unknown parameters {sorted(more)}")
    return Diagram(({"id": name, "type": kind, "params": params},), (), {p: ((name, p, x),) for p, x in t.inputs.items()}, {p: (name, p, x) for p, x in t.outputs.items()})


def unavailable(graph: dict, missing: set[str]) -> set[str]:
    """Nodes without what they need: those missing, and all that are fed from them."""
    out = set(missing)
    while more := {e["to"][0] for e in graph["edges"] if e["from"][0] in out} - out:
        out |= more
    return out


def standard() -> Registry:
    """Node types of market data, features, signals, sizing, simulation and statistics, over frames keyed by symbol and ts."""
    from pyspark.sql import functions as F

    from . import portfolio, validation, volume

    r = Registry()
    bars, signal, weight, pnl = {"bars": "Frame[bars]"}, {"signal": "Frame[signal]"}, {"weights": "Frame[weights]"}, {"pnl": "Frame[pnl]"}
    put = lambda name, run, inputs, outputs, **params: r.register(name, run, inputs, outputs, **params)
    put("data.frame", lambda i, p: p["frame"], {}, bars, frame=None)
    put("feature.excess_volume", lambda i, p: volume.excess_volume(i["bars"], p["window"]), bars, {"features": "Frame[features]"}, window=20)
    put("feature.signed_momentum", lambda i, p: volume.detrend(i["bars"], "close", "logdiff", p["lookback"], out="momentum"), bars, {"features": "Frame[features]"}, lookback=12)
    put("signal.direction", lambda i, p: i["features"].withColumn("direction", F.signum(p["column"])), {"features": "Frame[features]"}, signal, column="momentum")
    put("sizing.fixed", lambda i, p: i["signal"].withColumn("weight", F.col("direction") * p["exposure"]), signal, weight, exposure=1.0)
    put("backtest.vector", lambda i, p: portfolio.simulate(i["weights"].withColumn("ret", F.col("close") / F.lag("close").over(volume.Window.partitionBy("symbol").orderBy("ts")) - 1), "weight", "close", "ret", whole=p["whole"]), weight, pnl, whole=False)
    put("validation.report", lambda i, p: validation.validation_report(i["pnl"], p["trials"], ret="pnl"), pnl, {"report": "Frame[report]"}, trials=1)
    put("stat.facts", lambda i, p: validation.facts(i["pnl"], ret="pnl"), pnl, {"facts": "Frame[facts]"})
    return r
