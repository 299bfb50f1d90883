"""Pipelines: the intent (a list of steps), its compiled graph, their checks."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field


KINDS = ("query", "transform", "llm", "http", "write", "conditional", "loop", "merge", "parallel")
INPUT, OUTPUT = "_input", "_output"


class PipelineError(ValueError):
    """Problems of a pipeline, each with a code."""

    def __init__(self, problems: list[dict]):
        self.problems = problems
        self.codes = [p["code"] for p in problems]
        super().__init__("; ".join(f"{p['code']}: {p['message']}" for p in problems))


@dataclass
class Edge:
    source: str
    target: str
    kind: str = "data"  # data or control
    condition: str | None = None  # true, false, always, error
    input: str | None = None


@dataclass
class Node:
    id: str
    kind: str
    payload: dict = field(default_factory=dict)
    error_policy: dict = field(default_factory=lambda: {"onError": "fail"})
    description: str = ""


@dataclass
class Graph:
    nodes: dict[str, Node]
    edges: list[Edge]
    entry: list[str]
    exits: list[str]
    budget: dict = field(default_factory=dict)
    id: str = "pipeline"

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Graph:
        raw = json.loads(text)
        return cls({k: Node(**n) for k, n in raw["nodes"].items()}, [Edge(**e) for e in raw["edges"]], raw["entry"], raw["exits"], raw["budget"], raw["id"])

    def inputs(self, node: str) -> list[Edge]:
        return [e for e in self.edges if e.target == node and e.kind == "data"]

    def controls(self, node: str) -> list[Edge]:
        return [e for e in self.edges if e.target == node and e.kind == "control"]

    def order(self) -> list[str]:
        """Topological order; raises CYCLE_DETECTED."""
        waiting = {n: 0 for n in self.nodes}
        for e in self.edges:
            if e.target in waiting and e.source in waiting:
                waiting[e.target] += 1
        ready = [n for n in self.nodes if not waiting[n]]
        out = []
        while ready:
            n = ready.pop(0)
            out.append(n)
            for e in self.edges:
                if e.source == n and e.target in waiting:
                    waiting[e.target] -= 1
                    if not waiting[e.target]:
                        ready.append(e.target)
        if len(out) < len(self.nodes):
            left = sorted(set(self.nodes) - set(out))
            raise PipelineError([{"code": "CYCLE_DETECTED", "message": f"Cycle among {', '.join(left)}"}])
        return out


def validate_graph(graph: Graph, kinds: set[str]) -> None:
    bad = []

    def add(code: str, message: str) -> None:
        bad.append({"code": code, "message": message})

    for n in graph.entry:
        if n not in graph.nodes:
            add("ENTRY_NODE_MISSING", f"Entry node '{n}' does not exist")
        elif graph.inputs(n):
            add("ENTRY_NODE_HAS_INPUTS", f"Entry node '{n}' has inputs")
    for n in graph.exits:
        if n not in graph.nodes:
            add("EXIT_NODE_MISSING", f"Exit node '{n}' does not exist")
        elif any(e.source == n for e in graph.edges):
            add("EXIT_NODE_HAS_OUTPUTS", f"Exit node '{n}' has outputs")
    for e in graph.edges:
        if e.source not in graph.nodes:
            add("EDGE_SOURCE_INVALID", f"Edge from unknown node '{e.source}'")
        if e.target not in graph.nodes:
            add("EDGE_TARGET_INVALID", f"Edge to unknown node '{e.target}'")
    touched = {n for e in graph.edges for n in (e.source, e.target)}
    for n, node in graph.nodes.items():
        if n not in touched and len(graph.nodes) > 1:
            add("ORPHANED_NODE", f"Node '{n}' is connected to nothing")
        if node.kind not in kinds:
            add("UNKNOWN_NODE_KIND", f"Node '{n}' has unknown kind '{node.kind}'")
    if not bad:
        try:
            graph.order()
        except PipelineError as e:
            bad += e.problems
    if bad:
        raise PipelineError(bad)


def validate_intent(intent: Mapping) -> None:
    steps = list(intent.get("steps") or [])
    bad = []

    def add(code: str, step: str, message: str) -> None:
        bad.append({"code": code, "stepId": step, "message": message})

    ids: set[str] = set()
    for s in steps:
        if s["id"] in ids:
            add("DUPLICATE_STEP_ID", s["id"], f"Step id '{s['id']}' is used twice")
        ids.add(s["id"])
    for s in steps:
        for d in s.get("dependsOn") or []:
            if d not in ids:
                add("INVALID_DEPENDENCY", s["id"], f"Step '{s['id']}' depends on unknown step '{d}'")
        kind = s["kind"]
        if kind == "conditional":
            for name, code in (("trueBranch", "TRUE_BRANCH"), ("falseBranch", "FALSE_BRANCH")):
                if not s.get(name):
                    add(f"MISSING_{code}", s["id"], f"Conditional step '{s['id']}' has no {name}")
                elif s[name] not in ids:
                    add(f"INVALID_{code}", s["id"], f"Conditional step '{s['id']}' names unknown step '{s[name]}'")
            if s.get("mergeStep") and s["mergeStep"] not in ids:
                add("INVALID_MERGE_STEP", s["id"], f"Conditional step '{s['id']}' names unknown merge step '{s['mergeStep']}'")
        elif kind == "loop":
            if not s.get("loopBody"):
                add("MISSING_LOOP_BODY", s["id"], f"Loop step '{s['id']}' has no body")
            for b in s.get("loopBody") or []:
                if b not in ids:
                    add("INVALID_LOOP_BODY", s["id"], f"Loop step '{s['id']}' names unknown step '{b}'")
        elif kind == "merge":
            if len(s.get("mergeFrom") or []) < 2:
                add("INVALID_MERGE_FROM", s["id"], f"Merge step '{s['id']}' needs two sources")
            for b in s.get("mergeFrom") or []:
                if b not in ids:
                    add("INVALID_MERGE_SOURCE", s["id"], f"Merge step '{s['id']}' names unknown step '{b}'")
        elif kind == "parallel":
            if not s.get("parallelBranches"):
                add("MISSING_PARALLEL_BRANCHES", s["id"], f"Parallel step '{s['id']}' has no branches")
            for b in s.get("parallelBranches") or []:
                if b not in ids:
                    add("INVALID_PARALLEL_BRANCH", s["id"], f"Parallel step '{s['id']}' names unknown step '{b}'")
        elif kind in ("write", "http"):
            fed = any(s["id"] in (x.get("trueBranch"), x.get("falseBranch"), *(x.get("loopBody") or []), *(x.get("parallelBranches") or [])) for x in steps)
            free = kind == "write" and (s.get("config") or {}).get("payload", {}).get("staticValues")
            if not s.get("dependsOn") and not fed and not free:
                add(f"{kind.upper()}_MISSING_INPUT", s["id"], f"Step '{s['id']}' has no input")
    if not bad:
        needs = {s["id"]: set(s.get("dependsOn") or []) | set(s.get("mergeFrom") or []) for s in steps}
        done: set[str] = set()
        while True:
            ready = [i for i, n in needs.items() if i not in done and n <= done]
            if not ready:
                break
            done |= set(ready)
        if len(done) < len(needs):
            add("CYCLE_DETECTED", sorted(set(needs) - done)[0], f"Cycle among {', '.join(sorted(set(needs) - done))}")
    if bad:
        raise PipelineError(bad)


def compile_intent(intent: Mapping, payloads: Mapping[str, dict] | None = None) -> Graph:
    """The graph of an intent. A step's payload is ``payloads[id]`` or
    ``config.payload``; what follows from the step itself is filled in."""
    validate_intent(intent)
    steps = {s["id"]: s for s in intent["steps"]}
    nodes = {INPUT: Node(INPUT, "input"), OUTPUT: Node(OUTPUT, "output", {"outputKey": "result"})}
    edges: list[Edge] = []
    inside = {b for s in steps.values() if s["kind"] == "loop" for b in s["loopBody"]}
    branch_of: dict[str, tuple[str, str]] = {}
    for s in steps.values():
        config = s.get("config") or {}
        payload = dict((payloads or {}).get(s["id"]) or config.get("payload") or {})
        if s["kind"] == "loop":
            payload.setdefault("mode", s.get("loopMode", "forEach"))
            payload.setdefault("maxIterations", s.get("maxIterations", 100))
            payload.setdefault("iterVar", "item")
            payload["body"] = list(s["loopBody"])
        elif s["kind"] == "merge":
            payload.setdefault("strategy", s.get("mergeStrategy", "union"))
            payload.setdefault("joinOn", config.get("joinOn"))
        elif s["kind"] == "parallel":
            payload.setdefault("maxConcurrency", s.get("maxConcurrency", 4))
            payload["branches"] = list(s["parallelBranches"])
        nodes[s["id"]] = Node(s["id"], s["kind"], payload, config.get("errorPolicy") or {"onError": "fail"}, s.get("description", ""))
        if s["kind"] == "conditional":
            branch_of[s["trueBranch"]] = (s["id"], "true")
            branch_of[s["falseBranch"]] = (s["id"], "false")
        if s["kind"] == "parallel":
            for b in s["parallelBranches"]:
                branch_of[b] = (s["id"], "always")
    for s in steps.values():
        i = s["id"]
        if i in inside:
            edges += [Edge(d, i) for d in s.get("dependsOn") or [] if d in inside]
            continue
        sources = [*(s.get("dependsOn") or []), *[m for m in s.get("mergeFrom") or [] if m not in (s.get("dependsOn") or [])]]
        edges += [Edge(d, i) for d in sources]
        if i in branch_of:
            owner, condition = branch_of[i]
            edges.append(Edge(owner, i, "control", condition))
            if not sources:
                edges.append(Edge(owner, i))
        elif not sources:
            edges.append(Edge(INPUT, i))
    for s in steps.values():
        for m in [s["mergeStep"]] if s.get("mergeStep") else []:
            for b in (s["trueBranch"], s["falseBranch"]):
                if not any(e.source == b and e.target == m for e in edges):
                    edges.append(Edge(b, m))
    has_out = {e.source for e in edges}
    for i in steps:
        if i not in has_out and i not in inside:
            edges.append(Edge(i, OUTPUT))
    return Graph(nodes, edges, [INPUT], [OUTPUT], dict(intent.get("budget") or {}))


def describe(graph: Graph) -> str:
    """One line a node, in running order."""
    out = []
    for n in graph.order():
        node = graph.nodes[n]
        if n not in (INPUT, OUTPUT):
            out.append(f"{n} [{node.kind}] <- {', '.join(e.source for e in graph.inputs(n)) or '-'}: {node.description}")
    return "\n".join(out)


def body_graph(graph: Graph, body: list[str]) -> Graph:
    """The part of a graph that a loop runs for each item."""
    edges = [e for e in graph.edges if e.source in body and e.target in body]
    fed = {e.target for e in edges}
    feeds = {e.source for e in edges}
    return Graph({b: graph.nodes[b] for b in body}, edges, [b for b in body if b not in fed], [b for b in body if b not in feeds])
