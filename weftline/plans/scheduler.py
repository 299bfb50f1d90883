"""Runs a pipeline graph on the driver.

Nodes pass lazy DataFrames, so a run of query and transform nodes is one
Catalyst plan. Work starts only where a value is needed: conditions, loop
items, error policies other than fail, budgets, side effects and the end.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections import ChainMap
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import FunctionRegistry, builtins
from weftline.operators.transform import apply_operations, first_rows, merge, union_all
from weftline.plans.expressions import Compiler, columns_resolver, evaluate
from weftline.plans.graph import Graph, body_graph, validate_graph
from weftline.plans.intent import Query
from weftline.plans.options import DEFAULT, Options


class BudgetExceeded(RuntimeError):
    pass


class MissingParam(KeyError):
    pass


@dataclass
class Budget:
    max_llm_calls: int = 20
    max_http_calls: int = 1000
    max_iterations: int = 1000
    timeout_s: float = 300.0
    max_rows_per_node: int | None = None
    llm_calls: int = 0
    http_calls: int = 0
    iterations: int = 0
    started: float = field(default_factory=time.monotonic)

    def spend(self, what: str, n: int = 1) -> None:
        used = getattr(self, what) + n
        setattr(self, what, used)
        if used > getattr(self, f"max_{what}"):
            raise BudgetExceeded(f"{what}: {used} of {getattr(self, f'max_{what}')}")

    def spend_rows(self, what: str, df: DataFrame) -> None:
        """Spend one for each row; no more rows are counted than are left."""
        self.spend(what, df.limit(max(0, getattr(self, f"max_{what}") - getattr(self, what)) + 1).count())

    def left(self) -> float:
        return self.timeout_s - (time.monotonic() - self.started)

    def check_time(self) -> None:
        if self.left() <= 0:
            raise BudgetExceeded(f"timeout: {self.timeout_s} s")


@dataclass
class Value:
    """What flows on an edge: tabular (DataFrame), record (one row), scalar,
    collection (list of Values) or void."""

    kind: str
    data: Any = None

    def table(self, spark: SparkSession) -> DataFrame:
        if self.kind in ("tabular", "record"):
            return self.data
        if self.kind == "collection":
            parts = [v.table(spark) for v in self.data if v.kind != "void"]
            return union_all(parts) if parts else spark.range(0).drop("id")
        if self.kind == "scalar":
            return spark.createDataFrame([(self.data,)], ["value"])
        return spark.range(0).drop("id")

    def scalar(self) -> Any:
        if self.kind == "scalar":
            return self.data
        rows = self.data.limit(2).collect() if self.kind in ("tabular", "record") else []
        if len(rows) != 1 or len(rows[0]) != 1:
            raise ValueError("a scalar needs one row of one column")
        return rows[0][0]


VOID = Value("void")


@dataclass
class Context:
    spark: SparkSession
    load: Callable[[str], DataFrame]
    params: Mapping[str, Any] = field(default_factory=dict)
    scope: Mapping[str, Any] = field(default_factory=dict)
    budget: Budget = field(default_factory=Budget)
    functions: FunctionRegistry = field(default_factory=builtins)
    options: Options = DEFAULT
    outputs: dict[str, Value] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)
    llm: Callable | None = None
    http: Callable | None = None
    store: Any = None
    listener: Callable[[dict], None] | None = None
    catalog: Any = None
    grants: Any = None
    cached: list[DataFrame] = field(default_factory=list)

    def event(self, what: str, node: str, **more: Any) -> None:
        e = {"event": what, "node": node, "at": time.time(), **more}
        self.trace.append(e)
        if self.listener:
            self.listener(e)

    def child(self, **names: Any) -> Context:
        """A scope that sees this one's names; its own stay inside."""
        return Context(self.spark, self.load, self.params, ChainMap(names, self.scope), self.budget, self.functions, self.options, dict(self.outputs), self.trace, self.llm, self.http, self.store, self.listener, self.catalog, self.grants, self.cached)

    def refs(self) -> dict[str, Any]:
        out = dict(self.scope)
        out |= {k: v.data if v.kind in ("tabular", "record", "scalar") else v.table(self.spark) for k, v in self.outputs.items() if v.kind != "void"}
        return out


NodeFn = Callable[[Any, list[Value], Context], Value]


class NodeRegistry:
    """Kinds of nodes; each is a function (node, inputs, context) -> Value."""

    def __init__(self) -> None:
        self._by_kind: dict[str, NodeFn] = {}

    def register(self, kind: str, fn: NodeFn) -> None:
        if kind in self._by_kind:
            raise ValueError(f"Node kind already registered: {kind}")
        self._by_kind[kind] = fn

    def get(self, kind: str) -> NodeFn:
        return self._by_kind[kind]

    def kinds(self) -> set[str]:
        return set(self._by_kind) | {"conditional", "loop", "parallel"}


def _input(node, inputs, ctx: Context) -> Value:
    source = node.payload.get("source")
    if not source:
        return VOID
    if source["kind"] == "static":
        data = source["data"]
        return Value("tabular", data if isinstance(data, DataFrame) else ctx.spark.createDataFrame(data, node.payload.get("schema")))
    if source["paramKey"] not in ctx.params:
        raise MissingParam(source["paramKey"])
    data = ctx.params[source["paramKey"]]
    if not isinstance(data, DataFrame):
        raise TypeError(f"parameter '{source['paramKey']}' is not a table")
    return Value("tabular", data)


def _output(node, inputs, ctx: Context) -> Value:
    live = [v for v in inputs if v.kind != "void"]
    return live[0] if len(live) == 1 else Value("collection", live) if live else VOID


def _query(node, inputs, ctx: Context) -> Value:
    q = Query(ctx.spark, ctx.load, ctx.catalog, ctx.refs(), ctx.options, ctx.functions, ctx.grants)
    return Value("tabular", q.run(node.payload["intent"]))


def _transform(node, inputs, ctx: Context) -> Value:
    live = [v for v in inputs if v.kind != "void"]
    operations = node.payload.get("operations") or []
    if not live:  # expressions over the scope alone
        return Value("record", apply_operations(ctx.spark.range(1).drop("id"), operations, ctx.scope, ctx.functions, ctx.options))
    df = live[0].table(ctx.spark)
    return Value("tabular", apply_operations(df, operations, ctx.scope, ctx.functions, ctx.options))


def _merge(node, inputs, ctx: Context) -> Value:
    live = [v for v in inputs if v.kind != "void"]
    if not live:
        return VOID
    return Value("tabular", merge(node.payload.get("strategy", "union"), [v.table(ctx.spark) for v in live], node.payload.get("joinOn")))


def _write(node, inputs, ctx: Context) -> Value:
    live = [v for v in inputs if v.kind != "void"]
    if ctx.grants is not None:
        ctx.grants.check_payload(node.payload)
    return Value("tabular", ctx.store.apply(node.payload, live[0].table(ctx.spark) if live else None))


def _llm(node, inputs, ctx: Context) -> Value:
    from weftline.operators.enrich import llm_map

    df = inputs[0].table(ctx.spark)
    ctx.budget.spend_rows("llm_calls", df)
    return Value("tabular", llm_map(df, node.payload, ctx.llm))


def _http(node, inputs, ctx: Context) -> Value:
    from weftline.operators.enrich import http_map

    df = inputs[0].table(ctx.spark)
    ctx.budget.spend_rows("http_calls", df)
    return Value("tabular", http_map(df, node.payload, ctx.http))


def default_nodes() -> NodeRegistry:
    r = NodeRegistry()
    for kind, fn in (("input", _input), ("output", _output), ("query", _query), ("transform", _transform), ("merge", _merge), ("write", _write), ("llm", _llm), ("http", _http)):
        r.register(kind, fn)
    return r


@dataclass
class Result:
    status: str
    outputs: dict[str, Value]
    trace: list[dict]
    errors: dict[str, str]
    spark: SparkSession
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Let go of what error policies kept; the tables stay readable."""
        for df in self.cached:
            df.unpersist()
        self.cached.clear()

    def table(self, node: str = "_output") -> DataFrame:
        return self.outputs[node].table(self.spark)


class Scheduler:
    def __init__(self, nodes: NodeRegistry | None = None, sleep: Callable[[float], None] = time.sleep):
        self.nodes, self.sleep = nodes or default_nodes(), sleep

    def run(self, graph: Graph, ctx: Context) -> Result:
        validate_graph(_outer(graph), self.nodes.kinds())
        errors: dict[str, str] = {}
        skipped: set[str] = set()
        ran_in_parallel: set[str] = set()
        inside = _inside(graph)
        status = "success"
        for name in [n for n in graph.order() if n not in inside]:
            if name in ran_in_parallel:
                continue
            if self._is_skipped(graph, name, skipped, ctx):
                skipped.add(name)
                ctx.outputs[name] = VOID
                ctx.event("skip", name)
                continue
            try:
                ctx.budget.check_time()
                value = self._node(graph, name, ctx, skipped)
            except Exception as e:
                errors[name] = str(e)
                ctx.event("error", name, message=str(e))
                handlers = [c.target for c in graph.edges if c.source == name and c.kind == "control" and c.condition == "error"]
                if not handlers:
                    ctx.event("pipeline_error", name)
                    return Result("failed", ctx.outputs, ctx.trace, errors, ctx.spark, ctx.cached)
                status, value = "partial", VOID
            ctx.outputs[name] = value
            if graph.nodes[name].kind == "parallel":
                ran_in_parallel |= self._branches(graph, name, ctx)
        if any(e["event"] == "skipped_on_error" for e in ctx.trace):
            status = "partial"
        ctx.event("pipeline_complete", "", status=status)
        return Result(status, ctx.outputs, ctx.trace, errors, ctx.spark, ctx.cached)

    # -- control flow

    def _is_skipped(self, graph: Graph, name: str, skipped: set[str], ctx: Context) -> bool:
        controls = graph.controls(name)
        for c in controls:
            if c.source in skipped:
                return True
            if c.condition in ("true", "false"):
                taken = ctx.outputs.get(f"{c.source}?")
                if taken is not None and str(taken.data).lower() != c.condition:
                    return True
            if c.condition == "error" and not any(e["event"] == "error" and e["node"] == c.source for e in ctx.trace):
                return True
        sources = graph.inputs(name)
        if sources and graph.nodes[name].kind not in ("merge", "output"):
            return all(e.source in skipped for e in sources)
        return bool(sources) and all(e.source in skipped for e in sources)

    def _inputs(self, graph: Graph, name: str, ctx: Context, skipped: set[str]) -> list[Value]:
        edges = [e for e in graph.inputs(name) if e.source not in skipped]
        values = [ctx.outputs[e.source] for e in edges if e.source in ctx.outputs]
        node = graph.nodes[name]
        live = [v for v in values if v.kind != "void"]
        if node.kind in ("merge", "output", "loop", "parallel") or len(live) < 2:
            return values
        # Several inputs of one node: one row of their first rows, queries first.
        pairs = [(ctx.outputs[e.source].table(ctx.spark), graph.nodes[e.source].kind == "query") for e in edges if ctx.outputs[e.source].kind != "void"]
        return [Value("record", first_rows(pairs))]

    def _node(self, graph: Graph, name: str, ctx: Context, skipped: set[str]) -> Value:
        node, inputs = graph.nodes[name], self._inputs(graph, name, ctx, skipped)
        ctx.event("start", name, kind=node.kind)
        began = time.monotonic()
        policy = node.error_policy or {}
        tries = int(policy.get("maxRetries", 0)) + 1
        for attempt in range(tries):
            try:
                value = self._execute(graph, node, inputs, ctx)
                if policy.get("onError", "fail") != "fail" or tries > 1:
                    value = self._forced(value, ctx)  # errors must show here, not later
                if ctx.budget.max_rows_per_node is not None and value.kind == "tabular":
                    n = value.data.limit(ctx.budget.max_rows_per_node + 1).count()
                    if n > ctx.budget.max_rows_per_node:
                        raise BudgetExceeded(f"node '{name}' has over {ctx.budget.max_rows_per_node} rows")
                ctx.event("complete", name, ms=round((time.monotonic() - began) * 1000), retries=attempt)
                return value
            except BudgetExceeded:
                raise
            except Exception as e:
                if attempt + 1 < tries:
                    ctx.event("retry", name, attempt=attempt + 1, message=str(e))
                    self.sleep(float(policy.get("delayMs", 100)) / 1000 * 2**attempt)
                    continue
                how = policy.get("onError", "fail")
                if how == "skip":
                    ctx.event("skipped_on_error", name, message=str(e))
                    return inputs[0] if inputs else VOID
                if how == "fallback" and policy.get("fallbackNode"):
                    ctx.event("fallback", name, to=policy["fallbackNode"], message=str(e))
                    return self._execute(graph, graph.nodes[policy["fallbackNode"]], inputs, ctx)
                raise
        raise AssertionError

    @staticmethod
    def _forced(value: Value, ctx: Context) -> Value:
        if value.kind in ("tabular", "record"):
            ctx.cached.append(value.data.persist())
            value.data.count()
        return value

    def _execute(self, graph: Graph, node, inputs: list[Value], ctx: Context) -> Value:
        if node.kind == "conditional":
            taken = self._condition(node.payload["predicate"], inputs, ctx)
            ctx.outputs[f"{node.id}?"] = Value("scalar", taken)
            return inputs[0] if inputs else VOID
        if node.kind == "loop":
            return self._loop(graph, node, inputs, ctx)
        if node.kind == "parallel":
            return inputs[0] if inputs else VOID
        return self.nodes.get(node.kind)(node, inputs, ctx)

    def _condition(self, predicate: Mapping, inputs: list[Value], ctx: Context) -> bool:
        live = [v for v in inputs if v.kind != "void"]
        if live:
            df = live[0].table(ctx.spark)
            rows = df.limit(1).select(Compiler(columns_resolver(df.columns), ctx.scope, ctx.functions, ctx.options)(predicate).alias("v")).collect()
            taken = rows[0][0] if rows else evaluate(ctx.spark, predicate, ctx.scope, ctx.functions, ctx.options)
        else:
            taken = evaluate(ctx.spark, predicate, ctx.scope, ctx.functions, ctx.options)
        if not isinstance(taken, bool):
            raise TypeError(f"a condition must be boolean, got {taken!r}")
        return taken

    def _branches(self, graph: Graph, name: str, ctx: Context) -> set[str]:
        """Run all branches, each to its end; every node of them runs."""
        node, value = graph.nodes[name], ctx.outputs[name]
        heads = node.payload.get("branches") or [e.target for e in graph.edges if e.source == name]
        heads = list(dict.fromkeys(heads))
        chains: list[list[str]] = []
        for h in heads:
            chain, at = [h], h
            while True:
                nexts = [e.target for e in graph.edges if e.source == at and e.kind == "data"]
                if len(nexts) != 1 or len(graph.inputs(nexts[0])) != 1 or graph.nodes[nexts[0]].kind in ("output", "merge"):
                    break
                at = nexts[0]
                chain.append(at)
            chains.append(chain)

        def run(chain: list[str]) -> None:
            for i, n in enumerate(chain):
                own = [value] if i == 0 else [ctx.outputs[chain[i - 1]]]
                ctx.event("start", n, kind=graph.nodes[n].kind)
                ctx.outputs[n] = self._execute(graph, graph.nodes[n], own, ctx)
                ctx.event("complete", n)

        with ThreadPoolExecutor(max(1, min(int(node.payload.get("maxConcurrency", 4)), 4))) as pool:
            for f in [pool.submit(run, c) for c in chains]:
                f.result()
        return {n for c in chains for n in c}

    # -- loops

    def _loop(self, graph: Graph, node, inputs: list[Value], ctx: Context) -> Value:
        p = node.payload
        body = body_graph(graph, p["body"])
        live = [v for v in inputs if v.kind != "void"]
        if p.get("mode", "forEach") == "while":
            return self._while(graph, node, body, live, ctx)
        source = live[0] if live else VOID
        if p.get("over"):
            over = p["over"]
            if over["kind"] == "VarRef" and over["name"] in ctx.outputs:
                source = ctx.outputs[over["name"]]
        fast = self._vectorised(node, body, source, ctx)
        if fast is not None:
            return fast
        limit, results, cut = int(p["maxIterations"]), [], False
        for i, (item, one) in enumerate(_items(source, ctx.spark, limit + 1)):
            if i >= limit:
                cut = True
                break
            ctx.budget.spend("iterations")
            results.append(self._once(body, one, ctx.child(**{p["iterVar"]: item, **({p["indexVar"]: i} if p.get("indexVar") else {})})))
        if cut:
            ctx.event("loop_truncated", node.id, maxIterations=limit)
        return self._accumulate(p.get("accumulator"), results, ctx)

    def _vectorised(self, node, body: Graph, source: Value, ctx: Context) -> Value | None:
        """A body of row-wise transforms over a table is one plan, not a loop."""
        p = node.payload
        order = body.order()
        row_wise = ("addField", "removeField", "renameField", "castField", "filterRows")
        plain = (p.get("accumulator") or {"kind": "collect"})["kind"] == "collect" and not p.get("indexVar")
        if source.kind != "tabular" or not plain or len(body.entry) != 1 or len(body.exits) != 1:
            return None
        if any(body.nodes[n].kind != "transform" or any(o["kind"] not in row_wise for o in body.nodes[n].payload.get("operations") or []) for n in order):
            return None
        limit = int(p["maxIterations"])
        df = source.data
        if len(df.limit(limit + 1).select(F.lit(1)).take(limit + 1)) > limit:
            ctx.event("loop_truncated", node.id, maxIterations=limit)
            df = df.limit(limit)
        record: dict[str, Column] = {c: F.col(f"_item.`{c}`") for c in df.columns}
        df = df.select("*", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_item"))
        for n in order:
            df = apply_operations(df, body.nodes[n].payload.get("operations") or [], ChainMap({p["iterVar"]: record}, ctx.scope), ctx.functions, ctx.options)
        return Value("collection", [Value("tabular", df.drop("_item"))])

    def _while(self, graph: Graph, node, body: Graph, live: list[Value], ctx: Context) -> Value:
        p, results = node.payload, []
        source = live[0] if live else VOID
        for i in range(int(p["maxIterations"]) + 1):
            scope = ctx.child(**{p["iterVar"]: i, **({p["indexVar"]: i} if p.get("indexVar") else {})})
            taken = evaluate(ctx.spark, p["condition"], scope.scope, ctx.functions, ctx.options)
            if not isinstance(taken, bool):
                raise TypeError(f"a loop condition must be boolean, got {taken!r}")
            if not taken:
                break
            if i == int(p["maxIterations"]):
                ctx.event("loop_truncated", node.id, maxIterations=p["maxIterations"])
                break
            ctx.budget.spend("iterations")
            results.append(self._once(body, source, scope))
        return self._accumulate(p.get("accumulator"), results, ctx)

    def _once(self, body: Graph, item: Value, ctx: Context) -> Value:
        skipped: set[str] = set()
        for n in body.order():
            if self._is_skipped(body, n, skipped, ctx):
                skipped.add(n)
                ctx.outputs[n] = VOID
                continue
            inputs = self._inputs(body, n, ctx, skipped) if body.inputs(n) else [item]
            ctx.outputs[n] = self._execute(body, body.nodes[n], inputs, ctx)
        ends = [ctx.outputs[n] for n in body.exits if n not in skipped]
        return ends[0] if ends else VOID

    def _accumulate(self, how: Mapping | None, results: list[Value], ctx: Context) -> Value:
        kind = (how or {"kind": "collect"})["kind"]
        live = [r for r in results if r.kind != "void"]
        if kind == "collect":
            return Value("collection", live)
        tables = [r.table(ctx.spark) for r in live]
        records: list[dict[str, Any]] = [{} for _ in tables]
        same = len({t.schema.simpleString() for t in tables}) == 1
        parts = [t.limit(1).select(F.lit(i).alias("_i"), F.struct("*").alias("_r")) for i, t in enumerate(tables) if t.columns]
        for part in [union_all(parts)] if same and parts else parts:  # one job where the tables are alike
            for i, r in part.collect():
                records[i] = r.asDict(True)
        if kind == "merge":
            merged: dict[str, Any] = {}
            for r in records:
                merged |= r
            return Value("record", ctx.spark.createDataFrame([merged]) if merged else ctx.spark.range(0).drop("id"))
        acc = how.get("initial")
        for r in records:
            acc = evaluate(ctx.spark, how["reducer"], ChainMap({"acc": acc, "item": r}, ctx.scope), ctx.functions, ctx.options)
        return Value("scalar", acc)


def _inside(graph: Graph) -> set[str]:
    return {b for n in graph.nodes.values() if n.kind == "loop" for b in n.payload.get("body") or []}


def _outer(graph: Graph) -> Graph:
    """The graph as checked: loop bodies hang on their loop."""
    inside = _inside(graph)
    nodes = {n: v for n, v in graph.nodes.items() if n not in inside}
    return Graph(nodes, [e for e in graph.edges if e.source not in inside and e.target not in inside], graph.entry, graph.exits, graph.budget, graph.id)


def _items(value: Value, spark: SparkSession, limit: int):
    """(item as Python value, item as Value) of a table's rows or a collection."""
    if value.kind in ("tabular", "record"):
        df = value.data
        for row in df.limit(limit).toLocalIterator():
            yield row.asDict(True), Value("record", spark.createDataFrame([row], df.schema))
    elif value.kind == "collection":
        for v in value.data[:limit]:
            if v.kind in ("tabular", "record"):
                rows = v.data.limit(1).collect()
                yield (rows[0].asDict(True) if rows else {}), v
            else:
                yield v.data, v
    elif value.kind == "scalar":
        yield value.data, value


def preflight(graph: Graph, catalog: Any) -> list[str]:
    """What the catalog says against the query and write nodes, before any runs."""
    from weftline.plans.intent import IntentError, validate
    from weftline.sources.writes import validate_write

    out = []
    for name, node in graph.nodes.items():
        p = node.payload
        if node.kind == "query":
            try:
                validate(p["intent"], catalog)
            except IntentError as e:
                out += [f"{name}: {x}" for x in e.problems]
        elif node.kind == "write":
            static = p.get("staticValues") or {}
            given = set(p.get("columns") or []) | set(p.get("columnAliases") or {})
            mode = p["mode"] if p.get("columns") or not graph.inputs(name) else "update"  # rows are known only when they come
            errors, _ = validate_write(catalog, p["table"], mode, given, static) if p["mode"] != "delete" or p["table"] not in catalog.tables else ([], [])
            out += [f"{name}: {x}" for x in errors]
            if p["mode"] in ("update", "delete") and not (p.get("whereColumns") or p.get("staticWhere") or p.get("wherePredicate")):
                out.append(f"{name}: {p['mode']} without WHERE is refused")
    return out


class RunHistory:
    """Runs of pipelines as an append-only table."""

    SCHEMA = "run string, pipeline string, status string, at timestamp, ms long, errors map<string,string>, trace string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, graph: Graph, result: Result) -> str:
        run = uuid.uuid4().hex
        first, last = result.trace[0]["at"], result.trace[-1]["at"]
        row = (run, graph.id, result.status, datetime.datetime.fromtimestamp(first), round((last - first) * 1000), result.errors, json.dumps(result.trace, default=str))
        self.spark.createDataFrame([row], self.SCHEMA).write.mode("append").parquet(self.path)
        return run

    def read(self, pipeline: str | None = None) -> DataFrame:
        df = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return df if pipeline is None else df.where(F.col("pipeline") == pipeline)
