"""Registered queries of inputs, writes against a catalog, DDL, grants and storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.json_tools import json_alias
from weftline.functions.registry import builtins
from weftline.operators import transform as tf
from weftline.plans import ddl
from weftline.plans.catalog import AccessDenied, AuditLog, Catalog, Grants, Sources
from weftline.plans.expressions import call, field, lit, op, without_unknown
from weftline.plans.graph import Graph, compile_intent
from weftline.plans.intent import IntentError, Query, validate
from weftline.plans.scheduler import Context, NodeRegistry, RunHistory, Scheduler, Value, default_nodes, preflight
from weftline.plans.session import SessionCursor, is_referential
from weftline.queries import REGIONS, SQL, Q, _load, add, catalog, cols, flt, query, step
from weftline.sources import readers, writes

__all__ = ["Q", "SQL"]

CRM = """
CREATE TABLE accounts (id SERIAL PRIMARY KEY, name VARCHAR(80) NOT NULL UNIQUE, workspace_id INTEGER NOT NULL);
CREATE TABLE IF NOT EXISTS tickets (
  id BIGSERIAL, account_id INT REFERENCES accounts(id) ON DELETE CASCADE, title TEXT NOT NULL,
  status TEXT NOT NULL DEFAULT 'open' CHECK (status IN ('open', 'closed')), done SMALLINT CHECK (done IN (0, 1)),
  percent INT CHECK (percent BETWEEN 0 AND 100), workspace_id INTEGER, created_by INT, created_at TIMESTAMPTZ, updated_at TIMESTAMP WITH TIME ZONE, price DECIMAL(10,2) DEFAULT 0
);
CREATE UNIQUE INDEX tickets_title ON tickets (title, account_id);
ALTER TABLE ONLY tickets ADD CONSTRAINT k FOREIGN KEY (workspace_id) REFERENCES workspaces (id) ON DELETE SET NULL;
CREATE TABLE change_log (id INT, note TEXT);
"""


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return f"{shared.rstrip('/')}/weftline-store-{uuid.uuid4().hex}"


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def values(data: list[tuple], names: str) -> str:
    """A VALUES query; texts are quoted."""
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in data)}) AS v({names})"


# --- inputs and sources -----------------------------------------------------------


def _from_input(spark, d, payload: dict, **more) -> DataFrame:
    graph = compile_intent({"description": "", "steps": [step("t", "transform", add("more", op("+", field("k"), lit(1))))]})
    graph.nodes["_input"].payload.update(payload)
    result = Scheduler().run(graph, Context(spark, _load(spark, d), **more))
    if result.status == "failed":
        raise RuntimeError(str(result.errors))
    return result.table()


@query("input_static", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(2 AS BIGINT)), (5, 'b', 6)) AS v(k, name, more)")
def input_static(spark, d):
    return _from_input(spark, d, {"source": {"kind": "static", "data": [(1, "a"), (5, "b")]}, "schema": "k long, name string"})


@query("input_param", "SELECT r_regionkey AS k, r_name, r_regionkey + 1 AS more FROM region")
def input_param(spark, d):
    table = _load(spark, d)("region").withColumnRenamed("r_regionkey", "k")
    return _from_input(spark, d, {"source": {"kind": "param", "paramKey": "regions"}}, params={"regions": table})


@query("mock_scan", "SELECT * FROM (VALUES (2, 'b'), (3, 'c')) AS v(id, name)")
def mock_scan(spark, d):
    load = readers.static({"things": rows(spark, [(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id int, name string, x double")})
    return Query(spark, lambda n: load(spark, n)).run({"table": "things", "columns": cols("id", "name"), "filters": [flt("x", ">", 1)]})


@query("raw_sql", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= 2")
def raw_sql(spark, d):
    name = readers.create_temp(_load(spark, d)("region"), f"region_{uuid.uuid4().hex}")
    return readers.sql(spark, f"SELECT r_regionkey, r_name FROM {name} WHERE r_regionkey >= :least", least=2)


@query("temp_table", "SELECT TRUE AS there, FALSE AS after_drop, TRUE AS refused")
def temp_table(spark, d):
    name = readers.create_temp(_load(spark, d)("region"), f"t_{uuid.uuid4().hex}")
    there = readers.exists(spark, name)
    readers.drop_temp(spark, name)
    try:
        readers.drop_temp(spark, "region")
        refused = False
    except ValueError:
        refused = True
    return rows(spark, [(there, readers.exists(spark, name), refused)], "there boolean, after_drop boolean, refused boolean")


@query("metadata_schema", values([("r_regionkey", "int"), ("r_name", "string")], "name, type"))
def metadata_schema(spark, d):
    return rows(spark, [(c["name"], c["type"]) for c in readers.schema_of(_load(spark, d)("region"))], "name string, type string")


@query("sources_registry", "SELECT 'tpch' AS source, count(*) AS n FROM region UNION ALL SELECT 'own', 2")
def sources_registry(spark, d):
    s = Sources()
    s.register("tpch", readers.parquet_folder(d))
    s.register("own", readers.static({"region": rows(spark, [(1,), (2,)], "k int")}))
    parts = [s.load(spark, "region", n).agg(F.count("*").alias("n")).select(F.lit(n).alias("source"), "n") for n in ("tpch", "own")]
    return parts[0].union(parts[1])


@query("json_alias", "SELECT r_regionkey AS key, r_name AS title FROM region")
def json_alias_query(spark, d):
    return json_alias(_load(spark, d)("region"), [{"name": "key", "jsonPath": "r_regionkey"}, {"name": "title", "apiFieldName": "r_name"}])


# --- expressions ------------------------------------------------------------------


@query("expr_concat", "SELECT r_regionkey, r_name || '-' || r_name AS twice FROM region")
def expr_concat(spark, d):
    tree = op("CONCAT", op("CONCAT", field("r_name"), lit("-")), field("r_name"))
    return tf.apply_operations(_load(spark, d)("region"), [{"kind": "addField", "name": "twice", "expr": tree}]).select("r_regionkey", "twice")


@query("expr_sanitise", "SELECT r_regionkey, COALESCE(NULL, r_name) AS shown FROM region")
def expr_sanitise(spark, d):
    t = _load(spark, d)("region")
    tree = without_unknown(call("COALESCE", field("no_such_field"), field("r_name")), t.columns)
    return tf.apply_operations(t, [{"kind": "addField", "name": "shown", "expr": tree}]).select("r_regionkey", "shown")


@query("udf_registry", "SELECT r_regionkey, r_regionkey * r_regionkey AS squared FROM region")
def udf_registry(spark, d):
    known = builtins()
    known.register_callable("SQUARED", lambda x: x * x, "int")
    return tf.apply_operations(_load(spark, d)("region"), [{"kind": "addField", "name": "squared", "expr": call("SQUARED", field("r_regionkey"))}], functions=known).select("r_regionkey", "squared")


@query("node_plugin", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey % 2 = 0")
def node_plugin(spark, d):
    nodes: NodeRegistry = default_nodes()
    nodes.register("evens", lambda node, inputs, ctx: Value("tabular", inputs[0].table(ctx.spark).where(F.col(node.payload["field"]) % 2 == 0)))
    graph = compile_intent({"description": "", "steps": [step("q", "query", REGIONS), step("e", "transform", {"field": "r_regionkey"}, dependsOn=["q"])]})
    graph.nodes["e"].kind = "evens"
    return Scheduler(nodes).run(graph, Context(spark, _load(spark, d))).table()


@query("plan_roundtrip", "SELECT r_regionkey, r_name, r_regionkey + 1 AS next FROM region")
def plan_roundtrip(spark, d):
    graph = compile_intent({"description": "", "steps": [step("q", "query", REGIONS), step("t", "transform", add("next", op("+", field("r_regionkey"), lit(1))), dependsOn=["q"])]})
    return Scheduler().run(Graph.from_json(graph.to_json()), Context(spark, _load(spark, d))).table()


@query("intent_validation", values([("Column 'nope' not found in table 'region'",), ("Unknown aggregate 'MEDIAN'",), ("limit must not be negative",)], "problem"))
def intent_validation(spark, d):
    try:
        validate({"table": "region", "columns": cols("nope"), "aggregations": [{"fn": "MEDIAN", "expr": "r_regionkey", "alias": "m"}], "limit": -1}, catalog(spark, d))
        found = []
    except IntentError as e:
        found = [(p,) for p in e.problems]
    return rows(spark, found, "problem string")


# --- DDL --------------------------------------------------------------------------

_COLUMNS = [
    ("accounts", "id", "SERIAL", False), ("accounts", "name", "TEXT", False), ("accounts", "workspace_id", "INT", False),
    ("tickets", "id", "SERIAL", False), ("tickets", "account_id", "INT", True), ("tickets", "title", "TEXT", False), ("tickets", "status", "TEXT", False), ("tickets", "done", "INT", True),
    ("tickets", "percent", "INT", True), ("tickets", "workspace_id", "INT", True), ("tickets", "created_by", "INT", True), ("tickets", "created_at", "TIMESTAMPTZ", True),
    ("tickets", "updated_at", "TIMESTAMPTZ", True), ("tickets", "price", "NUMERIC(10,2)", True), ("change_log", "id", "INT", True), ("change_log", "note", "TEXT", True),
]


@query("ddl_parse", values(_COLUMNS, "tab, col, type, nullable"))
def ddl_parse(spark, d):
    t = ddl.parse(CRM).catalog.tables
    return rows(spark, [(n, c.name, c.type, c.nullable) for n, i in t.items() for c in i.columns.values()], "tab string, col string, type string, nullable boolean")


@query("ddl_keys", values([("tickets", "account_id", "accounts", "id", "CASCADE"), ("tickets", "workspace_id", "workspaces", "id", "SET NULL"), ("tickets", "title,account_id", "tickets_title", "index", "unique")], "tab, col, ref, ref_col, rule"))
def ddl_keys(spark, d):
    s = ddl.parse(CRM)
    keys = [(k.table, k.column, k.ref_table, k.ref_column, k.on_delete) for k in s.catalog.foreign_keys]
    return rows(spark, keys + [(i.table, ",".join(i.columns), i.name, "index", "unique" if i.unique else "") for i in s.indexes], "tab string, col string, ref string, ref_col string, rule string")


@query("ddl_check", values([("status", "enum", "open,closed"), ("done", "boolean", ""), ("percent", "range", "0..100")], "col, kind, allowed"))
def ddl_check(spark, d):
    found = []
    for c in ddl.parse(CRM).catalog.tables["tickets"].columns.values():
        if c.check:
            found.append((c.name, c.check["kind"], ",".join(c.enum) if c.enum else f"{c.check['min']}..{c.check['max']}" if c.check["kind"] == "range" else ""))
    return rows(spark, found, "col string, kind string, allowed string")


_TRAITS = [
    ("id", "server_generated", True), ("account_id", "user_supplied", False), ("title", "user_supplied", False), ("status", "user_supplied", False), ("done", "user_supplied", False), ("percent", "user_supplied", False),
    ("workspace_id", "session_scoped", False), ("created_by", "session_scoped", False), ("created_at", "server_generated", True), ("updated_at", "system_audited", False), ("price", "user_supplied", False),
]


@query("ddl_traits", values(_TRAITS, "col, trait, immutable"))
def ddl_traits(spark, d):
    return rows(spark, [(c, t["trait"], t["immutable"]) for c, t in ddl.traits(ddl.parse(CRM).catalog.tables["tickets"]).items()], "col string, trait string, immutable boolean")


@query("ddl_classify", values([("excluded", "created_at,created_by,id,updated_at,workspace_id"), ("immutable", "created_at,id"), ("required", "title"), ("session", "created_by=42,workspace_id=7"), ("user", "account_id,done,percent,price,status,title")], "part, cols"))
def ddl_classify(spark, d):
    found = ddl.classify(ddl.parse(CRM).catalog.tables["tickets"], {"workspace_id": 7, "user_id": 42})
    return rows(spark, [(k, ",".join(sorted(v if isinstance(v, list) else [f"{c}={x}" for c, x in v.items()]))) for k, v in found.items()], "part string, cols string")


@query("ddl_types", values([("accounts", "id int NOT NULL, name string NOT NULL, workspace_id int NOT NULL"), ("change_log", "id int, note string")], "tab, types"))
def ddl_types(spark, d):
    again = ddl.from_json(ddl.to_json(ddl.parse(CRM)))
    return rows(spark, [(n, t) for n, t in ddl.to_types(again).items() if n != "tickets"], "tab string, types string")


@query("ddl_state", values([("first", False, ""), ("same", False, ""), ("other", True, "crm")], "step, changed, invalidated"))
def ddl_state(spark, d):
    calls: list[str] = []
    state = ddl.SchemaState(calls.append)
    found = []
    for name, text in (("first", CRM), ("same", CRM), ("other", CRM + "CREATE TABLE more (id INT);")):
        changed = state.update("crm", text)
        found.append((name, changed, ",".join(calls)))
    return rows(spark, found, "step string, changed boolean, invalidated string")


@query("type_aliases", values([("VARCHAR(80)", "TEXT"), ("BIGSERIAL", "SERIAL"), ("DECIMAL(10,2)", "NUMERIC(10,2)"), ("TIMESTAMP WITH TIME ZONE", "TIMESTAMPTZ"), ("DOUBLE PRECISION", "DOUBLE"), ("INT8[]", "BIGINT[]")], "written, known"))
def type_aliases(spark, d):
    kinds = ["VARCHAR(80)", "BIGSERIAL", "DECIMAL(10,2)", "TIMESTAMP WITH TIME ZONE", "DOUBLE PRECISION", "INT8[]"]
    return rows(spark, [(k, ddl.parse(f"CREATE TABLE t (c {k});").catalog.tables["t"].columns["c"].type) for k in kinds], "written string, known string")


@query("fk_graph", values([("customer", "region", "c_nationkey>n_regionkey"), ("orders", "region", "o_custkey>c_nationkey>n_regionkey"), ("part", "orders", "l_partkey>l_orderkey")], "start, goal, way"))
def fk_graph(spark, d):
    c = catalog(spark, d)
    return rows(spark, [(a, b, ">".join(k.column for k in c.path(a, b))) for a, b in (("customer", "region"), ("orders", "region"), ("part", "orders"))], "start string, goal string, way string")


@query("related_tables", values([("related", "nation,orders"), ("reach 2", "lineitem,nation,orders,region,supplier"), ("writes", "c_nationkey=nation.n_nationkey")], "what, tables"))
def related_tables(spark, d):
    c = catalog(spark, d)
    return rows(spark, [("related", ",".join(sorted(c.related("customer")))), ("reach 2", ",".join(sorted(c.reachable("customer", 2)))), ("writes", ",".join(f"{k}={t}.{n}" for k, (t, n) in c.write_columns("customer").items()))], "what string, tables string")


@query("multi_source", values([("accounts", "default"), ("crm.accounts", "crm"), ("tickets", "crm"), ("change_log", "crm")], "tab, source"))
def multi_source(spark, d):
    one = Catalog.of_frames({"accounts": rows(spark, [(1,)], "id int")})
    both = one.merge(ddl.parse(CRM).catalog, "crm", namespace=True)
    return rows(spark, [(n, t.source) for n, t in both.tables.items()], "tab string, source string")


# --- grants, audit, history ------------------------------------------------------------


@query("grants", "SELECT c_custkey, c_mktsegment FROM customer")
def grants(spark, d):
    g = Grants({"customer"}, {"customer": {"c_custkey", "c_mktsegment"}})
    return Query(spark, _load(spark, d), catalog(spark, d), grants=g).run({"table": "customer", "columns": [{"field": "*"}]})


_GATES = [("bridge", True), ("column", True), ("granted", False), ("payload column", True), ("subquery", True), ("table", True), ("text", True), ("write", True)]


@query("permission_gates", values(_GATES, "gate, denied"))
def permission_gates(spark, d):
    load, full = _load(spark, d), catalog(spark, d)
    g = Grants({"customer", "region"}, {"customer": {"c_custkey"}}, {"customer"})
    q = lambda spec: lambda: Query(spark, load, full, grants=g).run(spec)
    tries = {
        "granted": q({"table": "customer", "columns": cols("c_custkey")}),
        "table": q({"table": "orders", "columns": cols("o_orderkey")}),
        "column": q({"table": "customer", "columns": cols("c_name")}),
        "bridge": q({"table": "customer", "columns": cols("c_custkey"), "joins": [{"table": "region"}]}),
        "subquery": q({"table": "customer", "columns": cols("c_custkey"), "filters": [flt("c_custkey", "IN", "(SELECT o_custkey FROM orders)")]}),
        "text": lambda: g.check_text(full, "show me all orders"),
        "write": lambda: g.check_payload({"table": "region", "mode": "insert"}),
        "payload column": lambda: g.check_payload({"table": "customer", "mode": "update", "staticValues": {"c_name": "x"}}),
    }
    found = []
    for name, run in tries.items():
        try:
            run()
            found.append((name, False))
        except (AccessDenied, IntentError):
            found.append((name, True))
    return rows(spark, found, "gate string, denied boolean")


@query("audit_log", values([("ann", "read", "orders", True), ("ann", "write", "orders", False)], "who, action, resource, allowed"))
def audit_log(spark, d):
    log = AuditLog(spark, scratch(spark))
    for who, action, allowed in (("ann", "read", True), ("bob", "read", True), ("ann", "write", False)):
        log.append(who, action, "orders", allowed)
    return log.read(user="ann").select(F.col("user").alias("who"), "action", "resource", "allowed")


@query("run_history", values([("pipeline", "failed", 1), ("pipeline", "success", 0)], "pipeline, status, errors"))
def run_history(spark, d):
    history = RunHistory(spark, scratch(spark))
    for payload in (REGIONS, {"intent": {"table": "region", "columns": cols("nope")}}):
        graph = compile_intent({"description": "", "steps": [step("q", "query", payload)]})
        history.append(graph, Scheduler().run(graph, Context(spark, _load(spark, d))))
    return history.read("pipeline").select("pipeline", "status", F.size("errors").alias("errors"))


@query("preflight", values([("q: Column 'nope' not found in table 'tickets'",), ("w: Column 'colour' not found in table 'tickets'",), ("w: update without WHERE is refused",)], "problem"))
def preflight_query(spark, d):
    steps = [step("q", "query", {"intent": {"table": "tickets", "columns": cols("nope")}}), step("w", "write", {"table": "tickets", "mode": "update", "staticValues": {"colour": "red"}}, dependsOn=["q"])]
    return rows(spark, [(p,) for p in preflight(compile_intent({"description": "", "steps": steps}), ddl.parse(CRM).catalog)], "problem string")


@query("referential", values([("close those", True), ("update the records", True), ("list all accounts", False)], "text, refers"))
def referential(spark, d):
    return rows(spark, [(t, is_referential(t)) for t in ("close those", "update the records", "list all accounts")], "text string, refers boolean")


# --- writes through the store -----------------------------------------------------------

SESSION = {"workspace_id": 7, "user_id": 42}
_TICKETS = "id int, account_id int, title string, status string, done int, percent int, workspace_id int, created_by int, created_at timestamp, updated_at timestamp, price decimal(10,2)"
_OLD = [(1, 5, "one", "open", 0, 10, 1, 9, None, None, None), (2, 6, "two", "open", 0, 20, 1, 9, None, None, None), (3, 6, "three", "closed", 1, 30, 1, 9, None, None, None)]


def store(spark, cursor=None) -> writes.Store:
    s = writes.Store(spark, scratch(spark), ddl.parse(CRM).catalog, SESSION, cursor)
    s.replace("tickets", rows(spark, _OLD, _TICKETS))
    s.replace("change_log", rows(spark, [(1, "a")], "id int, note string"))
    return s


@query("write_inject", values([(10, "new", 7, 42, True, True)], "id, title, workspace_id, created_by, created, updated"))
def write_inject(spark, d):
    s = store(spark)
    s.apply({"table": "tickets", "mode": "insert", "staticValues": {"created_by": 1}}, rows(spark, [(10, "new", "open")], "id int, title string, status string"))
    seen = F.col("created_at").isNotNull().alias("created"), F.col("updated_at").isNotNull().alias("updated")
    return s.load(spark, "tickets").where("id = 10").select("id", "title", "workspace_id", "created_by", *seen)


@query("write_enum_fix", values([(1, "closed"), (2, "open"), (3, "closed")], "id, status"))
def write_enum_fix(spark, d):
    s = store(spark)
    s.apply({"table": "tickets", "mode": "update", "staticValues": {"status": "CLOSED"}, "staticWhere": {"id": 1}}, None)
    s.apply({"table": "tickets", "mode": "update", "staticValues": {"status": "wrong"}, "staticWhere": {"id": 2}, "repair": True}, None)
    return s.load(spark, "tickets").select("id", "status")


@query("write_validate", values([("Column 'status': 'odd' is not one of open, closed",), ("Column 'colour' not found in table 'tickets'",), ("Required column 'title' is missing",)], "problem"))
def write_validate(spark, d):
    errors, _ = writes.validate_write(ddl.parse(CRM).catalog, "tickets", "insert", {"colour"}, {"status": "odd"})
    return rows(spark, [(e,) for e in errors], "problem string")


@query("write_templates", values([(1, "one!", True), (2, "two!", True), (3, "three", False)], "id, title, updated"))
def write_templates(spark, d):
    s = store(spark)
    s.apply({"table": "tickets", "mode": "update", "whereColumns": ["id"], "columns": ["id"], "staticValues": {"title": "{{ shown }}", "price": 5}}, rows(spark, [(1, "one!"), (2, "two!")], "id int, shown string"))
    return s.load(spark, "tickets").select("id", "title", F.col("updated_at").isNotNull().alias("updated"))


@query("write_immutable", values([(1, "changed", False), (2, "two", False), (3, "three", False)], "id, title, created"))
def write_immutable(spark, d):
    s = store(spark)
    s.apply({"table": "tickets", "mode": "update", "staticValues": {"title": "changed", "created_at": "NOW()"}, "staticWhere": {"id": 1}}, None)
    return s.load(spark, "tickets").select("id", "title", F.col("created_at").isNotNull().alias("created"))


@query("write_log_table", values([(1, "a"), (2, "b")], "id, note"))
def write_log_table(spark, d):
    s = store(spark)
    s.apply({"table": "change_log", "mode": "insert", "ignoreLogRepeats": True, "conflictColumns": ["id"]}, rows(spark, [(1, "again"), (2, "b")], "id int, note string"))
    return s.load(spark, "change_log")


@query("write_fk_alias", values([(20, 6)], "id, account_id"))
def write_fk_alias(spark, d):
    s = store(spark)
    s.apply({"table": "tickets", "mode": "insert", "staticValues": {"status": "open", "id": 20, "title": "x"}}, rows(spark, [(6, "ignored")], "accounts_id int, other string"))
    return s.load(spark, "tickets").where("id = 20").select("id", "account_id")


@query("write_fk_lookup", "SELECT CAST(id AS INTEGER) AS id, n_nationkey AS nation FROM (VALUES (1, 'NATION_3'), (2, ' nation_7 '), (3, '12'), (4, 'nowhere')) AS v(id, name) LEFT JOIN nation ON lower(trim(name)) = lower(n_name) OR name = CAST(n_nationkey AS VARCHAR)")
def write_fk_lookup(spark, d):
    names = [r[0] for r in _load(spark, d)("nation").where("n_nationkey IN (3, 7)").orderBy("n_nationkey").select("n_name").collect()]
    given = rows(spark, [(1, names[0]), (2, f" {names[1].lower()} "), (3, "12"), (4, "nowhere")], "id int, nation string")
    return writes.resolve_keys(given, "nation", _load(spark, d)("nation"), "n_nationkey", "n_name")


def _cursor(s: writes.Store, spark) -> None:
    s.cursor = SessionCursor()
    s.cursor.remember("tickets", s.load(spark, "tickets").where("account_id = 6"))


@query("write_cursor_update", values([(1, "open"), (2, "closed"), (3, "closed")], "id, status"))
def write_cursor_update(spark, d):
    s = store(spark)
    _cursor(s, spark)
    s.apply({"table": "tickets", "mode": "update", "whereColumns": ["id"], "staticValues": {"status": "closed"}}, None)
    return s.load(spark, "tickets").select("id", "status")


@query("write_cursor_delete", values([(1, "one")], "id, title"))
def write_cursor_delete(spark, d):
    s = store(spark)
    _cursor(s, spark)
    s.apply({"table": "tickets", "mode": "delete", "whereColumns": ["id"]}, None)
    return s.load(spark, "tickets").select("id", "title")


@query("write_result", values([("tickets", "update", 2, '{"kind": "eq", "column": "account_id", "value": 6}')], "tab, operation, rows_affected, matched"))
def write_result(spark, d):
    out = store(spark).apply({"table": "tickets", "mode": "update", "staticValues": {"title": "t"}, "staticWhere": {"account_id": 6}}, None)
    return out.select(F.col("table").alias("tab"), "operation", F.col("rows_affected").cast("int").alias("rows_affected"), F.col("where").alias("matched"))


@query("write_resolution", values([("Column 'missing' can''t be resolved and is left out".replace("''", "'"),)], "warning"))
def write_resolution(spark, d):
    s = store(spark)
    s.apply({"table": "tickets", "mode": "insert", "columns": ["id", "title", "status", "missing"]}, rows(spark, [(30, "x", "open")], "id int, title string, status string"))
    return rows(spark, [(w,) for w in s.warnings if "resolved" in w], "warning string")


@query("write_transaction", values([(2, True, 3)], "version, conflict, kept"))
def write_transaction(spark, d):
    s = store(spark)
    base, table = s.version("tickets"), s.load(spark, "tickets")
    s.replace("tickets", table.where("id < 3"), base)
    try:
        s.replace("tickets", table.where("id > 3"), base)
        conflict = False
    except writes.WriteConflict:
        conflict = True
    return rows(spark, [(s.version("tickets"), conflict, table.count())], "version int, conflict boolean, kept int")


_COERCED = [("5", "INT", "5"), ("x", "INT", "error"), ("Yes", "BOOLEAN", "True"), ("0", "BOOLEAN", "False"), ("maybe", "BOOLEAN", "error"), ("2024-02-30", "DATE", "error"), ("2024-02-28", "DATE", "2024-02-28"), (" OPEN ", "enum", "open"), ("gone", "enum", "error"), ("1.5", "NUMERIC(10,2)", "1.5"), (" text ", "TEXT", "text")]


@query("coerce_value", values(_COERCED, "given, kind, got"))
def coerce_value(spark, d):
    found = []
    for given, kind, _ in _COERCED:
        try:
            got = str(writes.coerce_value(given, "TEXT" if kind == "enum" else kind, ["open", "closed"] if kind == "enum" else None))
        except writes.WriteError:
            got = "error"
        found.append((given, kind, got))
    return rows(spark, found, "given string, kind string, got string")
