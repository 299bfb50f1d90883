"""Registered queries of the engine's own operators, with their SQL.

Each query is an intent, a transform list or a pipeline over the tables; each
SQL text says the same for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.json_tools import json_array_root, json_flatten
from weftline.operators import transform as tf
from weftline.operators.vector import topk
from weftline.plans.catalog import Catalog, ForeignKey
from weftline.plans.expressions import call, field, lit, op, when
from weftline.plans.graph import compile_intent
from weftline.plans.intent import Query
from weftline.plans.options import DEFAULT, Options
from weftline.plans.scheduler import Context, Scheduler
from weftline.sources import writes
from weftline.sources.readers import parquet_folder

KEYS = [
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey"), ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"), ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"), ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"), ForeignKey("labels", "doc_id", "documents", "doc_id"),
]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _load(spark: SparkSession, d: str):
    loader = parquet_folder(d)
    return lambda name: loader(spark, name)


def catalog(spark: SparkSession, d: str) -> Catalog:
    load = _load(spark, d)
    return Catalog.of_frames({t: load(t) for t in TABLES}, KEYS)


def intent(name: str, sql: str, spec: dict, options: Options = DEFAULT) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        load = _load(spark, d)
        names = {spec["table"], *[j["table"] for j in spec.get("joins", [])]}
        cat = catalog(spark, d) if any("on" not in j for j in spec.get("joins", [])) else Catalog.of_frames({t: load(t) for t in names | ({"orders", "customer"} if "_all" in spec else set())}, KEYS)
        for t in spec.get("_views", []):
            load(t).createOrReplaceTempView(t)
        return Query(spark, load, cat, options=options).run({k: v for k, v in spec.items() if k[0] != "_"})

    Q[name], SQL[name] = run, sql


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def cols(*names: str) -> list[dict]:
    return [{"field": n} for n in names]


def flt(f: str, o: str, v=None, **more) -> dict:
    return {"field": f, "operator": o, "value": v, **more}


money = lambda expr: f"CAST(SUM(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE)"

# --- scans, projections, predicates ------------------------------------------

LI = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
intent("scan_table", "SELECT * FROM nation", {"table": "nation", "columns": [{"field": "*"}]})
intent("scan_predicate", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01'", {"table": "lineitem", "columns": cols(*LI), "filters": [{"field": "l_shipdate", "operator": "<", "expr": "TIMESTAMP '1996-06-01'"}]})
intent("scan_columns", "SELECT c_custkey, c_mktsegment FROM customer", {"table": "customer", "columns": cols("c_custkey", "c_mktsegment")})
intent("project", "SELECT p_partkey AS id, p_name AS name, p_retailprice * 2 AS twice FROM part", {"table": "part", "columns": [{"field": "p_partkey", "alias": "id"}, {"field": "p_name", "alias": "name"}, {"field": "twice", "expr": "p_retailprice * 2", "alias": "twice"}]})
intent("project_star", "SELECT * FROM region", {"table": "region", "columns": [{"field": "*"}]})
intent("filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'", {"table": "customer", "columns": cols("c_custkey", "c_acctbal"), "filters": [flt("c_acctbal", ">", 5000), flt("c_mktsegment", "=", "BUILDING")]})
for sym, word in (("=", "eq"), ("!=", "ne"), ("<", "lt"), (">", "gt"), ("<=", "le"), (">=", "ge")):
    intent(f"pred_cmp_{word}", f"SELECT p_partkey, p_size FROM part WHERE p_size {sym.replace('!=', '<>')} 25", {"table": "part", "columns": cols("p_partkey", "p_size"), "filters": [flt("p_size", sym, 25)]})
intent("pred_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%O%'", {"table": "part", "columns": cols("p_partkey", "p_type"), "filters": [flt("p_type", "LIKE", "%O%")]})
intent("pred_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", {"table": "orders", "columns": cols("o_orderkey"), "filters": [flt("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"])]})
intent("pred_not_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", {"table": "orders", "columns": cols("o_orderkey"), "filters": [flt("o_orderpriority", "NOT IN", ["1-URGENT", "2-HIGH"])]})
intent("pred_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", {"table": "part", "columns": cols("p_partkey"), "filters": [flt("p_size", "BETWEEN", [10, 20])]})
NULLS = "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name FROM customer"
for word, how in (("is", "IS NULL"), ("not", "IS NOT NULL")):
    Q[f"pred_{word}_null"] = lambda spark, d, how=how: Query(spark, lambda n: _load(spark, d)(n).selectExpr("c_custkey", "CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name")).run({"table": "customer", "columns": cols("c_custkey"), "filters": [flt("c_name", how)]})
    SQL[f"pred_{word}_null"] = f"SELECT c_custkey FROM ({NULLS}) WHERE c_name {how}"
intent("pred_ci", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", {"table": "customer", "columns": cols("c_custkey"), "filters": [flt("c_mktsegment", "=", "Building", caseInsensitive=True)]})
intent("pred_ci_like", "SELECT p_partkey FROM part WHERE p_type ILIKE '%o%'", {"table": "part", "columns": cols("p_partkey"), "filters": [flt("p_type", "LIKE", "%o%", caseInsensitive=True)]})
intent("pred_expr", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' + INTERVAL 90 DAY", {"table": "orders", "columns": cols("o_orderkey"), "filters": [{"field": "o_orderdate", "operator": ">=", "expr": "TIMESTAMP '1995-01-01' + INTERVAL 90 DAYS"}]})
intent("pred_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", {"table": "customer", "columns": cols("c_custkey"), "filters": [flt("c_custkey", "IN", "(SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")], "_views": ["orders"]})
intent("pred_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", {"table": "customer", "columns": cols("c_custkey"), "filters": [flt("c_custkey", "NOT IN", "(SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")], "_views": ["orders"]})
intent("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')", {"table": "customer", "columns": cols("c_custkey"), "filters": [flt("o_custkey", "NOT IN", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", table="orders")], "_views": ["orders"], "_all": True})
intent("filter_or_groups", "SELECT n_nationkey FROM nation WHERE (n_nationkey = 3 OR n_regionkey = 3) AND n_nationkey < 20", {"table": "nation", "columns": cols("n_nationkey"), "filters": [flt("n_nationkey", "=", 3), flt("n_regionkey", "=", 3), flt("n_nationkey", "<", 20)]}, Options(filter_grouping="or_same_value"))


@query("pred_logic", "SELECT p_partkey FROM part WHERE (p_size > 10 AND NOT (p_type LIKE '%S%')) OR p_size = 1")
def pred_logic(spark, d):
    tree = op("OR", op("AND", op(">", field("p_size"), lit(10)), {"kind": "UnaryOp", "op": "NOT", "operand": op("LIKE", field("p_type"), lit("%S%"))}), op("=", field("p_size"), lit(1)))
    return tf.apply_operations(_load(spark, d)("part"), [{"kind": "filterRows", "predicate": tree}]).select("p_partkey")


@query("pred_value_ref", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def pred_value_ref(spark, d):
    load = _load(spark, d)
    found = load("customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return Query(spark, load, refs={"buyers": found}).run({"table": "orders", "columns": cols("o_orderkey"), "filters": [{"field": "o_custkey", "operator": "IN", "valueRef": "buyers.c_custkey"}]})


@query("pred_value_ref_not_in", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def pred_value_ref_not_in(spark, d):
    load = _load(spark, d)
    found = load("customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return Query(spark, load, refs={"buyers": found}).run({"table": "orders", "columns": cols("o_orderkey"), "filters": [{"field": "o_custkey", "operator": "NOT IN", "valueRef": "buyers.c_custkey"}]})


# --- joins ---------------------------------------------------------------------

on = lambda a, b: {"left": a, "right": b}
CO = [{"field": "c_custkey", "table": "customer"}, {"field": "o_orderkey", "table": "orders"}, {"field": "o_totalprice", "table": "orders"}]
intent("join_inner", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey", {"table": "customer", "columns": CO, "joins": [{"table": "orders", "kind": "INNER", "on": on("customer.c_custkey", "orders.o_custkey")}]})
intent("join_left", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", {"table": "customer", "columns": CO, "joins": [{"table": "orders", "kind": "LEFT", "on": on("customer.c_custkey", "orders.o_custkey")}], "filters": [flt("o_totalprice", ">", 400000, table="orders")]})
intent("join_right", "SELECT c_custkey, n_nationkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey", {"table": "customer", "columns": [{"field": "c_custkey"}, {"field": "n_nationkey", "table": "nation"}], "joins": [{"table": "nation", "kind": "RIGHT", "on": on("customer.c_nationkey", "nation.n_nationkey")}]})
intent("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey", {"table": "supplier", "columns": [{"field": "s_suppkey"}, {"field": "c_custkey", "table": "customer"}], "joins": [{"table": "customer", "kind": "FULL", "on": on("supplier.s_suppkey", "customer.c_custkey")}]})
intent("join_theta", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", {"table": "nation", "alias": "a", "columns": [{"field": "n_nationkey", "table": "a", "alias": "low"}, {"field": "n_nationkey", "table": "b", "alias": "high"}], "joins": [{"table": "nation", "alias": "b", "on": {"expr": op("AND", op("=", field("n_regionkey", "a"), field("n_regionkey", "b")), op("<", field("n_nationkey", "a"), field("n_nationkey", "b")))}}]})
intent("join_multi", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE 'A%' OR n_name LIKE '%1'", {"table": "orders", "columns": [{"field": "o_orderkey"}, {"field": "c_name", "table": "customer"}, {"field": "n_name", "table": "nation"}], "joins": [{"table": "customer", "on": on("orders.o_custkey", "customer.c_custkey")}, {"table": "nation", "on": on("customer.c_nationkey", "nation.n_nationkey")}], "filters": [{"field": "n_name", "operator": "=", "expr": "CASE WHEN n_name LIKE 'A%' OR n_name LIKE '%1' THEN n_name END", "table": "nation"}]})
intent("join_self_alias", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", {"table": "nation", "alias": "a", "columns": [{"field": "n_name", "table": "a", "alias": "one"}, {"field": "n_name", "table": "b", "alias": "other"}], "joins": [{"table": "nation", "alias": "b", "on": on("a.n_regionkey", "b.n_regionkey")}]})
intent("join_fk", "SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", {"table": "customer", "columns": [{"field": "c_custkey"}, {"field": "r_name", "table": "region"}], "joins": [{"table": "region"}]})


@query("join_semi_ref", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)")
def join_semi_ref(spark, d):
    load = _load(spark, d)
    lookup = Query(spark, load).run({"table": "supplier", "columns": cols("s_suppkey"), "filters": [flt("s_acctbal", ">", 9000)]})
    return Query(spark, load, refs={"lookup": lookup}).run({"table": "lineitem", "columns": cols("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), "filters": [{"field": "l_suppkey", "operator": "IN", "valueRef": "lookup.s_suppkey"}]})


# --- aggregates ------------------------------------------------------------------

intent("agg_group", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {money('l_quantity')} AS qty FROM lineitem GROUP BY 1, 2", {"table": "lineitem", "columns": cols("l_returnflag", "l_linestatus"), "groupBy": ["l_returnflag", "l_linestatus"], "aggregations": [{"fn": "COUNT", "expr": "*", "alias": "n"}, {"fn": "SUM", "expr": "SUM(CAST(l_quantity AS DECIMAL(18,4))) * 1D", "alias": "qty"}]})
intent("agg_global", "SELECT COUNT(*) AS n, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders", {"table": "orders", "columns": [], "aggregations": [{"fn": "COUNT", "expr": "*", "alias": "n"}, {"fn": "MIN", "expr": "o_totalprice", "alias": "low"}, {"fn": "MAX", "expr": "o_totalprice", "alias": "high"}]})
intent("agg_count_star", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1", {"table": "orders", "columns": [{"field": "o_orderstatus"}, {"field": "*", "agg": "COUNT", "alias": "n"}], "groupBy": ["o_orderstatus"]})
intent("agg_count", "SELECT c_nationkey, COUNT(c_name) AS n FROM customer GROUP BY 1", {"table": "customer", "columns": [{"field": "c_nationkey"}, {"field": "c_name", "agg": "COUNT", "alias": "n"}], "groupBy": ["c_nationkey"]})
intent("agg_count_distinct", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY 1", {"table": "orders", "columns": [{"field": "o_orderpriority"}, {"field": "o_custkey", "agg": "COUNT_DISTINCT", "alias": "n"}], "groupBy": ["o_orderpriority"]})
intent("agg_sum", "SELECT l_suppkey, CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1", {"table": "lineitem", "columns": [{"field": "l_suppkey"}, {"field": "l_linenumber", "agg": "SUM", "alias": "total"}], "groupBy": ["l_suppkey"]})
intent("agg_avg", "SELECT p_brand, AVG(p_size) AS mean FROM part GROUP BY 1", {"table": "part", "columns": [{"field": "p_brand"}, {"field": "p_size", "agg": "AVG", "alias": "mean"}], "groupBy": ["p_brand"]})
intent("agg_min", "SELECT c_mktsegment, MIN(c_acctbal) AS low, MIN(c_name) AS first FROM customer GROUP BY 1", {"table": "customer", "columns": [{"field": "c_mktsegment"}, {"field": "c_acctbal", "agg": "MIN", "alias": "low"}, {"field": "c_name", "agg": "MIN", "alias": "first"}], "groupBy": ["c_mktsegment"]})
intent("agg_max", "SELECT c_mktsegment, MAX(c_acctbal) AS high FROM customer GROUP BY 1", {"table": "customer", "columns": [{"field": "c_mktsegment"}, {"field": "c_acctbal", "agg": "MAX", "alias": "high"}], "groupBy": ["c_mktsegment"]})
intent("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 15", {"table": "orders", "columns": cols("o_custkey"), "groupBy": ["o_custkey"], "aggregations": [{"fn": "COUNT", "expr": "*", "alias": "n"}], "having": [flt("n", ">", 15)]})
intent("agg_fn_expr", "SELECT o_custkey, COALESCE(COUNT(o_orderstatus), 0) * 2 AS twice, MAX(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS top FROM orders GROUP BY 1", {"table": "orders", "columns": cols("o_custkey"), "groupBy": ["o_custkey"], "aggregations": [{"fn": "COUNT", "expr": "COALESCE(COUNT(o_orderstatus), 0) * 2", "alias": "twice"}, {"fn": "MAX", "expr": "CASE WHEN o_orderstatus = 'F' THEN o_orderkey END", "alias": "top"}]})
intent("group_rule", "SELECT c_nationkey, n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2", {"table": "customer", "columns": [{"field": "c_nationkey"}, {"field": "n_name", "table": "nation"}], "joins": [{"table": "nation"}], "groupBy": ["c_nationkey"], "aggregations": [{"fn": "COUNT", "expr": "*", "alias": "n"}]})
intent("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", {"table": "orders", "columns": cols("o_orderstatus", "o_orderpriority"), "distinct": True})
FLAGSHIP = {
    "table": "lineitem", "columns": [{"field": "n_name", "table": "nation"}],
    "joins": [{"table": "orders", "on": on("lineitem.l_orderkey", "orders.o_orderkey")}, {"table": "customer", "on": on("orders.o_custkey", "customer.c_custkey")}, {"table": "nation", "on": on("customer.c_nationkey", "nation.n_nationkey")}],
    "filters": [{"field": "l_shipdate", "operator": ">=", "expr": "TIMESTAMP '1995-01-01'"}], "groupBy": ["n_name"],
    "aggregations": [{"fn": "SUM", "expr": "SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) * 1D", "alias": "revenue"}, {"fn": "COUNT", "expr": "*", "alias": "n"}],
    "orderBy": [{"field": "revenue", "direction": "DESC"}, {"field": "n_name"}], "limit": 5,
}
intent("revenue_by_nation", f"SELECT n_name, {money('l_extendedprice * (1 - l_discount)')} AS revenue, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1 ORDER BY revenue DESC, n_name LIMIT 5", FLAGSHIP)

# --- windows -----------------------------------------------------------------------

part = {"partition": ["o_custkey"], "orderBy": [{"field": "o_orderdate"}, {"field": "o_orderkey"}]}
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
intent("win_row_number", f"SELECT o_orderkey, row_number() {OVER} AS rn FROM orders", {"table": "orders", "columns": [{"field": "o_orderkey"}, {"field": "*", "agg": "ROW_NUMBER", "alias": "rn", **part}]})
intent("win_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders", {"table": "orders", "columns": [{"field": "o_orderkey"}, {"field": "*", "agg": "RANK", "alias": "r", "partition": ["o_custkey"], "orderBy": [{"field": "o_orderpriority"}]}]})
intent("win_lag", f"SELECT o_orderkey, lag(o_totalprice) {OVER} AS before FROM orders", {"table": "orders", "columns": [{"field": "o_orderkey"}, {"field": "o_totalprice", "agg": "LAG", "alias": "before", **part}]})
intent("win_lead", f"SELECT o_orderkey, lead(o_totalprice) {OVER} AS after FROM orders", {"table": "orders", "columns": [{"field": "o_orderkey"}, {"field": "o_totalprice", "agg": "LEAD", "alias": "after", **part}]})


@query("win_agg", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS top, COUNT(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS kinds FROM orders")
def win_agg(spark, d):
    w = lambda fn, over: {"kind": "WindowExpr", "fn": fn, "over": over, "partition": [field("o_custkey")]}
    ops = [{"kind": "addField", "name": n, "expr": e} for n, e in (("n", w("COUNT", lit(1))), ("top", w("MAX", field("o_totalprice"))), ("kinds", w("COUNT_DISTINCT", field("o_orderstatus"))))]
    return tf.apply_operations(_load(spark, d)("orders"), ops).select("o_orderkey", "n", "top", "kinds")


# --- order and limits ------------------------------------------------------------------

intent("sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey", {"table": "customer", "columns": cols("c_custkey", "c_acctbal"), "orderBy": [{"field": "c_acctbal", "direction": "DESC", "nulls": "LAST"}, {"field": "c_custkey"}]})
RANKED = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END"
intent("sort_expr", f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {RANKED}, o_orderkey LIMIT 100", {"table": "orders", "columns": cols("o_orderkey", "o_orderpriority"), "orderBy": [{"field": "o_orderpriority", "expr": RANKED}, {"field": "o_orderkey"}], "limit": 100})
intent("limit_offset", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5", {"table": "part", "columns": cols("p_partkey"), "orderBy": [{"field": "p_partkey"}], "limit": 10, "offset": 5})
intent("limit_zero", "SELECT p_partkey FROM part LIMIT 0", {"table": "part", "columns": cols("p_partkey"), "limit": 0})
intent("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", {"table": "orders", "columns": cols("o_orderkey", "o_totalprice"), "orderBy": [{"field": "o_totalprice", "direction": "DESC"}, {"field": "o_orderkey"}], "limit": 20})

# --- functions and expressions ------------------------------------------------------------


def fn(name: str, table: str, key: str, tree: dict, sql: str, options: Options = DEFAULT) -> None:
    def run(spark, d):
        return tf.apply_operations(_load(spark, d)(table), [{"kind": "addField", "name": "v", "expr": tree}], options=options).select(key, "v")

    Q[name], SQL[name] = run, f"SELECT {key}, {sql} AS v FROM {table}"


bal = op("-", field("s_acctbal"), lit(4000.0))
fn("fn_abs", "supplier", "s_suppkey", call("ABS", bal), "abs(s_acctbal - 4000.0)")
fn("fn_floor", "supplier", "s_suppkey", call("FLOOR", bal), "CAST(floor(s_acctbal - 4000.0) AS BIGINT)")
fn("fn_ceil", "supplier", "s_suppkey", call("CEIL", bal), "CAST(ceil(s_acctbal - 4000.0) AS BIGINT)")
fn("fn_round", "supplier", "s_suppkey", call("ROUND", op("/", bal, lit(8.0))), "floor((s_acctbal - 4000.0) / 8.0 + 0.5)", Options(script=True))
fn("fn_sqrt", "supplier", "s_suppkey", call("SQRT", call("ABS", bal)), "sqrt(abs(s_acctbal - 4000.0))")
fn("fn_upper", "part", "p_partkey", call("UPPER", field("p_name")), "upper(p_name)")
fn("fn_lower", "part", "p_partkey", call("LOWER", field("p_type")), "lower(p_type)")
fn("fn_trim", "part", "p_partkey", call("TRIM", op("CONCAT", lit(" \t\n"), op("CONCAT", field("p_name"), lit(" \n ")))), "p_name")
fn("fn_length", "part", "p_partkey", call("LENGTH", field("p_name")), "CAST(length(p_name) AS INTEGER)")
fn("fn_concat", "part", "p_partkey", call("CONCAT", field("p_brand"), lit("/"), field("p_type")), "p_brand || '/' || p_type")
fn("fn_coalesce", "part", "p_partkey", call("COALESCE", lit(None, "string"), field("p_name")), "p_name")
fn("fn_date_trunc", "orders", "o_orderkey", call("DATE_TRUNC", lit("month"), field("o_orderdate")), "strftime(o_orderdate, '%Y-%m')", Options(script=True))
fn("fn_now", "region", "r_regionkey", op(">", call("NOW"), lit(1600000000000)), "TRUE", Options(script=True))
fn("expr_conditional", "part", "p_partkey", when(op(">", field("p_size"), lit(25)), lit("big"), lit("small")), "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END")
fn("expr_arithmetic", "part", "p_partkey", op("/", op("*", op("+", field("p_size"), lit(3)), lit(2)), op("%", field("p_size"), lit(7))), "CAST((p_size + 3) * 2 AS DOUBLE) / nullif(p_size % 7, 0)")
fn("expr_cast", "part", "p_partkey", {"kind": "Cast", "expr": field("p_size"), "to": "string"}, "CAST(p_size AS VARCHAR)")
fn("expr_in", "part", "p_partkey", {"kind": "In", "expr": field("p_size"), "values": [lit(1), lit(2), lit(3)]}, "p_size IN (1, 2, 3)")
fn("expr_between", "part", "p_partkey", {"kind": "Between", "expr": field("p_size"), "low": lit(5), "high": lit(9)}, "p_size BETWEEN 5 AND 9")
fn("expr_is_null", "part", "p_partkey", {"kind": "IsNull", "expr": field("p_name")}, "p_name IS NULL")


@query("json_flatten", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def flatten(spark, d):
    return _load(spark, d)("events").select("event_id", F.element_at(json_flatten(F.col("props")), "k").alias("k"))


@query("json_array_root", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def array_root(spark, d):
    return _load(spark, d)("events").select("event_id", F.explode(json_array_root(F.col("props"), "k", "bigint")).alias("k"))


# --- transforms and merges ---------------------------------------------------------------


def t(name: str, sql: str, table: str, ops: list[dict], out: list[str]) -> None:
    Q[name], SQL[name] = (lambda spark, d: tf.apply_operations(_load(spark, d)(table), ops).select(*out)), sql


t("t_add_field", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders", "orders", [{"kind": "addField", "name": "twice", "expr": op("*", field("o_totalprice"), lit(2))}], ["o_orderkey", "twice"])
t("t_remove_field", "SELECT r_regionkey FROM region", "region", [{"kind": "removeField", "name": "r_name"}], ["*"])
t("t_rename_field", "SELECT r_regionkey AS id, r_name FROM region", "region", [{"kind": "renameField", "from": "r_regionkey", "to": "id"}, {"kind": "renameField", "from": "absent", "to": "x"}], ["*"])
t("t_cast_field", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part", "part", [{"kind": "castField", "name": "p_size", "to": "string"}], ["p_partkey", "p_size"])
t("t_filter_rows", "SELECT p_partkey FROM part WHERE p_size > 30", "part", [{"kind": "filterRows", "predicate": op(">", field("p_size"), lit(30))}], ["p_partkey"])
t("t_sort_rows", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC NULLS FIRST, p_partkey", "part", [{"kind": "sortRows", "keys": [{"expr": field("p_size"), "direction": "DESC"}, {"expr": field("p_partkey"), "direction": "ASC"}]}], ["p_partkey", "p_size"])
t("t_dedup", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "orders", [{"kind": "sortRows", "keys": [{"expr": field("o_orderdate"), "direction": "DESC"}, {"expr": field("o_orderkey"), "direction": "ASC"}]}, {"kind": "dedup", "on": ["o_custkey"]}], ["o_custkey", "o_orderkey"])
t("t_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7", "orders", [{"kind": "sortRows", "keys": [{"expr": field("o_orderkey"), "direction": "ASC"}]}, {"kind": "limit", "count": 7}], ["o_orderkey"])


@query("union_all", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000")
def union_all(spark, d):
    o = _load(spark, d)("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tf.merge("union", [o.where("o_orderstatus = 'F'").drop("o_totalprice"), o.where("o_totalprice > 100000").drop("o_totalprice")])


@query("merge_join", "SELECT a.o_orderkey, a.o_custkey, b.o_totalprice FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus = 'F' AND b.o_totalprice > 200000")
def merge_join(spark, d):
    o = _load(spark, d)("orders")
    return tf.merge("join", [o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey"), o.where("o_totalprice > 200000").select("o_orderkey", "o_totalprice")], ["o_orderkey"])


@query("merge_first", "SELECT r_regionkey FROM region")
def merge_first(spark, d):
    load = _load(spark, d)
    return tf.merge("first", [load("region").select("r_regionkey"), load("nation").select("n_nationkey")])


@query("merge_last", "SELECT n_nationkey FROM nation")
def merge_last(spark, d):
    load = _load(spark, d)
    return tf.merge("last", [load("region").select("r_regionkey"), load("nation").select("n_nationkey")])


@query("multi_input_record", "SELECT count(*) AS n, CAST(2 AS INTEGER) AS x FROM region")
def multi_input(spark, d):
    return tf.first_rows([(spark.createDataFrame([(1, 2)], "n int, x int"), False), (_load(spark, d)("region").agg(F.count(F.lit(1)).alias("n")), True)])


# --- pipelines --------------------------------------------------------------------------


def _run(spark: SparkSession, d: str, steps: list[dict], **more) -> DataFrame:
    graph = compile_intent({"description": "", "steps": steps})
    result = Scheduler().run(graph, Context(spark, _load(spark, d), **more))
    if result.status == "failed":
        raise RuntimeError(str(result.errors))
    return result.table()


def step(i: str, kind: str, payload: dict | None = None, **more) -> dict:
    policy = more.pop("policy", None)
    return {"id": i, "kind": kind, "description": i, "config": {"payload": payload or {}, **({"errorPolicy": policy} if policy else {})}, **more}


REGIONS = {"intent": {"table": "region", "columns": cols("r_regionkey", "r_name"), "orderBy": [{"field": "r_regionkey"}]}}
add = lambda name, e: {"operations": [{"kind": "addField", "name": name, "expr": e}]}


@query("pipeline_linear", "SELECT r_regionkey, r_name, r_regionkey + 1 AS next FROM region")
def linear(spark, d):
    return _run(spark, d, [step("q", "query", REGIONS), step("t", "transform", add("next", op("+", field("r_regionkey"), lit(1))), dependsOn=["q"])])


@query("conditional", "SELECT r_regionkey, r_name, 'low' AS branch FROM region")
def conditional(spark, d):
    return _run(spark, d, [step("q", "query", REGIONS), step("c", "conditional", {"predicate": op(">", field("r_regionkey"), lit(2))}, dependsOn=["q"], trueBranch="hi", falseBranch="lo"), step("hi", "transform", add("branch", lit("high"))), step("lo", "transform", add("branch", lit("low")))])


@query("loop_foreach", "SELECT r_regionkey, r_name, r_regionkey * 2 AS doubled FROM region")
def foreach(spark, d):
    return _run(spark, d, [step("q", "query", REGIONS), step("l", "loop", {}, dependsOn=["q"], loopMode="forEach", loopBody=["b"], maxIterations=100), step("b", "transform", add("doubled", op("*", field("r_regionkey", "item"), lit(2))))])


@query("loop_while", "SELECT * FROM (VALUES (0), (1), (2)) AS v(i)")
def while_loop(spark, d):
    return _run(spark, d, [step("l", "loop", {"condition": op("<", {"kind": "VarRef", "name": "item"}, lit(3))}, loopMode="while", loopBody=["b"], maxIterations=10), step("b", "transform", add("i", {"kind": "VarRef", "name": "item"}))])


@query("acc_merge", "SELECT CAST(4 AS BIGINT) AS k, CAST(20 AS BIGINT) AS v")
def acc_merge(spark, d):
    ops = [{"kind": "addField", "name": "k", "expr": {"kind": "Cast", "expr": field("r_regionkey"), "to": "any"}}, {"kind": "addField", "name": "v", "expr": op("*", field("r_regionkey"), lit(5))}, {"kind": "removeField", "name": "r_regionkey"}, {"kind": "removeField", "name": "r_name"}]
    return _run(spark, d, [step("q", "query", REGIONS), step("l", "loop", {"accumulator": {"kind": "merge"}}, dependsOn=["q"], loopBody=["b"]), step("b", "transform", {"operations": ops})])


@query("acc_reduce", "SELECT CAST(SUM(r_regionkey) AS BIGINT) AS value FROM region")
def acc_reduce(spark, d):
    acc = {"kind": "reduce", "initial": 0, "reducer": op("+", {"kind": "VarRef", "name": "acc"}, field("r_regionkey", "item"))}
    return _run(spark, d, [step("q", "query", REGIONS), step("l", "loop", {"accumulator": acc}, dependsOn=["q"], loopBody=["b"]), step("b", "transform", {"operations": []})])


@query("acc_collect", "SELECT r_regionkey, r_name FROM region")
def acc_collect(spark, d):
    return _run(spark, d, [step("q", "query", REGIONS), step("l", "loop", {"indexVar": "i"}, dependsOn=["q"], loopBody=["b"]), step("b", "transform", {"operations": []})])


@query("parallel", "SELECT r_regionkey, r_name, 'a' AS branch FROM region UNION ALL SELECT r_regionkey, r_name, 'b' FROM region")
def parallel(spark, d):
    return _run(spark, d, [step("q", "query", REGIONS), step("p", "parallel", {}, dependsOn=["q"], parallelBranches=["a", "b"]), step("a", "transform", add("branch", lit("a"))), step("b", "transform", add("branch", lit("b"))), step("m", "merge", {"strategy": "union"}, mergeFrom=["a", "b"])])


@query("error_policy", "SELECT r_regionkey, r_name FROM region")
def error_policy(spark, d):
    bad = add("x", {"kind": "Cast", "expr": field("r_name"), "to": "number"})
    return _run(spark, d, [step("q", "query", REGIONS), step("t", "transform", bad, dependsOn=["q"], policy={"onError": "skip"})])


# --- writes ----------------------------------------------------------------------------


def _target(spark, d):
    return _load(spark, d)("nation")


def _changes(spark, d):
    n = _load(spark, d)("nation").where("n_nationkey % 2 = 0")
    return n.select((F.col("n_nationkey") + 20).cast("int").alias("n_nationkey"), F.upper("n_name").alias("n_name"), "n_regionkey")


CH = "SELECT CAST(n_nationkey + 20 AS INTEGER) AS n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 0"


def w(name: str, sql: str, make) -> None:
    Q[name], SQL[name] = (lambda spark, d: make(_target(spark, d), _changes(spark, d))), sql


w("write_insert", f"SELECT * FROM nation UNION ALL {CH}", lambda t, r: writes.insert(t, r))
w("write_insert_ignore", f"SELECT * FROM nation UNION ALL SELECT * FROM ({CH}) c WHERE c.n_nationkey NOT IN (SELECT n_nationkey FROM nation)", lambda t, r: writes.insert_ignore(t, r, ["n_nationkey"]))
w("write_upsert", f"SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM ({CH})) UNION ALL {CH}", lambda t, r: writes.upsert(t, r, ["n_nationkey"]))
w("write_update_static", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation", lambda t, r: writes.update_static(t, {"n_name": "X"}, writes.build_predicate({"n_regionkey": 1})))
w("write_update_rows", f"SELECT n.n_nationkey, coalesce(c.n_name, n.n_name) AS n_name, coalesce(c.n_regionkey, n.n_regionkey) AS n_regionkey FROM nation n LEFT JOIN ({CH}) c USING (n_nationkey)", lambda t, r: writes.update_rows(t, r, ["n_nationkey"]))
w("write_update_any", f"SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT n_nationkey FROM ({CH})) THEN 'Y' ELSE n_name END AS n_name, n_regionkey FROM nation", lambda t, r: writes.update_any(t, r, "n_nationkey", {"n_name": "Y"}))
w("write_delete", f"SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM ({CH}))", lambda t, r: writes.delete_rows(t, r, ["n_nationkey"]))
w("write_soft_delete", f"SELECT n_nationkey, n_nationkey IN (SELECT n_nationkey FROM ({CH})) AS gone FROM nation", lambda t, r: writes.soft_delete(t.withColumn("deleted_at", F.lit(None).cast("timestamp")), r, ["n_nationkey"]).select("n_nationkey", F.col("deleted_at").isNotNull().alias("gone")))
w("write_predicate", "SELECT n_nationkey FROM nation WHERE (n_regionkey IN (1, 2) AND n_nationkey BETWEEN 3 AND 18) OR n_name IS NULL", lambda t, r: t.where(writes.predicate_column({"kind": "or", "left": {"kind": "and", "left": {"kind": "any", "column": "n_regionkey", "values": [1, 2]}, "right": {"kind": "range", "column": "n_nationkey", "min": 3, "max": 18}}, "right": {"kind": "isNull", "column": "n_name"}})).select("n_nationkey"))


@query("fk_validate", "SELECT DISTINCT 'o_custkey' AS \"column\", CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def fk_validate(spark, d):
    load = _load(spark, d)
    return writes.missing_keys({"customer": load("customer").where("c_custkey % 3 <> 0")}, catalog(spark, d), "orders", load("orders"))


# --- sessions, similarity, enrichment ----------------------------------------------------------


@query("cursor", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' AND c_acctbal BETWEEN 0 AND 5000")
def cursor(spark, d):
    from weftline.plans.session import SessionCursor

    c, s = _load(spark, d)("customer"), SessionCursor()
    filters = [flt("c_mktsegment", "=", "Building", caseInsensitive=True), flt("c_acctbal", "BETWEEN", [0, 5000])]
    s.remember("customer", c.where("lower(c_mktsegment) = 'building' AND c_acctbal BETWEEN 0 AND 5000"), filters, "c_custkey")
    return c.where(s.where()).select("c_custkey")


@query("vector_topk", "SELECT e.vec_id FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE vec_id <> 0 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id LIMIT 5")
def vector_topk(spark, d):
    e = _load(spark, d)("embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return topk(e, q, 5, where=F.col("vec_id") != 0, tie="vec_id").select("vec_id")


@query("cache_stats", "SELECT 'all' AS part, count(*) AS entries, count(*) FILTER (WHERE label > 3) AS valid, CAST(sum(label) AS BIGINT) AS hits FROM embeddings UNION ALL (SELECT 'top ' || vec_id, NULL, NULL, CAST(label AS BIGINT) FROM embeddings ORDER BY label DESC, vec_id LIMIT 5)")
def cache_stats(spark, d):
    from weftline.operators.vector import SemanticCache

    e = _load(spark, d)("embeddings")
    c = SemanticCache(e.select(F.col("vec_id").alias("id"), (F.col("label") > 3).alias("valid"), F.col("label").cast("long").alias("hits")))
    none = F.lit(None).cast("long")
    top = c.top().select(F.concat(F.lit("top "), F.col("id").cast("string")).alias("part"), none.alias("entries"), none.alias("valid"), "hits")
    return c.stats().select(F.lit("all").alias("part"), "*").unionByName(top)


@query("cache_invalidate", "SELECT vec_id, label > 3 AND label <> 5 AS valid FROM embeddings")
def cache_invalidate(spark, d):
    from weftline.operators.vector import SemanticCache

    e = _load(spark, d)("embeddings").select("vec_id", (F.col("label") > 3).alias("valid"), F.array(F.col("label").cast("string")).alias("sources"))
    return SemanticCache(e).invalidate(["5"]).select("vec_id", "valid")


def _answer(request: dict) -> dict:
    b = request["body"]
    tier = "gold" if b["c_acctbal"] >= 5000 else "basic"
    return {"status": 200, "body": {"tier": tier, "id": {"key": b["c_custkey"]}}}


@query("http_map", "SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'gold' ELSE 'basic' END AS tier, CAST(c_custkey AS VARCHAR) AS \"id.key\", '200' AS http_status FROM customer")
def http_map_query(spark, d):
    from weftline.operators.enrich import http_map

    c = _load(spark, d)("customer").select("c_custkey", "c_acctbal")
    return http_map(c, {"url": "http://localhost/", "method": "POST", "outputFields": ["tier", "id.key"]}, _answer).select("c_custkey", "tier", "`id.key`", "http_status")


def _answers(request: dict) -> dict:
    return {"status": 200, "body": [{"n": r["r_regionkey"] * 10} for r in request["body"]]}


@query("http_batch", "SELECT r_regionkey, CAST(r_regionkey * 10 AS VARCHAR) AS n FROM region")
def http_batch(spark, d):
    from weftline.operators.enrich import http_map

    return http_map(_load(spark, d)("region"), {"url": "http://localhost/", "method": "POST", "outputFields": ["n"], "batchMode": True, "chunkSize": 2}, _answers).select("r_regionkey", "n")


def _list(request: dict) -> dict:
    return {"status": 200, "body": {"data": {"items": [{"i": k} for k in range(request["body"]["r_regionkey"])]}}}


@query("http_array", "SELECT r_regionkey, CAST(i AS VARCHAR) AS i FROM (SELECT r_regionkey, unnest(range(r_regionkey)) AS i FROM region)")
def http_array(spark, d):
    from weftline.operators.enrich import http_map

    return http_map(_load(spark, d)("region"), {"url": "http://localhost/", "method": "POST", "outputFields": ["i"], "responseMode": "array", "responseRoot": "data.items"}, _list).select("r_regionkey", "i")


def _model(request: dict) -> str:
    name = request["prompt"].removeprefix("Name: ")
    return '{"upper": "' + name.upper() + '", "size": ' + str(len(name)) + "}"


@query("llm_map", "SELECT r_regionkey, upper(r_name) AS upper, CAST(length(r_name) AS BIGINT) AS size FROM region")
def llm_map_query(spark, d):
    from weftline.operators.enrich import llm_map

    prompt = [{"kind": "literal", "text": "Name: "}, {"kind": "expr", "expr": field("r_name")}]
    return llm_map(_load(spark, d)("region"), {"userPrompt": prompt, "outputSchema": [("upper", "string"), ("size", "bigint")]}, _model).select("r_regionkey", "upper", "size")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from weftline.streaming.streams import windowed

    return windowed(_load(spark, d)("events"), "ts", "1 day", ["event_type"], [{"fn": "COUNT", "expr": "*", "alias": "n"}], "1 hour").drop("window_end")
