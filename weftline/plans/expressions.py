"""Expression trees (plain dicts, so they serialise) compiled to Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from weftline.functions import FunctionRegistry, builtins
from weftline.plans.options import DEFAULT, Options


class ExpressionError(ValueError):
    pass


class UnknownField(ExpressionError):
    def __init__(self, field: str, available: Iterable[str]):
        super().__init__(f"Field '{field}' not found. Available fields: {', '.join(sorted(available)) or 'none'}")


class UnboundVariable(ExpressionError):
    def __init__(self, name: str):
        super().__init__(f"Variable '{name}' is not bound")


# Builders of the nodes, for readable Python.


def lit(value: Any, type: str | None = None) -> dict:
    return {"kind": "Literal", "value": value, "type": type}


def field(name: str, table: str | None = None) -> dict:
    return {"kind": "FieldRef", "field": name, **({"table": table} if table else {})}


def var(name: str) -> dict:
    return {"kind": "VarRef", "name": name}


def op(symbol: str, left: dict, right: dict) -> dict:
    return {"kind": "BinaryOp", "op": symbol, "left": left, "right": right}


def call(name: str, *args: dict) -> dict:
    return {"kind": "FunctionCall", "name": name, "args": list(args)}


def when(condition: dict, then: dict, other: dict) -> dict:
    return {"kind": "Conditional", "condition": condition, "then": then, "else": other}


def _type_name(kind: Any) -> str:
    return kind["kind"] if isinstance(kind, Mapping) else str(kind)


#: Engine type to Spark type.
SPARK_TYPE = {"string": "string", "number": "double", "boolean": "boolean", "datetime": "timestamp"}


class Compiler:
    """Trees to Columns.

    ``resolve(table, field)`` gives the Column of a field or raises UnknownField.
    """

    def __init__(
        self,
        resolve: Callable[[str | None, str], Column] | None = None,
        scope: Mapping[str, Any] | None = None,
        functions: FunctionRegistry | None = None,
        options: Options = DEFAULT,
    ):
        self.resolve = resolve or (lambda t, f: F.col(f"{t}.`{f}`" if t else f"`{f}`"))
        self.scope = scope or {}
        self.functions = functions or builtins()
        self.options = options

    def __call__(self, e: Mapping) -> Column:
        method = getattr(self, "_" + e["kind"].lower(), None)
        if method is None:
            raise ExpressionError(f"Unknown expression kind: {e['kind']}")
        return method(e)

    def _literal(self, e: Mapping) -> Column:
        value, kind = e.get("value"), _type_name(e.get("type") or "")
        if value is None:
            return F.lit(None).cast(SPARK_TYPE[kind]) if kind in SPARK_TYPE else F.lit(None)
        if kind == "datetime" and isinstance(value, str):
            return F.to_timestamp(F.lit(value))
        if isinstance(value, (list, tuple)):
            return F.array(*[self._literal({"value": v}) for v in value])
        if isinstance(value, Mapping):
            return F.struct(*[self._literal({"value": v}).alias(k) for k, v in value.items()])
        return F.lit(value)

    def _fieldref(self, e: Mapping) -> Column:
        name, table = e["field"], e.get("table")
        if table and table in self.scope:
            record = self.scope[table]
            if isinstance(record, Mapping):
                if name not in record:
                    raise UnknownField(name, record)
                return record[name] if isinstance(record[name], Column) else self._literal({"value": record[name]})
        try:
            return self.resolve(table, name)
        except UnknownField:
            if name in self.scope:
                return self._varref({"name": name})
            raise

    def _varref(self, e: Mapping) -> Column:
        if e["name"] not in self.scope:
            raise UnboundVariable(e["name"])
        value = self.scope[e["name"]]
        return value if isinstance(value, Column) else self._literal({"value": value})

    def _binaryop(self, e: Mapping) -> Column:
        symbol, le, re_ = e["op"], e["left"], e["right"]
        null = lambda x: x["kind"] == "Literal" and x.get("value") is None
        if symbol in ("=", "!="):
            # A comparison with the literal null asks for null.
            for one, other in ((le, re_), (re_, le)):
                if null(one):
                    c = self(other)
                    return c.isNull() if symbol == "=" else c.isNotNull()
        a, b = self(le), self(re_)
        if symbol == "=":
            return a.eqNullSafe(b) if self.options.null_safe else a == b
        if symbol == "!=":
            return ~a.eqNullSafe(b) if self.options.null_safe else a != b
        if symbol == "/":
            return F.try_divide(a.cast("double"), b.cast("double"))
        if symbol == "%":
            return F.call_function("try_mod", a, b)
        if symbol == "CONCAT":
            return self.functions.call("CONCAT", [a, b], self.options.script)
        if symbol == "LIKE":
            return F.call_function("like", a, b)
        simple = {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "<": lambda: a < b, ">": lambda: a > b,
            "<=": lambda: a <= b, ">=": lambda: a >= b, "AND": lambda: a & b, "OR": lambda: a | b,
        }
        if symbol not in simple:
            raise ExpressionError(f"Unknown operator: {symbol}")
        if self.options.lenient and symbol in "+-*":
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[symbol](a, b)
        return simple[symbol]()

    def _unaryop(self, e: Mapping) -> Column:
        a = self(e["operand"])
        if e["op"] == "NOT":
            return ~a
        if e["op"] == "NEG":
            return -a
        raise ExpressionError(f"Unknown operator: {e['op']}")

    def _functioncall(self, e: Mapping) -> Column:
        return self.functions.call(e["name"], [self(a) for a in e.get("args", [])], self.options.script)

    def _conditional(self, e: Mapping) -> Column:
        return F.when(self(e["condition"]), self(e["then"])).otherwise(self(e["else"]))

    def _cast(self, e: Mapping) -> Column:
        return cast(self(e["expr"]), e["to"], self.options)

    def _isnull(self, e: Mapping) -> Column:
        return self(e["expr"]).isNull()

    def _in(self, e: Mapping) -> Column:
        values = e["values"]
        if not values:
            return F.lit(False)
        return self(e["expr"]).isin(*[self(v) for v in values])

    def _between(self, e: Mapping) -> Column:
        return self(e["expr"]).between(self(e["low"]), self(e["high"]))

    def _windowexpr(self, e: Mapping) -> Column:
        fn = e["fn"]
        over = Window.partitionBy(*[self(p) for p in e.get("partition") or []])
        order = [sort_key(self(o if "kind" in o else o["expr"]), o.get("direction", "ASC"), o.get("nulls")) for o in e.get("orderBy") or []]
        if order:
            over = over.orderBy(*order)
        elif fn in ("ROW_NUMBER", "RANK", "LAG", "LEAD"):
            raise ExpressionError(f"{fn} needs an order")
        if fn == "ROW_NUMBER":
            return F.row_number().over(over)
        if fn == "RANK":
            return F.rank().over(over)
        arg = e.get("over") or {"kind": "Wildcard"}
        if fn in ("LAG", "LEAD"):
            return (F.lag if fn == "LAG" else F.lead)(self(arg), e.get("offset", 1)).over(over)
        if fn == "COUNT_DISTINCT":
            return F.size(F.collect_set(self(arg)).over(over)).cast("long")
        return aggregate(fn, self(arg), self.options).over(over)

    def _sqlexpr(self, e: Mapping) -> Column:
        return F.expr(e["sql"])

    def _wildcard(self, _: Mapping) -> Column:
        return F.lit(1)


def cast(col: Column, to: Any, options: Options = DEFAULT) -> Column:
    """Casts that keep null; what can't be cast is null under ``lenient``."""
    kind = _type_name(to)
    if kind in ("json", "any"):
        return col
    if kind == "string":
        return col.cast("string")
    if kind in ("number", "datetime"):
        return col.try_cast(SPARK_TYPE[kind]) if options.lenient else col.cast(SPARK_TYPE[kind])
    if kind == "boolean":
        if options.script:  # any text but the empty one, any number but zero
            text = col.cast("string")
            return F.when(col.isNotNull(), ~text.isin("", "0", "0.0"))
        return col.try_cast("boolean") if options.lenient else col.cast("boolean")
    raise ExpressionError(f"Cannot cast to {kind}")


def aggregate(fn: str, col: Column, options: Options = DEFAULT, star: bool = False) -> Column:
    """Aggregate column of one of the known functions."""
    zero = (lambda c: F.coalesce(c, F.lit(0))) if options.empty_as_zero else (lambda c: c)
    if fn == "COUNT":
        return F.count(F.lit(1)) if star else F.count(col)
    if fn == "COUNT_DISTINCT":
        return F.count_distinct(col)
    if fn == "SUM":
        return zero(F.sum(col))
    if fn == "AVG":
        return zero(F.avg(col))
    if fn == "MIN":
        return F.min(col)
    if fn == "MAX":
        return F.max(col)
    raise ExpressionError(f"Unknown aggregate: {fn}")


def sort_key(col: Column, direction: str = "ASC", nulls: str | None = None, default_nulls: str = "LAST") -> Column:
    """Explicit null order: LAST unless said otherwise."""
    last = (nulls or default_nulls).upper() == "LAST"
    if (direction or "ASC").upper() == "DESC":
        return col.desc_nulls_last() if last else col.desc_nulls_first()
    return col.asc_nulls_last() if last else col.asc_nulls_first()


def columns_resolver(names: Iterable[str]) -> Callable[[str | None, str], Column]:
    """Fields of a flat table; a qualifier is used where ``table.field`` exists."""
    known = list(names)

    def resolve(table: str | None, name: str) -> Column:
        for candidate in ([f"{table}.{name}"] if table else []) + [name]:
            if candidate in known:
                return F.col(f"`{candidate}`")
        raise UnknownField(name, known)

    return resolve


def references(e: Any) -> list[tuple[str | None, str]]:
    """(table, field) of every field that a tree names."""
    if isinstance(e, Mapping):
        own = [(e.get("table"), e["field"])] if e.get("kind") == "FieldRef" else []
        return own + [r for v in e.values() for r in references(v)]
    if isinstance(e, (list, tuple)):
        return [r for v in e for r in references(v)]
    return []


def without_unknown(e: Any, known: Iterable[str]) -> Any:
    """The tree with references to unknown fields replaced by null."""
    names = set(known)
    if isinstance(e, Mapping):
        if e.get("kind") == "FieldRef" and e["field"] not in names:
            return lit(None, "null")
        return {k: without_unknown(v, names) for k, v in e.items()}
    if isinstance(e, (list, tuple)):
        return [without_unknown(v, names) for v in e]
    return e


def evaluate(spark, e: Mapping, scope: Mapping[str, Any], functions: FunctionRegistry | None = None, options: Options = DEFAULT) -> Any:
    """The value of a tree that names no field, on the driver."""
    return spark.range(1).select(Compiler(columns_resolver([]), scope, functions, options)(e).alias("v")).first()[0]
