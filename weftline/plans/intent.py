"""Structured queries: validation, and their DataFrame.

An intent is a plain dict: table, columns, joins, filters, groupBy,
aggregations, having, orderBy, limit, offset, distinct. Catalyst plans it; the
only decisions made here are names, join paths, placement of filters and the
order of nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import FunctionRegistry
from weftline.plans.catalog import Catalog, Grants
from weftline.plans.expressions import Compiler, UnknownField, aggregate, sort_key
from weftline.plans.options import DEFAULT, Options

OPERATORS = ("=", "!=", "<", ">", "<=", ">=", "LIKE", "IN", "NOT IN", "BETWEEN", "IS NULL", "IS NOT NULL")
AGGREGATES = ("SUM", "AVG", "COUNT", "COUNT_DISTINCT", "MIN", "MAX")
WINDOWS = ("ROW_NUMBER", "RANK", "LAG", "LEAD")
KINDS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}


class IntentError(ValueError):
    """All problems of an intent at once."""

    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("; ".join(problems))


def _is_subquery(f: Mapping) -> bool:
    v = f.get("value")
    return f.get("operator") in ("IN", "NOT IN") and isinstance(v, str) and v.strip().lstrip("(").lower().startswith("select")


def validate(intent: Mapping, catalog: Catalog) -> None:
    """Tables, columns, operators, the grouping rule and the limits."""
    bad: list[str] = []
    table = intent.get("table")
    if table not in catalog.tables:
        raise IntentError([f"Table '{table}' not found in schema"])
    aliases = {intent.get("alias") or table: table, table: table}
    for j in intent.get("joins") or []:
        if j["table"] not in catalog.tables:
            bad.append(f"Join table '{j['table']}' not found in schema")
            continue
        aliases[j.get("alias") or j["table"]] = j["table"]
        aliases.setdefault(j["table"], j["table"])
        if (j.get("kind") or "INNER") not in KINDS:
            bad.append(f"Unknown join kind '{j['kind']}'")

    def known(name: str, owner: str | None, what: str, extra: set[str] = frozenset()) -> None:
        if name == "*" or name in extra:
            return
        if "." in name and owner is None:
            owner, name = name.split(".", 1)
        if owner is not None and owner not in aliases:
            if owner not in catalog.tables:
                bad.append(f"Table '{owner}' of {what} '{name}' not found in query")
            elif what != "filter":
                bad.append(f"Table '{owner}' of {what} '{name}' is not joined")
            return
        where = [aliases[owner]] if owner else list(dict.fromkeys(aliases.values()))
        if not any(name in catalog.tables[t].columns for t in where):
            bad.append(f"Column '{name}' not found in table '{owner or table}'")

    columns = intent.get("columns") or []
    out_names = {c.get("alias") or c.get("field") for c in columns} | {a["alias"] for a in intent.get("aggregations") or []}
    for c in columns:
        if not c.get("expr"):
            known(c["field"], c.get("table"), "column")
        if c.get("agg") and c["agg"] not in AGGREGATES + WINDOWS:
            bad.append(f"Unknown aggregate '{c['agg']}'")
    for f in intent.get("filters") or []:
        if f["operator"] not in OPERATORS:
            bad.append(f"Unknown operator '{f['operator']}'")
        owner = f.get("table")
        if owner is not None and owner not in aliases and not _is_subquery(f):
            bad.append(f"Filter on table '{owner}', which is not in the query")
        elif owner is None or owner in aliases:
            known(f["field"], owner, "filter")
    for g in intent.get("groupBy") or []:
        known(g, None, "groupBy", out_names)
    for h in intent.get("having") or []:
        known(h["field"], h.get("table"), "having", out_names)
    for o in intent.get("orderBy") or []:
        if not o.get("expr"):
            known(o["field"], o.get("table"), "orderBy", out_names)
    for a in intent.get("aggregations") or []:
        if a["fn"] not in AGGREGATES:
            bad.append(f"Unknown aggregate '{a['fn']}'")
    if intent.get("groupBy"):
        keys = {g.split(".")[-1] for g in intent["groupBy"]}
        for c in columns:
            joined = c.get("table") not in (None, table)
            if not c.get("agg") and not c.get("expr") and c["field"] != "*" and c["field"] not in keys and not joined:
                bad.append(f"Column '{c['field']}' must be in groupBy or in an aggregate")
    for k in ("limit", "offset"):
        if intent.get(k) is not None and intent[k] < 0:
            bad.append(f"{k} must not be negative")
    if bad:
        raise IntentError(bad)


class Query:
    """One intent over loaded tables.

    ``load(name)`` gives a table's DataFrame, ``refs`` the DataFrames or values
    that filters refer to by valueRef.
    """

    def __init__(
        self,
        spark: SparkSession,
        load: Callable[[str], DataFrame],
        catalog: Catalog | None = None,
        refs: Mapping[str, Any] | None = None,
        options: Options = DEFAULT,
        functions: FunctionRegistry | None = None,
        grants: Grants | None = None,
    ):
        if grants is not None:  # whatever reads a table meets the grants
            plain = load
            load = lambda name: grants.frame(name, plain(name))
        self.grants = grants
        self.spark, self.load, self.refs, self.options, self.functions = spark, load, refs or {}, options, functions
        self.catalog = catalog

    def run(self, intent: Mapping) -> DataFrame:
        if self.grants is not None:
            self.grants.check_query(intent, self.catalog)
        catalog = self.catalog or self._catalog(intent)
        validate(intent, self.grants.catalog(catalog) if self.grants is not None else catalog)
        return _Build(self, intent, catalog).frame()

    def explain(self, intent: Mapping) -> str:
        df = self.run(intent)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _catalog(self, intent: Mapping) -> Catalog:
        names = {intent["table"], *[j["table"] for j in intent.get("joins") or []]}
        return Catalog.of_frames({n: self.load(n) for n in names})


class _Build:
    def __init__(self, query: Query, intent: Mapping, catalog: Catalog):
        self.q, self.intent, self.catalog = query, intent, catalog
        self.options = query.options
        self.aliases: dict[str, str] = {}  # alias -> table
        self.fields: dict[str, list[str]] = {}  # alias -> columns

    # -- names

    def _add(self, table: str, alias: str) -> DataFrame:
        df = self.q.load(table)
        self.aliases[alias], self.fields[alias] = table, df.columns
        return df.alias(alias)

    def _alias_of(self, owner: str) -> str | None:
        if owner in self.aliases:
            return owner
        return next((a for a, t in self.aliases.items() if t == owner), None)

    def resolve(self, owner: str | None, name: str) -> Column:
        if owner is None and "." in name:
            first, rest = name.split(".", 1)
            if self._alias_of(first):
                owner, name = first, rest
        where = [self._alias_of(owner)] if owner else list(self.aliases)
        for a in where:  # the primary table comes first
            if a and name in self.fields[a]:
                return F.col(f"`{a}`.`{name}`")
        raise UnknownField(name, [f"{a}.{c}" for a, cs in self.fields.items() for c in cs])

    # -- filters

    def condition(self, f: Mapping, col: Column) -> Column:
        how, value = f["operator"], f.get("value")
        if how == "IS NULL":
            return col.isNull()
        if how == "IS NOT NULL":
            return col.isNotNull()
        ci = bool(f.get("caseInsensitive"))
        fold = (lambda c: F.lower(c)) if ci else (lambda c: c)
        if f.get("expr"):
            other = F.expr(f["expr"])
        elif how == "LIKE":
            return col.ilike(value) if ci else col.like(value)
        elif how in ("IN", "NOT IN") or (how == "!=" and isinstance(value, (list, tuple))):
            values = list(value) if isinstance(value, (list, tuple)) else [value]
            found = fold(col).isin([v.lower() if ci and isinstance(v, str) else v for v in values]) if values else F.lit(False)
            return found if how == "IN" else ~found
        elif how == "BETWEEN":
            low, high = value
            return fold(col).between(fold(F.lit(low)), fold(F.lit(high)))
        elif value is None:
            return col.isNull() if how == "=" else col.isNotNull() if how == "!=" else F.lit(None).cast("boolean")
        else:
            other = F.lit(value)
        a, b = fold(col), fold(other)
        if how in ("=", "!=") and self.options.null_safe:
            return a.eqNullSafe(b) if how == "=" else ~a.eqNullSafe(b)
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[how]

    def combined(self, filters: list[Mapping], resolve: Callable[[str | None, str], Column]) -> Column | None:
        made = [(f, self.condition(f, resolve(f.get("table"), f["field"]))) for f in filters]
        if self.options.filter_grouping == "or_same_value":
            groups: dict[str, Column] = {}
            for f, c in made:
                key = repr((f["operator"], f.get("value")))
                groups[key] = groups[key] | c if key in groups else c
            made = [(None, c) for c in groups.values()]
        out = None
        for _, c in made:
            out = c if out is None else out & c
        return out

    def _semi(self, df: DataFrame, f: Mapping) -> DataFrame:
        """Filters whose values are rows of another result."""
        owner = f.get("table")
        outside = owner is not None and self._alias_of(owner) is None
        negative = f["operator"] in ("NOT IN", "!=")
        if f.get("valueRef"):
            ref = self.q.refs.get(f["valueRef"], self.q.refs.get(f["valueRef"].split(".")[0]))
            if ref is None:
                raise UnknownField(f["valueRef"], self.q.refs)
            if not isinstance(ref, DataFrame):
                values = ref if isinstance(ref, (list, tuple)) else [ref]
                return df.where(self.condition({**f, "operator": "NOT IN" if negative else "IN" if f["operator"] in ("=", "IN") else f["operator"], "value": values if f["operator"] in ("=", "IN", "NOT IN", "!=") else values[0]}, self.resolve(owner, f["field"])))
            name = f["valueRef"].split(".")[1] if "." in f["valueRef"] else f["field"] if f["field"] in ref.columns else ref.columns[0]
            values = ref.select(F.col(f"`{name}`").alias("_ref"))
            if self.options.strict_single:
                found = values.distinct().limit(2).collect()
                if len(found) != 1:
                    raise ValueError(f"valueRef '{f['valueRef']}' is {'ambiguous: it has several values' if found else 'empty'}")
                return df.where(self.condition({**f, "value": found[0][0]}, self.resolve(owner, f["field"])))
            if f["operator"] not in ("=", "IN", "NOT IN", "!="):
                one = values.agg(F.max("_ref") if f["operator"] in ("<", "<=") else F.min("_ref")).first()[0]
                return df.where(self.condition({**f, "value": one}, self.resolve(owner, f["field"])))
            col = self.resolve(owner, f["field"])
            return self._not_in(df, values, col) if negative else df.join(values.distinct(), col == F.col("_ref"), "left_semi")
        text = f["value"].strip()
        text = text[1:-1] if text.startswith("(") and text.endswith(")") else text
        inner = self.q.spark.sql(text, **{})
        inner = inner.toDF("_ref") if len(inner.columns) == 1 else inner.select(F.col(inner.columns[0]).alias("_ref"))
        if outside and negative:
            # The filter's table isn't in the query: no row of it may exist,
            # which nulls in the subquery don't change.
            key = next((k for k in self.catalog.foreign_keys if {k.table, k.ref_table} == {owner, self.intent["table"]}), None)
            name = (key.ref_column if key.ref_table == self.intent["table"] else key.column) if key else f["field"]
            return df.join(inner, self.resolve(None, name) == F.col("_ref"), "left_anti")
        col = self.resolve(owner, f["field"])
        if not negative:
            return df.join(inner.distinct(), col == F.col("_ref"), "left_semi")
        return self._not_in(df, inner, col)

    @staticmethod
    def _not_in(df: DataFrame, values: DataFrame, col: Column) -> DataFrame:
        """SQL's NOT IN: a null among the values leaves no row, a null on this side
        only passes an empty list."""
        state = values.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_ref").isNull()).alias("_nulls"))
        kept = df.join(values.where(F.col("_ref").isNotNull()).distinct(), col == F.col("_ref"), "left_anti")
        return kept.join(F.broadcast(state), F.when(F.col("_n") == 0, True).otherwise((F.col("_nulls") == 0) & col.isNotNull()), "left_semi")

    # -- the parts

    def _joins(self) -> tuple[DataFrame, list[Mapping]]:
        intent = self.intent
        filters = list(intent.get("filters") or [])
        plain = [f for f in filters if not f.get("valueRef") and not _is_subquery(f)]
        df = self._add(intent["table"], intent.get("alias") or intent["table"])
        for j in intent.get("joins") or []:
            kind, alias = KINDS[(j.get("kind") or "INNER")], j.get("alias") or j["table"]
            if j.get("on"):
                right = self._add(j["table"], alias)
                on = self._on(j["on"], alias)
            else:
                df, right, on = self._by_keys(df, j["table"], alias, kind)
            if kind == "left":  # filters on an optional table belong to the match
                own = [f for f in plain if f.get("table") in (alias, j["table"]) and f.get("table") is not None]
                extra = self.combined(own, self.resolve)
                on = on if extra is None else on & extra
                plain = [f for f in plain if f not in own]
            df = df.join(right, on, kind)
        return df, plain + [f for f in filters if f.get("valueRef") or _is_subquery(f)]

    def _on(self, on: Mapping, alias: str) -> Column:
        if "expr" in on:  # any condition, as a tree
            return Compiler(self.resolve, functions=self.q.functions, options=self.options)(on["expr"])
        sides = []
        for side, own in ((on["left"], False), (on["right"], True)):
            owner, _, name = side.rpartition(".")
            if owner:
                sides.append(self.resolve(owner, name))
            elif own:
                sides.append(self.resolve(alias, name))
            else:
                sides.append(self.resolve(None, name))
        return sides[0].eqNullSafe(sides[1]) if self.options.null_safe else sides[0] == sides[1]

    def _by_keys(self, df: DataFrame, table: str, alias: str, kind: str) -> tuple[DataFrame, DataFrame, Column]:
        """The shortest way from a table of the query, through tables in between."""
        ways = []
        for t in dict.fromkeys(self.aliases.values()):
            try:
                ways.append(self.catalog.path(t, table))
            except ValueError:
                continue
        if not ways:
            self.catalog.path(self.intent["table"], table)  # raises
        way = min(ways, key=len)
        at = next(t for t in self.aliases.values() if t in (way[0].table, way[0].ref_table))
        for i, key in enumerate(way):
            here, there = (key.table, key.ref_table) if key.table == at else (key.ref_table, key.table)
            here_col, there_col = (key.column, key.ref_column) if key.table == at else (key.ref_column, key.column)
            last = i == len(way) - 1
            left = self._alias_of(here)
            name = alias if last else there
            right = self._add(there, name)
            on = F.col(f"`{left}`.`{here_col}`") == F.col(f"`{name}`.`{there_col}`")
            if last:
                return df, right, on
            df = df.join(right, on, kind)
            at = there
        raise AssertionError

    def _value(self, text: str) -> Column:
        """An aggregate's argument: a field, * or any SQL expression."""
        if text == "*":
            return F.lit(1)
        try:
            return self.resolve(None, text)
        except UnknownField:
            return F.expr(text)

    def frame(self) -> DataFrame:
        intent, options = self.intent, self.options
        df, rest = self._joins()
        plain = [f for f in rest if not f.get("valueRef") and not _is_subquery(f)]
        where = self.combined(plain, self.resolve)
        df = df if where is None else df.where(where)
        for f in rest:
            if f.get("valueRef") or _is_subquery(f):
                df = self._semi(df, f)

        columns = intent.get("columns") or []
        aggs: dict[str, Column] = {}
        for c in columns:
            if c.get("agg") in AGGREGATES:
                star = c["field"] == "*"
                name = c.get("alias") or (c["agg"].lower() if star else f"{c['agg'].lower()}_{c['field']}")
                aggs[name] = aggregate(c["agg"], F.lit(1) if star else self.resolve(c.get("table"), c["field"]), options, star)
        for a in intent.get("aggregations") or []:
            if a["alias"] not in aggs:
                text = a.get("expr") or "*"
                inner = text.strip()
                # A whole aggregate call in the text is taken as it stands.
                whole = any(inner.upper().startswith(x) for x in ("COALESCE(SUM", "COALESCE(COUNT", "COALESCE(AVG", "SUM(", "COUNT(", "AVG(", "MIN(", "MAX("))
                aggs[a["alias"]] = F.expr(inner) if whole else aggregate(a["fn"], self._value(inner), options, inner == "*")
        if aggs or intent.get("groupBy"):
            return self._grouped(df, columns, aggs)

        shown: list[Column] = []
        names: dict[str, Column] = {}
        for c in columns or [{"field": "*"}]:
            if c.get("expr"):
                col = F.expr(c["expr"])
                name = c.get("alias") or c["field"]
            elif c.get("agg") in WINDOWS:
                col, name = self._window(c), c.get("alias") or c["agg"].lower()
            elif c["field"] == "*":
                for a in [self._alias_of(c["table"])] if c.get("table") else list(self.aliases):
                    for f in self.fields[a]:
                        label = f if f not in names else f"{a}.{f}"
                        names[label] = F.col(f"`{a}`.`{f}`")
                        shown.append(names[label].alias(label))
                continue
            else:
                col, name = self.resolve(c.get("table"), c["field"]), c.get("alias") or c["field"]
            names[name] = col
            shown.append(col.alias(name))
        if intent.get("distinct"):
            df = df.select(*shown).distinct()
            names = {n: F.col(f"`{n}`") for n in df.columns}
            df = self._ordered(df, names, only=True)
        else:
            df = self._ordered(df, names).select(*shown)
        return self._cut(df)

    def _window(self, c: Mapping) -> Column:
        w = {"kind": "WindowExpr", "fn": c["agg"], "partition": [self._ref(p) for p in c.get("partition") or []], "orderBy": [{"expr": self._ref(o["field"]), **o} for o in c.get("orderBy") or []]}
        if c["field"] != "*":
            w["over"] = self._ref(c["field"])
        return Compiler(self.resolve, functions=self.q.functions, options=self.options)(w)

    @staticmethod
    def _ref(name: str) -> dict:
        return {"kind": "FieldRef", "field": name}

    def _grouped(self, df: DataFrame, columns: list[Mapping], aggs: dict[str, Column]) -> DataFrame:
        intent = self.intent
        keys: dict[str, Column] = {}
        for g in intent.get("groupBy") or []:
            label = g.split(".")[-1]
            col = next((F.expr(c["expr"]) for c in columns if c.get("expr") and c.get("alias") == g), None)
            if col is None:
                hit = next((c for c in columns if c.get("alias") == g and not c.get("agg")), None)
                col = self.resolve(hit.get("table"), hit["field"]) if hit and not self._has(g) else self.resolve(None, g)
            keys[label] = col
        labels = {}
        for c in columns:
            if not c.get("agg") and c["field"] != "*":
                label = c.get("alias") or c["field"]
                if c["field"] in keys and not c.get("expr"):
                    labels[label] = c["field"]
                elif label in keys:
                    labels[label] = label
                else:  # of a joined table: it goes with the key
                    keys[label] = F.expr(c["expr"]) if c.get("expr") else self.resolve(c.get("table"), c["field"])
                    labels[label] = label
        made = df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[c.alias(n) for n, c in aggs.items()]) if aggs else df.select(*[c.alias(n) for n, c in keys.items()]).distinct()
        names = {n: F.col(f"`{n}`") for n in made.columns} | {label: F.col(f"`{k}`") for label, k in labels.items()}

        def output(owner: str | None, name: str) -> Column:
            short = name.split(".")[-1]
            for n in (name, short):
                if n in names:
                    return names[n]
            raise UnknownField(name, names)

        having = self.combined(list(intent.get("having") or []), output)
        if having is not None:
            made = made.where(having)
        made = self._ordered(made, names, only=True)
        listed = [(c.get("alias") or (c["field"] if not c.get("agg") else None) or c["agg"].lower()) if not c.get("agg") or c.get("alias") else (c["agg"].lower() if c["field"] == "*" else f"{c['agg'].lower()}_{c['field']}") for c in columns if c["field"] != "*" or c.get("agg")]
        order = [n for n in listed if n in names] or list(keys)
        order += [n for n in aggs if n not in order]
        made = made.select(*[names[n].alias(n) for n in order])
        return self._cut(made.distinct() if intent.get("distinct") else made)

    def _has(self, name: str) -> bool:
        return any(name in cs for cs in self.fields.values())

    def _ordered(self, df: DataFrame, names: Mapping[str, Column], only: bool = False) -> DataFrame:
        keys = []
        for o in self.intent.get("orderBy") or []:
            if o.get("expr"):
                col = F.expr(o["expr"])
            elif not o.get("table") and o["field"] in names:
                col = names[o["field"]]  # a name of the result wins
            elif only:
                raise UnknownField(o["field"], names)
            else:
                col = self.resolve(o.get("table"), o["field"])
            if self.options.numeric_strings:
                keys.append(sort_key(col.try_cast("double"), o.get("direction"), o.get("nulls")))
            keys.append(sort_key(col, o.get("direction"), o.get("nulls")))
        return df.orderBy(*keys) if keys else df

    def _cut(self, df: DataFrame) -> DataFrame:
        if self.intent.get("offset"):
            df = df.offset(self.intent["offset"])
        return df if self.intent.get("limit") is None else df.limit(self.intent["limit"])
