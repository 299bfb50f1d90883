"""Inserts, updates, upserts and deletes by copy-on-write.

A write computes the new table as a DataFrame; ``Store`` swaps it in for the
old one, so readers see either. Source rows that repeat a key act in input
order, so the last wins; the caller names that order by ``ordinal`` columns.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.catalog import Catalog, TableInfo

SQL_VALUES = {"NOW()": F.current_timestamp, "CURRENT_TIMESTAMP": F.current_timestamp, "CURRENT_DATE": F.current_date}


class WriteError(ValueError):
    pass


class WriteConflict(WriteError):
    """Another writer changed the table in between."""


# --- predicates -------------------------------------------------------------


def build_predicate(where: Mapping[str, Any] | None) -> dict | None:
    """Tree of a column -> value mapping: lists, nulls and scalars, and-ed in order."""
    out = None
    for column, value in (where or {}).items():
        if value is None:
            one = {"kind": "isNull", "column": column}
        elif isinstance(value, (list, tuple)):
            if not value:
                continue
            one = {"kind": "eq", "column": column, "value": value[0]} if len(value) == 1 else {"kind": "any", "column": column, "values": list(value)}
        else:
            one = {"kind": "eq", "column": column, "value": value}
        out = one if out is None else {"kind": "and", "left": out, "right": one}
    return out


def predicate_column(p: Mapping) -> Column:
    kind = p["kind"]
    if kind in ("and", "or"):
        a, b = predicate_column(p["left"]), predicate_column(p["right"])
        return a & b if kind == "and" else a | b
    if kind == "raw":
        return F.expr(p["sql"])
    c = F.col(f"`{p['column']}`")
    if kind == "eq":
        return c.isNull() if p["value"] is None else c == F.lit(p["value"])
    if kind in ("in", "any"):
        return c.isin(list(p["values"])) if p["values"] else F.lit(False)
    if kind == "range":
        return c.between(F.lit(p["min"]), F.lit(p["max"]))
    if kind == "isNull":
        return c.isNull()
    if kind == "notNull":
        return c.isNotNull()
    raise WriteError(f"Unknown predicate: {kind}")


_TEMPLATE = re.compile(r"\{\{\s*([\w.$]+)\s*\}\}")


def static_value(value: Any, rows: DataFrame | None = None) -> Column:
    """A constant, a current time, or ``{{field}}``: that field of the source row."""
    if not isinstance(value, str):
        return F.lit(value)
    if value.upper() in SQL_VALUES:
        return SQL_VALUES[value.upper()]()
    m = _TEMPLATE.fullmatch(value.strip())
    if m is None:
        return F.lit(value)
    if rows is None:
        raise WriteError(f"'{value}' needs source rows")
    _need(rows, [m[1]])
    return F.col(f"`{m[1]}`")


# --- new tables -------------------------------------------------------------


def last_per_key(rows: DataFrame, keys: list[str], ordinal: list[str] | None = None) -> DataFrame:
    """The last row of each key, nulls being a key.

    One max over a struct, combined before the shuffle; without an ordinal the
    largest row wins, which is stable over partitions.
    """
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.dropDuplicates(keys)
    row = F.struct(*[F.col(f"`{c}`") for c in (ordinal or [])], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"))
    return rows.groupBy(*keys).agg(F.max(row).alias("_last")).select(*[F.col(f"`{c}`") if c in keys else F.col(f"_last._row.`{c}`").alias(c) for c in rows.columns])


def _shaped(rows: DataFrame, target: DataFrame, static: Mapping[str, Any], aliases: Mapping[str, str], columns: list[str] | None) -> DataFrame:
    """Source rows in the target's columns: static value, row value or alias, else null."""
    wanted = set(columns) if columns else None
    out = []
    for f in target.schema:
        if f.name in static:
            c = static_value(static[f.name], rows)
        elif f.name in rows.columns and (wanted is None or f.name in wanted):
            c = F.col(f"`{f.name}`")
        elif aliases.get(f.name) in rows.columns:
            c = F.col(f"`{aliases[f.name]}`")
        else:
            c = F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def insert(target: DataFrame, rows: DataFrame, static: Mapping[str, Any] | None = None, aliases: Mapping[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    return target.unionByName(_shaped(rows, target, static or {}, aliases or {}, columns))


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = None
    for k in keys:
        same = a[k].eqNullSafe(b[k])
        cond = same if cond is None else cond & same
    return cond


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], ordinal: list[str] | None = None, **shape) -> DataFrame:
    """Rows whose key is new; of several with one key the first."""
    carry = [c for c in ordinal or [] if c not in target.columns]
    new = _shaped(rows, target, shape.get("static") or {}, shape.get("aliases") or {}, shape.get("columns"))
    if carry:
        new = rows.select(*[c.alias(f"_o{i}") for i, c in enumerate(map(F.col, carry))], *[c for c in _columns_of(rows, target, shape)])
        first = new.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"_o{i}") for i in range(len(carry))], F.struct(*target.columns).alias("_row"))).alias("_f"))
        new = first.select(*[F.col(f"_f._row.`{c}`").alias(c) for c in target.columns])
    else:
        rest = [c for c in target.columns if c not in keys]
        first = new.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in (ordinal or []) if c in target.columns], F.struct(*rest).alias("_row"))).alias("_f")) if rest else new.dropDuplicates(keys)
        new = first.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_f._row.`{c}`").alias(c) for c in target.columns]) if rest else first
    return target.unionByName(new.join(target, _on(new, target, keys), "left_anti"))


def _columns_of(rows: DataFrame, target: DataFrame, shape: Mapping) -> list[Column]:
    static, aliases = shape.get("static") or {}, shape.get("aliases") or {}
    out = []
    for f in target.schema:
        c = static_value(static[f.name], rows) if f.name in static else F.col(f"`{f.name}`") if f.name in rows.columns else F.col(f"`{aliases[f.name]}`") if aliases.get(f.name) in rows.columns else F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return out


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None = None, ordinal: list[str] | None = None, static: Mapping[str, Any] | None = None) -> DataFrame:
    """Insert, or set ``update`` (all other columns of the rows) where the key exists."""
    if not keys:
        raise WriteError("upsert needs conflict columns")
    static = static or {}
    rows = rows.select("*", *[static_value(v, rows).alias(k) for k, v in static.items() if k not in rows.columns])
    given = [c for c in target.columns if c in rows.columns]
    update = [c for c in (update or given) if c not in keys and c in given]
    if not update:
        return insert_ignore(target, rows, keys, ordinal)
    last = last_per_key(rows, keys, ordinal)
    new = _shaped(last, target, {}, {}, None).withColumn("_new", F.lit(True))
    old = target.withColumn("_old", F.lit(True))
    both = old.join(new, _on(old, new, keys), "full")
    cols = []
    for c in target.columns:
        if c in update:
            value = F.when(F.col("_new").isNotNull(), new[c]).otherwise(old[c])
        else:
            value = F.when(F.col("_old").isNotNull(), old[c]).otherwise(new[c])
        cols.append(value.alias(c))
    return both.select(*cols)


def _set(target: DataFrame, hit: Column, values: Mapping[str, Column]) -> DataFrame:
    kinds = {f.name: f.dataType for f in target.schema}
    return target.select(*[F.when(F.coalesce(hit, F.lit(False)), values[c].cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in target.columns])


def update_static(target: DataFrame, values: Mapping[str, Any], where: Mapping | None) -> DataFrame:
    if not where:
        raise WriteError("UPDATE without WHERE is refused")
    return _set(target, predicate_column(where), {c: static_value(v) for c, v in values.items()})


def update_rows(target: DataFrame, rows: DataFrame, keys: list[str], columns: list[str] | None = None, ordinal: list[str] | None = None) -> DataFrame:
    """Each row sets the target rows with its key; of several the last."""
    if not keys:
        raise WriteError("UPDATE without WHERE is refused")
    _need(rows, keys)
    columns = [c for c in (columns or rows.columns) if c in target.columns and c in rows.columns and c not in keys]
    last = last_per_key(rows.select(*dict.fromkeys([*keys, *columns, *(ordinal or [])])), keys, ordinal)
    last = last.select(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys], *[F.col(f"`{c}`").alias(f"_v_{c}") for c in columns], F.lit(True).alias("_hit"))
    cond = None
    for k in keys:
        same = target[k].eqNullSafe(last[f"_k_{k}"])
        cond = same if cond is None else cond & same
    both = target.join(last, cond, "left")
    kinds = {f.name: f.dataType for f in target.schema}
    return both.select(*[F.when(F.col("_hit"), F.col(f"`_v_{c}`").cast(kinds[c])).otherwise(target[c]).alias(c) if c in columns else target[c] for c in target.columns])


def update_any(target: DataFrame, rows: DataFrame, key: str, values: Mapping[str, Any]) -> DataFrame:
    """Set constants where the key is among those of the rows."""
    _need(rows, [key])
    keys = rows.select(F.col(f"`{key}`").alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    both = target.join(keys, target[key] == F.col("_key"), "left")
    return _set_kept(both, target.columns, F.col("_hit").isNotNull(), values, target)


def _set_kept(both: DataFrame, columns: list[str], hit: Column, values: Mapping[str, Any], target: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in target.schema}
    return both.select(*[F.when(hit, static_value(values[c]).cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in columns])


def delete_rows(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a partner; a null key deletes the rows where it is null."""
    if not keys:
        raise WriteError("DELETE without WHERE is refused")
    _need(rows, keys)
    gone = rows.select(*keys).distinct()
    return target.join(gone, _on(target, gone, keys), "left_anti")


def soft_delete(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mark instead of delete, for tables with ``deleted_at``."""
    _need(rows, keys)
    gone = rows.select(*[F.col(f"`{k}`").alias(f"_k_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(True))
    cond = None
    for k in keys:
        same = target[k].eqNullSafe(gone[f"_k_{k}"])
        cond = same if cond is None else cond & same
    both = target.join(gone, cond, "left")
    stamps = {c: "NOW()" for c in ("deleted_at", "updated_at") if c in target.columns}
    return _set_kept(both, target.columns, F.col("_hit").isNotNull(), stamps, target)


def _need(rows: DataFrame, keys: list[str]) -> None:
    for k in keys:
        if k not in rows.columns:
            raise WriteError(f"Column '{k}' not found. Available columns: {', '.join(rows.columns)}")


# --- checks -----------------------------------------------------------------


def coerce_value(value: Any, kind: str, enum: list | None = None) -> Any:
    """A text as a value of a column; raises where it doesn't fit."""
    text = str(value).strip()
    if enum:
        for e in enum:
            if str(e).lower() == text.lower():
                return e
        raise WriteError(f"'{text}' is not one of {', '.join(map(str, enum))}")
    base = kind.upper().split("(")[0]
    if base in ("INT", "BIGINT", "SERIAL", "REAL", "DOUBLE", "NUMERIC", "NUMBER"):
        try:
            return int(text) if base in ("INT", "BIGINT", "SERIAL") else float(text)
        except ValueError:
            raise WriteError(f"'{text}' is not a number") from None
    if base == "BOOLEAN":
        if text.lower() in ("true", "1", "yes"):
            return True
        if text.lower() in ("false", "0", "no"):
            return False
        raise WriteError(f"'{text}' is not a boolean")
    if base in ("DATE", "TIMESTAMP", "TIMESTAMPTZ", "DATETIME"):
        try:
            datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            raise WriteError(f"'{text}' is not a date") from None
    return text


def validate_write(catalog: Catalog, table: str, mode: str, given: set[str], static: Mapping[str, Any]) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a write against the catalog."""
    if table not in catalog.tables:
        return [f"Table '{table}' not found in schema"], []
    info, errors, warnings = catalog.tables[table], [], []
    for c in given | static.keys():
        if c not in info.columns:
            errors.append(f"Column '{c}' not found in table '{table}'")
    for c, v in static.items():
        i = info.columns.get(c)
        if i is None:
            continue
        if v is None:
            if not i.nullable:
                errors.append(f"Column '{c}' must not be null")
            continue
        if isinstance(v, str) and (v.upper() in SQL_VALUES or _TEMPLATE.fullmatch(v.strip())):
            continue
        try:
            coerce_value(v, i.type, i.enum)
        except WriteError as e:
            errors.append(f"Column '{c}': {e}")
    if mode in ("insert", "insert_ignore", "upsert"):
        for c in info.columns.values():
            if c.name not in given and c.name not in static and not c.nullable and c.default is None and c.type != "SERIAL":
                errors.append(f"Required column '{c.name}' is missing")
            elif c.name not in given and c.name not in static and c.nullable:
                warnings.append(f"Optional column '{c.name}' is missing")
    return errors, warnings


def fix_enums(info: TableInfo, static: Mapping[str, Any], repair: bool = False) -> dict[str, Any]:
    """Canonical case of enum values; others raise, or get the default under ``repair``."""
    out = {}
    for c, v in static.items():
        i = info.columns.get(c)
        if i is None or not i.enum or v is None or isinstance(v, str) and _TEMPLATE.fullmatch(v.strip()):
            out[c] = v
            continue
        try:
            out[c] = coerce_value(v, i.type, i.enum)
        except WriteError:
            if not repair:
                raise
            default = (i.default or "").split("::")[0].strip("'")
            if default in map(str, i.enum):
                out[c] = default
            elif not i.nullable:
                out[c] = i.enum[0]
    return out


def injected(info: TableInfo, mode: str, session: Mapping[str, Any]) -> dict[str, Any]:
    """Values a write sets by itself; they override the caller's."""
    out: dict[str, Any] = {}
    have = info.columns.keys()
    if "workspace_id" in have and "workspace_id" in session:
        out["workspace_id"] = session["workspace_id"]
    new = mode in ("insert", "insert_ignore", "upsert")
    people = ("owner_user_id", "created_by", "created_by_user_id", "updated_by", "updated_by_user_id") if new else ("updated_by", "updated_by_user_id")
    out |= {c: session["user_id"] for c in people if c in have and "user_id" in session}
    stamps = ("created_at", "updated_at", "changed_at") if new else ("updated_at",)
    out |= {c: "NOW()" for c in stamps if c in have}
    if info.name == "audit_logs" and "action" in have:
        out["action"] = mode
    return out


def missing_keys(target_refs: Mapping[str, DataFrame], catalog: Catalog, table: str, rows: DataFrame) -> DataFrame:
    """(column, value) of foreign keys in the rows that don't exist."""
    out = None
    for key in catalog.foreign_keys:
        if key.table != table or key.ref_table == table or key.column not in rows.columns or key.ref_table not in target_refs:
            continue
        ref = target_refs[key.ref_table].select(F.col(f"`{key.ref_column}`").alias("_ref"))
        own = rows.select(F.col(f"`{key.column}`").alias("value")).where("value IS NOT NULL").distinct()
        gone = own.join(ref, own["value"] == ref["_ref"], "left_anti").select(F.lit(key.column).alias("column"), F.col("value").cast("string").alias("value"))
        out = gone if out is None else out.unionByName(gone)
    return out if out is not None else rows.sparkSession.createDataFrame([], "column string, value string")


def key_aliases(catalog: Catalog, table: str, rows: DataFrame, static: Mapping[str, Any]) -> dict[str, str]:
    """Foreign key columns that the rows lack -> the referenced column that they have."""
    out = {}
    for column, (ref, ref_column) in catalog.write_columns(table).items():
        if column in rows.columns or column in static:
            continue
        names = [ref_column] if ref_column != "id" else [f"{ref}_id", f"{ref.removesuffix('s')}_id", "id"]
        hit = next((n for n in names if n in rows.columns and (n == ref_column or n not in catalog.tables[table].columns)), None)
        if hit is not None:
            out[column] = hit
    return out


def resolve_keys(rows: DataFrame, column: str, ref: DataFrame, ref_key: str, name: str) -> DataFrame:
    """The rows with names in a foreign key column replaced by the referenced key.

    Numbers stay; a name is looked up in the other source without regard to case,
    the smallest key of several; a name that isn't there becomes null.
    """
    low = F.lower(F.trim(F.col(f"`{column}`").cast("string")))
    found = ref.groupBy(F.lower(F.trim(F.col(f"`{name}`"))).alias("_name")).agg(F.min(F.col(f"`{ref_key}`")).alias("_key"))
    kind = ref.schema[ref_key].dataType
    both = rows.join(found, (low == F.col("_name")) & ~low.rlike(r"^-?\d+$"), "left")
    value = F.when(low.rlike(r"^-?\d+$"), F.col(f"`{column}`").cast(kind)).otherwise(F.col("_key"))
    return both.select(*[value.alias(c) if c == column else F.col(f"`{c}`") for c in rows.columns])


#: Tables whose repeated inserts a caller may want ignored.
LOG_TABLE = re.compile(r"_log|_audit|notification")


# --- the store --------------------------------------------------------------


class Store:
    """Tables as parquet folders under a path, each version in a folder of its own.

    The highest version is current. A writer stages its version, claims the next
    number by creating a file that may not exist, and renames the staged folder to
    it: readers see the old version whole or the new one whole. A writer whose table
    changed since it read it fails. The last ``KEEP`` versions stay for readers that
    still use them.
    """

    KEEP = 2

    def __init__(self, spark: SparkSession, path: str, catalog: Catalog | None = None, session: Mapping[str, Any] | None = None, cursor: Any = None):
        """With a ``catalog``, writes are completed and checked against it; values of
        ``session`` are set; ``cursor`` gives the rows of a write without input."""
        self.spark, self.path = spark, path.rstrip("/")
        self.catalog, self.session, self.cursor = catalog, session or {}, cursor
        self.warnings: list[str] = []
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _numbers(self, table: str, kind: str) -> list[int]:
        at = self._path(table)
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[0] == kind and n[1:].isdigit())

    def version(self, table: str) -> int:
        """The current version; 0 is none."""
        return max(self._numbers(table, "v"), default=0)

    def exists(self, table: str) -> bool:
        return self.version(table) > 0

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        now = self.version(table)
        if not now:
            raise WriteError(f"Table '{table}' does not exist")
        return self.spark.read.parquet(f"{self.path}/{table}/v{now:012d}")

    def replace(self, table: str, df: DataFrame, base: int | None = None) -> int:
        """Make ``df`` the table's next version, if it is still at ``base``."""
        staged = f"s-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{table}/{staged}")
        number = max([0, *self._numbers(table, "v"), *self._numbers(table, "c")]) + 1
        claimed = self._fs.createNewFile(self._path(table, f"c{number:012d}"))
        if not claimed or base is not None and self.version(table) != base:
            self._fs.delete(self._path(table, staged), True)
            raise WriteConflict(f"Table '{table}' was changed by another writer")
        if not self._fs.rename(self._path(table, staged), self._path(table, f"v{number:012d}")):
            raise WriteError(f"Version {number} of '{table}' could not be put in place")
        for n in self._numbers(table, "v")[: -self.KEEP]:
            self._fs.delete(self._path(table, f"v{n:012d}"), True)
        for n in self._numbers(table, "c")[:-1]:
            self._fs.delete(self._path(table, f"c{n:012d}"), False)
        return number

    def _staged(self, rows: DataFrame) -> DataFrame:
        """The rows, fixed: the write and its count see the same ones."""
        path = f"{self.path}/_rows/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def prepared(self, payload: Mapping, rows: DataFrame | None) -> dict:
        """The payload with what the catalog and the session say: log tables, enum
        values, immutable columns, set values, key aliases; raises where it is wrong."""
        out = dict(payload)
        table, mode = out["table"], out["mode"]
        if mode == "insert" and out.get("ignoreLogRepeats") and LOG_TABLE.search(table):
            mode = out["mode"] = "insert_ignore"
        if self.catalog is None:
            return out
        info = self.catalog.require(table)
        static = fix_enums(info, out.get("staticValues") or {}, bool(out.get("repair")))
        if mode == "update":
            from weftline.plans.ddl import immutable_columns

            fixed = immutable_columns(info) - set(out.get("whereColumns") or [])
            static = {c: v for c, v in static.items() if c not in fixed}
            if out.get("columns"):
                out["columns"] = [c for c in out["columns"] if c not in fixed]
            elif rows is not None:
                out["columns"] = [c for c in rows.columns if c in info.columns and c not in fixed]
        if mode != "delete":
            static |= injected(info, "insert" if mode == "insert_ignore" else mode, self.session)
        given: set[str] = set()
        if rows is not None and mode != "delete":
            if mode != "update":
                out["columnAliases"] = key_aliases(self.catalog, table, rows, static) | dict(out.get("columnAliases") or {})
            aliased = {c for c, a in (out.get("columnAliases") or {}).items() if a in rows.columns}
            wanted = out.get("columns") or [c for c in rows.columns if c in info.columns]
            for c in wanted:
                if c not in rows.columns and c not in aliased and c not in static:
                    self.warnings.append(f"Column '{c}' can't be resolved and is left out")
            given = {c for c in wanted if c in rows.columns} | aliased
            if out.get("columns"):
                out["columns"] = [c for c in wanted if c in given or c in static]
        errors, warnings = validate_write(self.catalog, table, mode, given, static) if mode != "delete" else ([], [])
        self.warnings += warnings
        if errors:
            raise WriteError("; ".join(errors))
        out["staticValues"] = static
        return out

    def apply(self, payload: Mapping, rows: DataFrame | None, ordinal: list[str] | None = None) -> DataFrame:
        """Run a write payload; the result is its summary, or the rows of an insert."""
        rows = None if rows is None else self._staged(rows)
        payload = self.prepared(payload, rows)
        table, mode = payload["table"], payload["mode"]
        base = self.version(table)
        target = self.load(self.spark, table)
        static = dict(payload.get("staticValues") or {})
        where = payload.get("wherePredicate") or build_predicate(payload.get("staticWhere"))
        keys = list(payload.get("whereColumns") or [])
        if mode in ("update", "delete") and where is None and keys and self.cursor is not None and (rows is None or rows.isEmpty()):
            # No input: the rows of the session's last result, which then is used up.
            rows = target.where(self.cursor.where()).select(*keys).distinct()
            rows = self._staged(rows)
            self.cursor.clear()
        if mode == "delete" and "deleted_at" in target.columns:
            if where is not None:
                stamps = {c: "NOW()" for c in ("deleted_at", "updated_at") if c in target.columns}
                new, hit = update_static(target, stamps, where), target.where(predicate_column(where))
            else:
                new, hit = soft_delete(target, rows, keys), _hit(target, rows, keys)
        elif mode == "delete":
            if where is not None:
                hit, new = target.where(predicate_column(where)), target.where(~F.coalesce(predicate_column(where), F.lit(False)))
            else:
                new, hit = delete_rows(target, rows, keys), _hit(target, rows, keys)
        elif mode == "update":
            if where is not None:
                new, hit = update_static(target, static, where), target.where(predicate_column(where))
            elif rows is not None and static and not any(isinstance(v, str) and _TEMPLATE.fullmatch(v.strip()) for v in static.values()) and not [c for c in rows.columns if c in (payload.get("columns") or []) and c not in keys]:
                if not keys:
                    raise WriteError("UPDATE without WHERE is refused")
                new, hit = update_any(target, rows, keys[0], static), _hit(target, rows, keys[:1])
            else:
                if rows is None:
                    raise WriteError("UPDATE without WHERE is refused")
                given = rows.select("*", *[static_value(v, rows).alias(k) for k, v in static.items() if k not in rows.columns])
                columns = [*(payload.get("columns") or []), *static] or None
                new, hit = update_rows(target, given, keys, columns, ordinal), _hit(target, rows, keys)
        else:
            if rows is None:
                rows = self.spark.range(1).drop("id")
            aliases, columns = payload.get("columnAliases") or {}, payload.get("columns")
            if mode == "insert":
                new = insert(target, rows, static, aliases, columns)
            elif mode == "insert_ignore":
                new = insert_ignore(target, rows, list(payload.get("conflictColumns") or []), ordinal, static=static, aliases=aliases, columns=columns)
            elif mode == "upsert":
                new = upsert(target, rows, list(payload.get("conflictColumns") or []), payload.get("updateColumns"), ordinal, static)
            else:
                raise WriteError(f"Unknown write mode: {mode}")
            self.replace(table, new, base)
            return rows
        n = hit.count()
        self.replace(table, new, base)
        shown = json.dumps(where if where is not None else {"keys": keys}, default=str)
        return self.spark.createDataFrame([(table, mode, n, shown, json.dumps(static, default=str))], "table string, operation string, rows_affected long, where string, set string")


def _hit(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    _need(rows, keys)
    own = rows.select(*keys).distinct()
    return target.join(own, _on(target, own, keys), "left_semi")
