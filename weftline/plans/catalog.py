"""Tables, keys and the ways between them; access grants."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NoJoinPath(ValueError):
    def __init__(self, a: str, b: str):
        super().__init__(f"No join path between '{a}' and '{b}'")


class AccessDenied(PermissionError):
    pass


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    ref_table: str
    ref_column: str
    on_delete: str | None = None


@dataclass
class ColumnInfo:
    name: str
    type: str = "any"
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    default: str | None = None
    check: dict | None = None

    @property
    def enum(self) -> list | None:
        return self.check["values"] if self.check and self.check["kind"] == "enum" else None


@dataclass
class TableInfo:
    name: str
    columns: dict[str, ColumnInfo]
    primary_key: list[str] = field(default_factory=list)
    source: str = "default"


@dataclass
class Catalog:
    tables: dict[str, TableInfo] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    version: int = 1

    @classmethod
    def of_frames(cls, frames: dict[str, DataFrame], foreign_keys: Iterable[ForeignKey] = ()) -> Catalog:
        """Real types from the DataFrames' own schemas."""
        tables = {n: TableInfo(n, {f.name: ColumnInfo(f.name, f.dataType.simpleString(), f.nullable) for f in d.schema}) for n, d in frames.items()}
        return cls(tables, list(foreign_keys))

    def require(self, table: str) -> TableInfo:
        if table not in self.tables:
            raise ValueError(f"Table '{table}' not found in schema")
        return self.tables[table]

    def neighbours(self, table: str) -> list[tuple[str, ForeignKey]]:
        out = []
        for k in self.foreign_keys:
            if k.table == table:
                out.append((k.ref_table, k))
            elif k.ref_table == table:
                out.append((k.table, k))
        return out

    def path(self, start: str, goal: str) -> list[ForeignKey]:
        """Shortest chain of keys, used in either direction."""
        came: dict[str, tuple[str, ForeignKey]] = {}
        seen, todo = {start}, deque([start])
        while todo:
            t = todo.popleft()
            if t == goal:
                way = []
                while t != start:
                    t, key = came[t]
                    way.append(key)
                return way[::-1]
            for n, key in self.neighbours(t):
                if n not in seen and n in self.tables:
                    seen.add(n)
                    came[n] = (t, key)
                    todo.append(n)
        raise NoJoinPath(start, goal)

    def related(self, table: str) -> list[str]:
        """Tables that share a key with this one."""
        return list(dict.fromkeys(n for n, _ in self.neighbours(table)))

    def write_columns(self, table: str) -> dict[str, tuple[str, str]]:
        """Column of the table -> (table, column) that its foreign key names."""
        return {k.column: (k.ref_table, k.ref_column) for k in self.foreign_keys if k.table == table}

    def reachable(self, table: str, hops: int = 3) -> dict[str, int]:
        """Tables within so many keys, with their distance."""
        far, todo = {table: 0}, deque([table])
        while todo:
            t = todo.popleft()
            if far[t] < hops:
                for n, _ in self.neighbours(t):
                    if n not in far:
                        far[n] = far[t] + 1
                        todo.append(n)
        del far[table]
        return far

    def merge(self, other: Catalog, source: str, cross_keys: Iterable[ForeignKey] = (), namespace: bool = False) -> Catalog:
        """Both catalogs; names that clash are prefixed by the source, or the later wins."""
        rename = {n: f"{source}.{n}" if namespace and n in self.tables else n for n in other.tables}
        tables = dict(self.tables) | {rename[n]: replace(t, name=rename[n], source=source) for n, t in other.tables.items()}
        keys = self.foreign_keys + [replace(k, table=rename.get(k.table, k.table), ref_table=rename.get(k.ref_table, k.ref_table)) for k in other.foreign_keys]
        return Catalog(tables, keys + list(cross_keys), self.version)


@dataclass
class Grants:
    """Readable tables, and columns where they are narrowed."""

    tables: set[str]
    columns: dict[str, set[str]] = field(default_factory=dict)
    writable: set[str] = field(default_factory=set)

    def catalog(self, full: Catalog) -> Catalog:
        tables = {}
        for n in self.tables & full.tables.keys():
            t = full.tables[n]
            keep = self.columns.get(n)
            tables[n] = replace(t, columns={c: i for c, i in t.columns.items() if keep is None or c in keep})
        return Catalog(tables, [k for k in full.foreign_keys if k.table in tables and k.ref_table in tables], full.version)

    def frame(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.tables:
            raise AccessDenied(f"No read access to '{name}'")
        keep = self.columns.get(name)
        return df if keep is None else df.select(*[c for c in df.columns if c in keep])

    def check_joins(self, full: Catalog, tables: list[str]) -> None:
        """Every table on the ways between the tables must be granted; it fails closed."""
        for a, b in zip(tables, tables[1:]):
            for key in full.path(a, b):
                for t in (key.table, key.ref_table):
                    if t not in self.tables:
                        raise AccessDenied(f"The join of '{a}' and '{b}' needs '{t}', which isn't granted")

    def check_write(self, table: str) -> None:
        if table not in self.writable:
            raise AccessDenied(f"No write access to '{table}'")

    def check_text(self, full: Catalog, text: str) -> None:
        """No word of a text (SQL, or a request) may name a table that isn't granted."""
        words = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", text)}
        for t in full.tables.keys() - self.tables:
            if t.lower() in words:
                raise AccessDenied(f"No read access to '{t}'")

    def check_query(self, intent: Mapping, full: Catalog | None = None) -> None:
        """Tables, joins, expressions and subquery texts of an intent."""
        tables = [intent["table"], *[j["table"] for j in intent.get("joins") or []]]
        for t in tables:
            if t not in self.tables:
                raise AccessDenied(f"No read access to '{t}'")
        if full is None:
            return
        bare = [j["table"] for j in intent.get("joins") or [] if not j.get("on")]
        for t in bare:
            self.check_joins(full, [intent["table"], t])
        texts = [f.get("value") for f in intent.get("filters") or [] if isinstance(f.get("value"), str) and "select" in f["value"].lower()]
        for part in ("columns", "filters", "orderBy"):
            texts += [x["expr"] for x in intent.get(part) or [] if isinstance(x.get("expr"), str)]
        for text in texts:
            self.check_text(full, text)

    def check_payload(self, payload: Mapping) -> None:
        """Table and columns of a write."""
        table = payload["table"]
        self.check_write(table)
        keep = self.columns.get(table)
        given = [*(payload.get("columns") or []), *(payload.get("staticValues") or {}), *(payload.get("staticWhere") or {}), *(payload.get("whereColumns") or [])]
        for c in given:
            if keep is not None and c not in keep:
                raise AccessDenied(f"No access to column '{c}' of '{table}'")

    def check_expression(self, table: str, tree) -> None:
        from weftline.plans.expressions import references

        for t, name in references(tree):
            keep = self.columns.get(t or table)
            if keep is not None and name not in keep:
                raise AccessDenied(f"No access to column '{name}' of '{t or table}'")


class Sources:
    """Named loaders of tables, each a source of DataFrames."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def register(self, name: str, loader: Callable[[SparkSession, str], DataFrame]) -> None:
        if name in self._loaders:
            raise ValueError(f"Data source already registered: {name}")
        self._loaders[name] = loader

    def load(self, spark: SparkSession, table: str, source: str = "default") -> DataFrame:
        if source not in self._loaders:
            raise ValueError(f"Unknown data source: {source}")
        return self._loaders[source](spark, table)


class AuditLog:
    """An append-only log of accesses as a table."""

    SCHEMA = "at timestamp, user string, action string, resource string, allowed boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, user: str, action: str, resource: str, allowed: bool) -> None:
        row = self.spark.createDataFrame([(user, action, resource, allowed)], "user string, action string, resource string, allowed boolean")
        row.select(F.current_timestamp().alias("at"), "*").write.mode("append").parquet(self.path)

    def read(self, **where: str) -> DataFrame:
        df = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        for k, v in where.items():
            df = df.where(F.col(k) == v)
        return df
