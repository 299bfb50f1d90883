"""Row transforms and merges of tables.

Order matters for "first" rows: ``dedup`` and ``limit`` follow the last sort.
A DataFrame has no order of its own, so ``Ordered`` carries the sort keys.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import FunctionRegistry
from weftline.plans.expressions import Compiler, cast, columns_resolver, sort_key
from weftline.plans.options import DEFAULT, Options


def apply_operations(
    df: DataFrame,
    operations: list[Mapping],
    scope: Mapping[str, Any] | None = None,
    functions: FunctionRegistry | None = None,
    options: Options = DEFAULT,
    order: list[Column] | None = None,
) -> DataFrame:
    """All operations in turn, as one lazy plan.

    ``order`` says which row is first before any sort; without one, dedup keeps
    the first in the order of all columns, so results don't depend on partitions.
    """
    operations = list(operations)
    for n, o in enumerate(operations):
        compile_ = Compiler(columns_resolver(df.columns), scope, functions, options)
        kind = o["kind"]
        if kind == "addField":
            df = df.withColumn(o["name"], compile_(o["expr"]))
        elif kind == "removeField":
            df = df.drop(o["name"])
        elif kind == "renameField":
            if o["from"] in df.columns:
                df = df.withColumnRenamed(o["from"], o["to"])
        elif kind == "castField":
            if o["name"] in df.columns:
                df = df.withColumn(o["name"], cast(F.col(f"`{o['name']}`"), o["to"], options))
        elif kind == "filterRows":
            df = df.where(compile_(o["predicate"]))
        elif kind == "sortRows":
            order = [sort_key(compile_(k["expr"]), k.get("direction", "ASC"), k.get("nulls"), "FIRST" if k.get("direction") == "DESC" else "LAST") for k in o["keys"]]
            if not (n + 1 < len(operations) and operations[n + 1]["kind"] == "dedup"):  # a dedup deals the rows anew
                df = df.orderBy(*order)
        elif kind == "dedup":
            df = dedup(df, o["on"], order)
        elif kind == "limit":
            df = df.limit(o["count"])
        else:
            raise ValueError(f"Unknown transform: {kind}")
    return df


def dedup(df: DataFrame, on: list[str], order: list[Column] | None = None) -> DataFrame:
    """The first row of each key; nulls are a key.

    A minimum over row structs is combined before the shuffle, so a hot key
    costs one row a task. Only an order that a struct can't express (descending,
    nulls) needs a window.
    """
    if order is None:
        rest = [c for c in df.columns if c not in on]
        kinds = dict(df.dtypes)
        if all("map<" not in kinds[c] for c in rest):
            if not rest:
                return df.dropDuplicates(on)
            # Nulls last, as in a sort: a flag stands before each value.
            row = F.struct(*[x for c in rest for x in (F.col(f"`{c}`").isNull().alias(f"_n_{c}"), F.col(f"`{c}`"))])
            best = df.groupBy(*on).agg(F.min(row).alias("_first"))
            return best.select(*[F.col(f"`{c}`") if c in on else F.col("_first").getField(c).alias(c) for c in df.columns])
        order = [F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) for c in rest])]
    w = Window.partitionBy(*on).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, repeats included; ragged schemas are filled with nulls."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_join(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Inner join of all inputs; nulls match, values of later inputs win."""
    out = frames[0]
    for right in frames[1:]:
        kinds, others = dict(out.dtypes), dict(right.dtypes)
        text = [c for c in on if kinds[c] != others[c]]
        key = lambda side, c: side[c].cast("string") if c in text else side[c]
        left, r = out.alias("l"), right.alias("r")
        cond = None
        for c in on:
            same = key(out, c).eqNullSafe(key(right, c))
            cond = same if cond is None else cond & same
        joined = left.join(r, cond, "inner")
        cols = [F.col(f"r.`{c}`") if c in right.columns else F.col(f"l.`{c}`") for c in out.columns]
        cols += [F.col(f"r.`{c}`") for c in right.columns if c not in out.columns]
        out = joined.select(*cols)
    return out


def merge(strategy: str, frames: list[DataFrame], on: list[str] | None = None) -> DataFrame:
    if not frames:
        raise ValueError("merge needs an input")
    if strategy == "union":
        return union_all(frames)
    if strategy == "join":
        if not on:
            raise ValueError("merge by join needs joinOn")
        return merge_join(frames, on)
    if strategy in ("first", "last"):
        return frames[0 if strategy == "first" else -1]
    raise ValueError(f"Unknown merge strategy: {strategy}")


def first_rows(frames: list[tuple[DataFrame, bool]]) -> DataFrame:
    """One row of the first rows of several inputs; those flagged as query
    results win over others."""
    ordered = [f for f, q in frames if not q] + [f for f, q in frames if q]
    owner = {c: i for i, f in enumerate(ordered) for c in f.columns}
    out = None
    for i, f in enumerate(ordered):
        own = [c for c in f.columns if owner[c] == i]
        if own:
            one = f.limit(1).select(*[F.col(f"`{c}`") for c in own])
            out = one if out is None else out.crossJoin(one)  # one row each
    return out
