"""Nested JSON text to flat columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_value(value, depth: int = 6) -> dict[str, str | None]:
    """Leaves by dotted path: lists of scalars joined by commas, lists of
    objects indexed, what is deeper than ``depth`` as JSON text."""
    out: dict[str, str | None] = {}

    def text(v) -> str | None:
        return v if isinstance(v, str) or v is None else json.dumps(v) if not isinstance(v, float) or v != int(v) else str(int(v))

    def walk(v, path: str, left: int) -> None:
        if isinstance(v, dict) and left > 0:
            for k, x in v.items():
                walk(x, f"{path}.{k}" if path else k, left - 1)
        elif isinstance(v, list):
            if any(isinstance(x, dict) for x in v) and left > 0:
                for i, x in enumerate(v):
                    walk(x, f"{path}[{i}]", left - 1)
            else:
                out[path] = ",".join(text(x) or "" for x in v)
        else:
            out[path] = text(v)

    walk(value, "", depth)
    return out


def json_flatten(col: Column, depth: int = 6) -> Column:
    """map<string,string> of the leaves of a JSON text; bad or null text gives null.

    For texts of any shape; where the shape is known, ``flatten_struct`` stays
    in the JVM.
    """

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                v = json.loads(t) if t is not None else None
            except ValueError:
                return None
            return flatten_value(v, depth) if isinstance(v, dict) else None

        return texts.map(one)

    return run(col)


def flatten_struct(df: DataFrame, depth: int = 6) -> DataFrame:
    """Struct columns as columns named by dotted path, arrays of scalars joined."""

    def walk(kind: T.DataType, col: Column, name: str, left: int) -> list[Column]:
        if isinstance(kind, T.StructType) and left > 0:
            return [c for f in kind for c in walk(f.dataType, col.getField(f.name), f"{name}.{f.name}", left - 1)]
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return [F.array_join(col.cast("array<string>"), ",").alias(name)]
        return [col.alias(name)]

    return df.select(*[c for f in df.schema for c in walk(f.dataType, F.col(f"`{f.name}`"), f.name, depth)])


def json_alias(df: DataFrame, fields: list[dict]) -> DataFrame:
    """Rename source keys (jsonPath, else apiFieldName, else name) to names."""
    for f in fields:
        source = f.get("jsonPath") or f.get("apiFieldName") or f["name"]
        if source != f["name"] and source in df.columns:
            df = df.withColumnRenamed(source, f["name"])
    return df


def json_array_root(col: Column, path: str | None, element: T.DataType | str) -> Column:
    """Elements at a dotted path of a JSON text: a scalar is a list of one,
    a missing path an empty list."""
    root = "$" + "".join(f".{p}" for p in (path or "").split(".") if p)
    at = F.get_json_object(col, root)
    kind = element if isinstance(element, str) else element.simpleString()
    many = F.from_json(at, f"array<{kind}>")
    # A JSON list starts with a bracket; other values count as one element.
    single = F.array(F.from_json(at, element)) if isinstance(element, T.StructType) or kind.startswith("struct") else F.array(at.cast(kind))
    return F.when(at.isNull(), F.array().cast(f"array<{kind}>")).when(F.ltrim(at).startswith("["), many).otherwise(single)
