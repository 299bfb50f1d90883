"""Loaders of tables. A loader maps (spark, table) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Loader = Callable[[SparkSession, str], DataFrame]


def parquet_folder(path: str) -> Loader:
    """Tables as ``path/name.parquet``."""
    return lambda spark, name: spark.read.parquet(f"{path}/{name}.parquet")


def files(path: str, format: str, schema: T.StructType | str | None = None, **options: str) -> Loader:
    """Tables as ``path/name`` in any file format that Spark reads."""

    def load(spark: SparkSession, name: str) -> DataFrame:
        r = spark.read.format(format).options(**options)
        return (r.schema(schema) if schema is not None else r).load(f"{path}/{name}")

    return load


def views() -> Loader:
    """Tables and views of the session's catalog."""
    return lambda spark, name: spark.table(name)


def jdbc(url: str, partition: dict[str, tuple[str, int, int, int]] | None = None, fetchsize: int = 10_000, **options: str) -> Loader:
    """Tables of a database; ``partition`` names (column, lower, upper, parts)
    for tables that are read in parallel."""

    def load(spark: SparkSession, name: str) -> DataFrame:
        r = spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize=fetchsize, **options)
        if partition and name in partition:
            column, low, high, parts = partition[name]
            r = r.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        return r.load()

    return load


def static(frames: dict[str, DataFrame]) -> Loader:
    """Tables held by the caller, as in tests."""
    return lambda spark, name: frames[name]


def sql(spark: SparkSession, text: str, **params) -> DataFrame:
    """Raw SQL with named parameters, never with values in the text."""
    return spark.sql(text, args=params)


def schema_of(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema]


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


TEMP_PREFIX = "tmp_"


def create_temp(df: DataFrame, name: str) -> str:
    """A view of the session under a name with the prefix for such tables."""
    name = name if name.startswith(TEMP_PREFIX) else TEMP_PREFIX + name
    df.createOrReplaceTempView(name)
    return name


def drop_temp(spark: SparkSession, name: str) -> bool:
    """Drop a view of ``create_temp``; other tables are refused."""
    if not name.startswith(TEMP_PREFIX):
        raise ValueError(f"'{name}' is no temporary table")
    return spark.catalog.dropTempView(name)
