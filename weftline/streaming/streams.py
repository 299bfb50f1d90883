"""Transforms and windowed aggregates over streams.

The row-wise transform operations compile to the same Columns for a stream as
for a table. Aggregates need an event time and a watermark, which bounds their
state; late rows beyond it are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.transform import apply_operations
from weftline.plans.expressions import aggregate

ROW_WISE = {"addField", "removeField", "renameField", "castField", "filterRows"}


def read_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(format).schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).load(path)


def transform_stream(df: DataFrame, operations: list[Mapping], **more) -> DataFrame:
    """Row-wise operations on a stream; others raise before it starts."""
    for o in operations:
        if o["kind"] not in ROW_WISE:
            raise ValueError(f"{o['kind']} needs all rows: it can't run on a stream")
    return apply_operations(df, operations, **more)


def windowed(df: DataFrame, time: str, length: str, keys: list[str], aggregations: list[Mapping], late: str, slide: str | None = None) -> DataFrame:
    """Aggregates by event-time window, for streams and tables alike."""
    df = df.withWatermark(time, late) if df.isStreaming else df
    w = F.window(time, length, slide) if slide else F.window(time, length)
    made = [aggregate(a["fn"], F.lit(1) if a.get("expr", "*") == "*" else F.expr(a["expr"]), star=a.get("expr", "*") == "*").alias(a["alias"]) for a in aggregations]
    out = df.groupBy(w.alias("w"), *keys).agg(*made)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[a["alias"] for a in aggregations])


def sink(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch to ``write(batch, id)``; a batch may
    come again after a failure, with the same id."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
