"""Helpers shared by the corpus operators: tables, shared storage, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_FALLBACK: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a dataset folder through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster, and must be set there. In
    local mode (tests) a temporary folder is made where it isn't set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
    return _LOCAL_FALLBACK[app]


def materialize(spark: SparkSession, df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader over it.

    The written table cuts lineage, survives the loss of any executor and lets
    several later jobs read a result that is computed only once.
    """
    path = f"{shared_dir(spark)}/weftline/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables once all that read them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def byte_text(col: str = "text") -> F.Column:
    """Text as UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8")


def map_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | list[pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """``mapInArrow`` with a function of one batch that yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def chunked(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Split rows 0..n into runs whose lengths sum to about ``limit``."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def rename_clashes(df: DataFrame, reserved: set[str]) -> DataFrame:
    """Prefix caller columns that collide with the columns an operator adds."""
    low = {r.lower() for r in reserved}
    for name in df.columns:
        if name.lower() in low:
            new = f"in_{name}"
            while new in df.columns:
                new = f"in_{new}"
            df = df.withColumnRenamed(name, new)
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name
