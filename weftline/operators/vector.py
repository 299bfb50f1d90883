"""Similarity look-ups over embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in the JVM; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def topk(df: DataFrame, query: list[float], k: int = 1, column: str = "embedding", threshold: float | None = None, where: Column | None = None, tie: str | None = None) -> DataFrame:
    """The k most similar rows with their similarity, at ``threshold`` or above."""
    df = df if where is None else df.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    df = df.withColumn("similarity", cosine(F.col(column), q))
    if threshold is not None:
        df = df.where(F.col("similarity") >= threshold)
    keys = [F.col("similarity").desc_nulls_last()] + ([F.col(tie).asc()] if tie else [])
    return df.orderBy(*keys).limit(k)


class SemanticCache:
    """Plans by the embedding of their question, in a table of the caller's."""

    THRESHOLD = 0.92

    def __init__(self, entries: DataFrame):
        """Columns: id, workspace, source_type, sources array, embedding, valid, hits, plan."""
        self.entries = entries

    def lookup(self, query: list[float], workspace, source_type: str, threshold: float = THRESHOLD) -> DataFrame:
        where = F.col("valid") & (F.col("workspace") == workspace) & (F.col("source_type") == source_type)
        return topk(self.entries, query, 1, threshold=threshold, where=where, tie="id")

    def invalidate(self, sources: list[str] | None = None) -> DataFrame:
        """Entries with those of the sources, or all, no longer valid."""
        hit = F.lit(True) if sources is None else F.arrays_overlap("sources", F.array(*[F.lit(s) for s in sources]))
        return self.entries.withColumn("valid", F.col("valid") & ~F.coalesce(hit, F.lit(False)))

    def stats(self) -> DataFrame:
        return self.entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if("valid").alias("valid"), F.sum("hits").alias("hits"))

    def top(self, n: int = 5) -> DataFrame:
        return self.entries.orderBy(F.desc_nulls_last("hits"), "id").limit(n)
