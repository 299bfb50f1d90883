"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, pairs of words, and a word said
five times in a row), each counting the documents that hold one: the target's,
from labelled good text, and the raw corpus's, over all documents. The log ratio
of the two, summed over a document's distinct n-grams, is its log weight;
documents are drawn without replacement by Gumbel top-k on log weight divided by
``TEMPERATURE``.

With c_j the count of n-gram j in the target sample, E_j what the raw model
expects in a sample of that size, and s = ``PSEUDO``, its log ratio is
log((c_j + s) / (E_j + s)). A ratio is known as well as its counts allow, so it is
shrunk by z^4 / (z^4 + L^4), with z = (c_j - E_j) / sqrt(E_j + s) and L =
``SHRINK``, larger for pairs, of which there are many more. No n-gram is left out:
what a count can't tell apart from chance weighs next to nothing, at any number
of documents and labels. Weights under ``LEAST`` are rounded to zero.

Counts and scores cover all documents and whole texts. Only what is fitted on
labels has a bound: at most ``max_labels`` rows, those with the smallest hash of
their id. A target row is scored without its own count when the cut is chosen, as
rows outside the sample are. k isn't a constant: it is the number of documents
whose log weight reaches the cut that separates the labelled rows best, so it
follows the corpus.

Defined cases: null and empty texts have log weight 0; without labels of both
classes all weights and the cut are 0; a labelled doc_id that several rows have
is fitted on the smallest text; ties at the k-th key are all selected; repeated
rows each get a result row; empty tables give empty results; other columns are
ignored by ``score`` and kept by ``keep_selected``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import discard, free_name, materialize

#: Buckets of words, and as many of pairs.
BUCKETS = 1 << 20
RUN = 2 * BUCKETS
PSEUDO = 1.0
SHRINK = {"word": 3.0, "pair": 7.0}
LEAST = 0.01
MAX_LABELS = 20_000
TEMPERATURE = 0.25
SEED = 11

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def ngram_buckets(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's n-grams."""
    words = _TOKEN.findall(text.lower()) if text else ()
    if not words:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    a, b = one[:-1], one[1:]
    two = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = [one >> np.uint64(44), (two >> np.uint64(44)) + np.uint64(BUCKETS)]
    same = a == b
    if len(same) > 3 and (same[3:] & same[2:-1] & same[1:-2] & same[:-3]).any():
        at.append(np.array([RUN], np.uint64))
    return np.unique(np.concatenate(at)).astype(np.int64)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(bucket, n): documents that hold an n-gram; a vector a task, then sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RUN + 1, np.int32)
        for b in batches:
            for text in b.column(0).to_pylist():
                total[ngram_buckets(text)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _weight(c: F.Column, e: F.Column) -> F.Column:
    limit = F.when(F.col("bucket").between(BUCKETS, RUN - 1), SHRINK["pair"] ** 4).otherwise(SHRINK["word"] ** 4)
    z4 = F.pow((c - e) / F.sqrt(e + PSEUDO), 4)
    w = F.log((c + PSEUDO) / (e + PSEUDO)) * z4 / (z4 + limit)
    return F.when(F.abs(w) >= LEAST, w).otherwise(0.0)


class Fit:
    """Weights by bucket, those for rows of the target sample, and the cut."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, own: np.ndarray, cut: float = 0.0):
        self.at, self.weight, self.own, self.cut = at, weight, own, cut


def weights(spark: SparkSession, docs: DataFrame, known: DataFrame) -> Fit:
    """Weights of all buckets where they aren't zero, without a cut.

    The counts of all buckets stay on the executors.
    """
    n_good, n_bad = known.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not n_good or not n_bad:
        return Fit(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    raw = materialize(spark, count_ngrams(docs), "raw-ngrams")
    target = materialize(spark, count_ngrams(known.where("good")).withColumnRenamed("n", "c"), "target-ngrams")
    c, e = F.coalesce("c", F.lit(0)), F.col("n") * (n_good / max(1, docs.count()))
    rows = raw.join(target, "bucket", "left").select("bucket", _weight(c, e).alias("w"), _weight(F.greatest(c - 1, F.lit(0)), e).alias("own"))
    rows = rows.where("w <> 0 or own <> 0").toPandas()  # at most the buckets of a bounded sample and of frequent n-grams
    discard(raw, target)
    return Fit(*(rows[x].to_numpy(k) for x, k in (("bucket", np.int64), ("w", np.float64), ("own", np.float64))))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """Cut between log weights with the highest balanced accuracy."""
    n_good, n_bad = int(good.sum()), int((~good).sum())
    if not n_good or not n_bad:
        return 0.0
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # Below the cut at i: the first i rows.
    kept = 1 - np.concatenate([[0], np.cumsum(g)]) / n_good
    gone = np.concatenate([[0], np.cumsum(~g)]) / n_bad
    ok = np.concatenate([[True], w[1:] > w[:-1], [True]])
    i = int(np.argmax(np.where(ok, kept + gone, -1)))
    return float(w[0] - 1 if i == 0 else w[-1] + 1 if i == len(w) else (w[i - 1] + w[i]) / 2)


def _dense(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(RUN + 1, np.float32)
    out[at] = values
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Fit:
    """Target model and cut from a bounded labelled sample, raw model from all."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labels)
    )
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    known = materialize(spark, known.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good")), "labelled")
    model = weights(spark, docs, known)
    bad = _scored(spark, known.where("not good").select("doc_id", "text"), model.at, model.weight, "w").toPandas()["w"].to_numpy(np.float64)
    good = _scored(spark, known.where("good").select("doc_id", "text"), model.at, model.own, "w").toPandas()["w"].to_numpy(np.float64)
    model.cut = best_cut(np.concatenate([good, bad]), np.arange(len(good) + len(bad)) < len(good))
    discard(known)
    return model


def _scored(spark: SparkSession, docs: DataFrame, at: np.ndarray, weight: np.ndarray, name: str, keep_text: bool = False) -> DataFrame:
    """Rows with their log weight under ``name``, in place of the text or beside it."""
    shared = spark.sparkContext.broadcast((at, weight))
    text = docs.columns.index("text")
    rest = [i for i in range(len(docs.columns)) if keep_text or i != text]
    names = [*(docs.columns[i] for i in rest), name]
    schema = T.StructType([docs.schema[i] for i in rest]).add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = _dense(*shared.value)
        for batch in batches:
            w = [float(vector[ngram_buckets(t)].sum(dtype=np.float64)) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(w, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def gumbel(seed: int = SEED) -> F.Column:
    """Noise that depends on the row's id alone, so runs and retries agree."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int, few: int = 10_000) -> float | None:
    """The k-th largest value, exactly.

    Counts in 4096 equal ranges narrow the place down until at most ``few``
    values are left there; no sort of all rows and no sketch.
    """
    at = df.where(F.col(key).isNotNull()).select(F.col(key).alias("x"))
    lo, hi, n = at.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k <= 0 or not n:
        return None
    left = min(k, n)
    while lo < hi and n > few:
        place = F.least(F.floor((F.col("x") - lo) / ((hi - lo) / 4096)), F.lit(4095))
        ranges = at.where(F.col("x").between(lo, hi)).groupBy(place.alias("b")).agg(F.min("x"), F.max("x"), F.count("x"))
        for _, lo, hi, n in sorted(ranges.collect(), reverse=True):
            if n >= left:
                break
            left -= n
    if lo == hi:
        return lo
    rest = sorted((r[0] for r in at.where(F.col("x").between(lo, hi)).collect()), reverse=True)
    return rest[left - 1]


def _draw(rows: DataFrame, weight: str, key: str, cut: float) -> F.Column:
    """Whether a row is among the k with the highest keys, k of them above the cut."""
    k = rows.where(F.col(weight) >= cut).count()
    least = kth_largest(rows, key, k)
    return F.lit(False) if least is None else F.col(key) >= F.lit(least)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, max_labels: int = MAX_LABELS) -> DataFrame:
    """Per row: doc_id, log_weight, gumbel_key and whether the draw selects it."""
    model = fit(spark, docs, labels, max_labels)
    rows = _scored(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model.at, model.weight, "log_weight")
    rows = materialize(spark, rows.withColumn("gumbel_key", F.col("log_weight") / temperature + gumbel()), "quality")
    return rows.select("doc_id", "log_weight", "gumbel_key", _draw(rows, "log_weight", "gumbel_key", model.cut).alias("selected"))


def keep_selected(spark: SparkSession, docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, max_labels: int = MAX_LABELS) -> DataFrame:
    """The selected documents, all columns kept. Each text is scored once, and
    its key written beside it."""
    model = fit(spark, docs, labels, max_labels)
    weight, key = free_name(docs, "weight"), free_name(docs, "key")
    rows = _scored(spark, docs, model.at, model.weight, weight, keep_text=True)
    rows = materialize(spark, rows.withColumn(key, F.col(weight) / temperature + gumbel()), "quality")
    return rows.where(_draw(rows, weight, key, model.cut)).select(*docs.columns)
