"""Benchmark decontamination with DataFrame operations only.

The benchmark's normalised word windows form a hash set that every executor
gets by a broadcast join. Its size is checked: beyond ``set_limit`` windows the
hashes of the positions are shuffled to the windows instead. Either way the
documents are hashed once, whatever the benchmark's size. Every document position
looks up the hash of its window in the set; hits go back to their texts and are
verified word by word against the exact window before they count.

Words: the text in lower case (A-Z only), runs of characters outside ASCII
punctuation, control and white space. A window is ``n`` consecutive words of a
benchmark item; an item with fewer words, but not none, is a single window.

Defined cases: null or empty texts have no words and are never hit; null
benchmark texts add no window; repeated benchmark rows count as one item by
``item_id``; repeated document rows each get their own result row; empty tables
give empty results (an empty benchmark hits nothing); other columns of the
documents are ignored by ``find`` and kept by ``remove_documents`` and
``remove_spans``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import free_name, materialize

WINDOW = 10
#: Windows of a benchmark that is broadcast; some 200 bytes each.
SET_LIMIT = 200_000
#: Hits that are broadcast to the documents; some 150 bytes each.
HIT_LIMIT = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that are no part of a word, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: F.Column) -> F.Column:
    """Words of a text in their original case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def ascii_lower(text: F.Column) -> F.Column:
    return F.translate(text, UPPER, LOWER)


def _hash_words(arr: F.Column) -> F.Column:
    # lower() folds more than A-Z, so equal words stay equal: it only proposes.
    return F.transform(arr, lambda w: F.xxhash64(F.lower(w)))


def _window_hash(hashes: F.Column, n: int, i: F.Column) -> F.Column:
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(n)])


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, dict[int, int]]:
    """One row per distinct window (hash, exact words, length and its items),
    and the number of windows of each length, repeats included."""
    items = (
        benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
        .select("item_id", F.explode(F.array(words(F.col("text")))).alias("w"))
        .where(F.size("w") > 0)
        .withColumn("len", F.least(F.size("w"), F.lit(n)))
    )
    lengths = {r[0]: r[1] for r in items.groupBy("len").agg(F.sum(F.size("w") - F.col("len") + 1)).collect()}
    at = items.select("item_id", "w", "len", F.explode(F.array(_hash_words(F.col("w")))).alias("h")).select(
        "item_id", "w", "h", "len", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("i")
    )
    keyed = F.lit(None).cast("long")
    for k in lengths:
        keyed = F.when(F.col("len") == k, _window_hash(F.col("h"), k, F.col("i"))).otherwise(keyed)
    exact = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda j: F.get(F.col("w"), F.col("i") + j))
    rows = at.select("item_id", "len", keyed.alias("wh"), ascii_lower(F.concat_ws(" ", exact)).alias("exact"))
    return rows.groupBy("wh", "len", "exact").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")), lengths


def _hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int, set_limit: int) -> DataFrame:
    """A written table: a row (doc_id, text_hash, n_words) for each document, and one
    (doc_id, text_hash, i, k, exact, items) for each position whose hash the set has."""
    wins, lengths = benchmark_windows(benchmark, n)
    sizes = sorted(lengths, reverse=True)
    # Generators of one row each: the optimizer doesn't move the arrays across
    # them into the expressions that read them at every position.
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(words(F.col("text")))).alias("w"))
    hashed = base.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.explode(F.array(_hash_words(F.col("w")))).alias("h"))
    # All hashes for the first length, then for the next. Exploded rows carry no array.
    keys = [F.lit(None).cast("array<long>")]
    first, at, starts = F.lit(1), F.col("pos"), []
    for k in sizes:
        many = F.greatest(F.col("n_words") - k + 1, F.lit(0))
        made = F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), partial(_window_hash, F.col("h"), k))
        keys.append(F.when(many > 0, made).otherwise(F.array().cast("array<long>")))
        starts.append((k, first))
        first = first + many
    every = F.concat(F.array(F.lit(None).cast("long")), *keys[1:])  # the first stands for the document
    rows = hashed.select("doc_id", "text_hash", "n_words", F.posexplode(every).alias("pos", "key"))
    k, i = F.lit(None).cast("int"), F.lit(None).cast("int")
    for length, start in starts:
        k = F.when(at >= start, length).otherwise(k)
        i = F.when(at >= start, at - start).otherwise(i)
    rows = rows.select("doc_id", "text_hash", "n_words", "pos", "key", i.cast("int").alias("i"), k.cast("int").alias("k"))
    probe = wins.select("wh", "exact", "items")
    if sum(lengths.values()) <= set_limit:
        found = rows.join(F.broadcast(probe), rows["key"] == probe["wh"], "left").where("pos = 0 or wh is not null")
    else:
        found = rows.where("pos > 0").join(probe.hint("merge"), rows["key"] == probe["wh"])
        alone = base.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.lit(0).alias("pos"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("k"))
        found = found.select("doc_id", "text_hash", "n_words", "pos", "i", "k", "exact", "items").unionByName(alone, allowMissingColumns=True)
    return materialize(spark, found.select("doc_id", "text_hash", "n_words", "pos", "i", "k", "exact", "items"), "windows")


def _verified(docs: DataFrame, hits: DataFrame, hit_limit: int) -> DataFrame:
    """(doc_id, text_hash, spans, items) of texts whose words are those of a window."""
    # As many as a document has positions.
    per = hits.where("pos > 0").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("i", "k", "exact", "items")).alias("found"))
    per = per.toDF("_id", "_th", "_found")
    few = hits.where("pos > 0").limit(hit_limit + 1).count() <= hit_limit
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    both = texts.join(F.broadcast(per) if few else per.hint("merge"), texts["doc_id"].eqNullSafe(per["_id"]) & (texts["text_hash"] == per["_th"]))
    both = both.select("doc_id", "text_hash", "_found", F.explode(F.array(words(F.col("text")))).alias("w"))
    own = lambda f: ascii_lower(F.concat_ws(" ", F.slice(F.col("w"), f["i"] + 1, f["k"])))
    both = both.select("doc_id", "text_hash", F.filter("_found", lambda f: own(f) == f["exact"]).alias("f"))
    spans = F.array_sort(F.array_distinct(F.transform("f", lambda f: F.struct(f["i"].alias("i"), (f["i"] + f["k"]).alias("e")))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("f", lambda f: f["items"]))))
    return both.where(F.size("f") > 0).select("doc_id", "text_hash", spans.alias("spans"), items.alias("items")).dropDuplicates(["doc_id", "text_hash"])


def find(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    set_limit: int = SET_LIMIT,
    hit_limit: int = HIT_LIMIT,
    with_spans: bool = False,
) -> DataFrame:
    """Per document row: n_words, n_hit, n_items, items_sha256, contaminated.

    A benchmark of over ``set_limit`` windows isn't broadcast, nor are over
    ``hit_limit`` hits when they go back to the words. With ``with_spans``
    the hit word ranges and ``text_hash`` are returned too; a row is known by
    (doc_id, text_hash), so rows that repeat a doc_id don't mix.
    """
    hits = _hits(spark, docs, benchmark, n, set_limit)
    sure = _verified(docs, hits, hit_limit).toDF("_id", "_th", "spans", "items")
    rows = hits.where("pos = 0").select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"))
    same = rows["doc_id"].eqNullSafe(sure["_id"]) & rows["text_hash"].eqNullSafe(sure["_th"])
    rows = rows.join(sure, same, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<i:int,e:int>>"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["e"] - F.greatest(s["i"], a["end"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(a["end"], s["e"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    return rows.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        *(["spans", "text_hash"] if with_spans else []),
    )


def _bad(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    """(id, text hash, spans) of texts with hits, under names that ``docs`` lacks, and the names."""
    found = find(spark, docs.select("doc_id", "text"), benchmark, n, with_spans=True).where("contaminated")
    names = [free_name(docs, x) for x in ("id", "th", "spans")]
    return found.select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]).toDF(*names), names


def remove_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Documents without any verified hit, all columns kept."""
    bad, (key, th, _) = _bad(spark, docs, benchmark, n)
    same = docs["doc_id"].eqNullSafe(bad[key]) & (F.xxhash64(docs["text"]) == bad[th])
    return docs.join(bad, same, "left_anti")


def remove_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Documents with every hit word cut out of the text, all columns kept.

    The separators around the removed words stay, so nothing else changes.
    """
    bad, (key, th, spans) = _bad(spark, docs, benchmark, n)
    same = docs["doc_id"].eqNullSafe(bad[key]) & (F.xxhash64(docs["text"]) == bad[th])
    both = docs.join(bad, same, "left")
    kept = F.transform(
        words(F.col("text")),
        lambda w, i: F.when(F.exists(F.col(spans), lambda s: (s["i"] <= i) & (i < s["e"])), F.lit("")).otherwise(w),
    )
    pairs = F.arrays_zip(F.split("text", WORD).alias("g"), F.concat(kept, F.array(F.lit(""))).alias("k"))
    text = F.array_join(F.transform(pairs, lambda z: F.concat(z["g"], z["k"])), "")
    cut = F.when(F.col(spans).isNotNull(), text).otherwise(F.col("text"))
    return both.select(*[cut.alias(c) if c == "text" else F.col(c) for c in docs.columns])
