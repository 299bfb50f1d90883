"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint takes, bit by bit, the majority of the hashes of all word
shingles. Pairs within ``radius`` = 2 bits are linked and linked documents form
components.

Covering: bit i of the word gets a vector m(i) in {0,1}^3, none of them zero.
For each of the 7 nonzero v, the mask of table v holds the bits with
<m(i), v> = 1 (mod 2). Two fingerprints that differ in at most two bits leave
at most two equations <m(i), v> = 0 in three unknowns, which have a nonzero
solution v; in that table the masked words agree. So every pair within the
radius shares a bucket in some table, and a fingerprint that is alone in all
its buckets has no partner.

Fingerprints that share a bucket aren't compared pair by pair, as one bucket
may hold many. Two words differ in at most two bits exactly if some word z is
within one bit of both. Each such fingerprint is sent to the 65 words within
one bit of it; those that meet at z are linked to the smallest of them. No
group holds more than 65 fingerprints, whatever the data.

Components come from hooking and pointer jumping on edges between distinct
fingerprints; each round is written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; repeated rows each get a result row; null ids count as the largest
when the smallest id of a component is taken; empty tables give empty results;
other columns are ignored by ``components`` and kept by ``keep_one``, which has
wider fingerprints and confirms its pairs by their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import byte_text, discard, map_batches, materialize

SEED = 42
BITS = 64
#: Near duplicates of ``keep_one``: words a shingle, Jaccard similarity, 64-bit
#: words of a fingerprint and the bits that those of candidates differ in at most.
NEAR_SIZE = 5
NEAR = 0.8
NEAR_WORDS = 4
NEAR_BITS = 56
#: Orders of the fingerprints, and rows that each row is compared with in each.
ORDERS = 96
BESIDE = 6
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 64, NEAR_WORDS, np.uint64) | np.uint64(1)
#: The 32 bits that each order sorts by, from the first on.
_ORDER_BITS = np.array([_RNG.permutation(BITS * NEAR_WORDS)[:32] for _ in range(ORDERS)])


def masks(radius: int = 2) -> list[int]:
    """The 2^(radius+1) - 1 covering masks, as signed 64-bit words."""
    top = 1 << (radius + 1)
    out = []
    for v in range(1, top):
        m = sum(1 << i for i in range(BITS) if (((i % (top - 1)) + 1) & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


#: A byte's bits as eight byte-wide counters.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").reshape(256, 8).copy().view(np.uint64).ravel()


def _shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    h = xxhash.xxh64_intdigest
    if not words:
        return []
    if len(words) <= size:
        return [h(b" ".join(words), SEED)]
    joined = b" ".join(words)
    starts = [0]
    at = 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    return [h(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])]


def fingerprint(text: bytes, size: int = 3) -> int:
    """Majority bits over the shingles; without words it is zero."""
    counts = np.zeros(BITS, np.int64)
    hashes = _shingle_hashes(text, size)
    if not hashes:
        return 0
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for a in range(0, len(octets), 255):  # a counter holds 255
        part = octets[a : a + 255]
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.add.reduce(_SPREAD[part[:, k]]).reshape(1).view(np.uint8)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.fromiter((fingerprint(t, size) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), byte_text().alias("b")), run, "doc_id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Star edges (a, b), a > b, among rows (fp, node) with distinct fp."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())])
    keyed = nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "key")
    near = keyed.join(shared, ["t", "key"], "left_semi").select("fp").distinct()
    ball = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(BITS)])
    at = nodes.join(near, "fp").select("node", "fp", F.explode(ball).alias("bit")).select("node", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"))
    # At most 65 distinct fingerprints are within one bit of z.
    met = at.groupBy("z").agg(F.collect_set("node").alias("all")).where(F.size("all") > 1)
    met = met.select(F.array_min("all").alias("b"), F.explode("all").alias("a"))
    return met.where("a > b").distinct()


def connected(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for linked nodes.

    Alternates large-star and small-star contraction until nothing changes.
    """
    e = materialize(spark, edges.select("a", "b"), "edges")
    before = None
    for _ in range(max_rounds):
        # Large star: larger neighbours of each node go to its smallest neighbour.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["c"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        joined = large.join(low, large["a"] == low["c"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("c").alias("a"), F.col("m").alias("b")))
        old, e = e, materialize(spark, small.where("a > b").distinct(), "edges")
        discard(old)
        # Nodes may be fingerprints, whose sums exceed a long.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(spark: SparkSession, docs: DataFrame, size: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id."""
    fps = materialize(spark, fingerprints(docs, size), "simhash")
    # Fingerprints are the nodes, as rows of different texts may share a doc_id.
    nodes = materialize(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected(spark, links(nodes.select("fp", F.col("fp").alias("node"))))
    label = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = label.groupBy("root").agg(F.coalesce(F.min("first"), F.lit(2**63 - 1)).alias("component_id"))
    label = label.join(least, "root").select("fp", "component_id")
    return fps.join(label, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def shingle_set(text: bytes, size: int = NEAR_SIZE) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(np.array(_shingle_hashes(text, size), np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """Majority bits of NEAR_WORDS words over a shingle set, each word another mix of
    its hashes. The smallest hash decides ties, so few shingles give no excess of zeros."""
    if not len(hashes):
        return bytes(8 * NEAR_WORDS)
    counts = np.zeros(BITS * NEAR_WORDS, np.int64)
    for a in range(0, len(hashes), 255):  # a counter holds 255
        x = hashes[a : a + 255, None] * _FACTORS
        x ^= x >> np.uint64(32)
        x *= _FACTORS[::-1]
        x ^= x >> np.uint64(29)
        counts += np.add.reduce(_SPREAD[x.view(np.uint8).reshape(len(x), -1)]).view(np.uint8)
        if not a:
            least = np.unpackbits(x[0].view(np.uint8), bitorder="little")
    return np.packbits(2 * counts + least > len(hashes), bitorder="little").tobytes()


def _printed(docs: DataFrame) -> DataFrame:
    """The rows with _uid, _set (a hash of their shingle set) and _fp."""
    rows = docs.withColumn("_uid", F.monotonically_increasing_id()).withColumn("_bytes", byte_text())
    schema = rows.drop("_bytes").schema.add("_set", "long").add("_fp", "binary")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        keys = pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64))
        fps = pa.array([wide_fingerprint(x) for x in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], keys, fps], names=[*batch.schema.names[:-1], "_set", "_fp"])

    return map_batches(rows, run, schema)


def _placed(own: DataFrame) -> DataFrame:
    """(uid, fp, at): the place of each row of (uid, fp) in every order, with the order's number above it."""
    turns = np.arange(ORDERS, dtype=np.int64) << 32

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            bits = np.unpackbits(_words(part.column(1)).view(np.uint8), axis=1, bitorder="little")
            key = np.packbits(np.take(bits, _ORDER_BITS, axis=1), axis=2).view(">u4")[:, :, 0].astype(np.int64) | turns
            at = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * ORDERS), pa.array(key.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, at], names=["uid", "fp", "at"])

    return map_batches(own, run, "uid long, fp binary, at array<long>")


def _words(fps: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(-1, NEAR_WORDS)


def _beside(rows: DataFrame) -> DataFrame:
    """(a, b, at, fp): of rows (at, uid, fp) in order, the pairs a, b of one order
    with at most BESIDE - 1 rows between them whose fingerprints are near. The first
    and last BESIDE rows of every partition come out too, without b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, end = ["a", "b", "at", "fp"], None

        def ends(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            out = [t["uid"], pa.nulls(len(t), pa.int64()), t["at"], t["fp"]]
            return pa.Table.from_arrays(out, names=names).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            if end is None:
                head, t = new.slice(0, BESIDE), new
                yield ends(head)
            else:
                t = pa.concat_tables([end, new])
            before = len(t) - len(new)
            at, uid, fp = t["at"].to_numpy(), t["uid"].to_numpy(), _words(t["fp"])
            for step in range(1, BESIDE + 1):
                low = max(before - step, 0)  # pairs whose second row is new
                if len(t) - low <= step:
                    continue
                x, y = slice(low, len(t) - step), slice(low + step, len(t))
                near = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) <= NEAR_BITS
                hit = np.flatnonzero(near & (at[x] >> 32 == at[y] >> 32))
                if len(hit):
                    none = len(hit)
                    yield pa.RecordBatch.from_arrays([pa.array(uid[x][hit]), pa.array(uid[y][hit]), pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], names=names)
            end = t.slice(max(len(t) - BESIDE, 0))
        if end is not None:
            yield ends(end)

    return rows.mapInArrow(run, "a long, b long, at long, fp binary")


def _candidates(spark: SparkSession, own: DataFrame) -> DataFrame:
    """The written pairs (a, b), a > b, of rows of (uid, fp) that stand side by side
    in an order and whose fingerprints are near."""
    placed = materialize(spark, _placed(own), "near-places")
    rows = placed.select(F.explode("at").alias("at"), "uid", "fp")
    found = materialize(spark, _beside(rows.repartitionByRange("at", "uid").sortWithinPartitions("at", "uid")), "near-found")
    # Rows on two sides of a partition's end: some for each partition, whatever the input.
    ends = found.where("b IS NULL").select("at", F.col("a").alias("uid"), "fp").distinct()
    over = _beside(ends.repartition(1).sortWithinPartitions("at", "uid"))
    pairs = found.select("a", "b").union(over.select("a", "b")).where("a <> b")
    out = materialize(spark, pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
    discard(placed, found)
    return out


def _sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(uid, set): shingle sets of the rows whose _uid is among ``ids``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            sets = [shingle_set(t).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["uid", "set"])

    some = rows.join(ids, rows["_uid"] == ids[ids.columns[0]], "left_semi")
    return map_batches(some.select("_uid", byte_text()), run, "uid long, set array<long>")


def _confirmed(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets have the similarity.

    Sets are compared a row at a time in the JVM, as many pairs may share a long one.
    """
    left = pairs.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
    both = left.join(sets.select(F.col("uid").alias("b"), F.col("set").alias("y")).hint("merge"), "b")
    both = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("n"))
    union = F.col("nx") + F.col("ny") - F.col("n")
    return both.where((union == 0) | (F.col("n") / union >= NEAR)).select("a", "b")


def near_groups(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(_set, root) of ``rows``, which are _printed() and written."""
    nodes = materialize(spark, rows.groupBy("_set").agg(F.min("_uid").alias("node")), "near-nodes")
    own = rows.join(nodes, rows["_uid"] == nodes["node"], "left_semi").select(F.col("_uid").alias("uid"), F.col("_fp").alias("fp"))
    pairs = _candidates(spark, own)
    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(spark, _sets(rows, met), "near-sets")
    roots = connected(spark, _confirmed(spark, pairs, sets))
    discard(pairs, sets)
    return nodes.join(roots, "node", "left").select("_set", F.coalesce("root", "node").alias("root"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, all
    columns kept.

    Near duplicates have ``NEAR`` of their ``NEAR_SIZE``-word shingles in common
    (Jaccard, over the sets), and groups are the components of such pairs. They are
    found by SimHash: the fingerprints of the different sets, of 4 x 64 bits, are
    sorted by ORDERS drawn choices of their bits, and each is compared with the
    BESIDE next ones; pairs within NEAR_BITS bits are confirmed by their sets. So a
    row meets a fixed number of others however many are alike. Pairs at the limit
    differ in 39 +- 6 bits. The 64 bits and 2 differences of ``components`` don't serve
    here: such pairs differ in up to 11 bits or so of those.

    Rows without an id all stay.
    """
    # Other columns get names that clash with none of those added here.
    names = [c if c in ("doc_id", "text") else f"x{i}" for i, c in enumerate(docs.columns)]
    rows = materialize(spark, _printed(docs.toDF(*names)), "near-rows")
    groups = near_groups(spark, rows)
    first = rows.where(F.col("doc_id").isNotNull()).select("_set", "_uid", "doc_id").join(groups, "_set")
    first = first.groupBy("root").agg(F.min(F.struct("doc_id", "_uid")).alias("at")).select(F.col("at._uid").alias("_uid"))
    one = rows.join(first, "_uid", "left_semi").select(*names)
    return one.unionByName(rows.where(F.col("doc_id").isNull()).select(*names)).toDF(*docs.columns)
