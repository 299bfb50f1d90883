"""Fingerprints, covering and components against plain versions."""

import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weftline.llm import simhash


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        t = " \n".join(rng.choice(["The", "é", "a b", "Of", "zz"]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == plain(t)


def test_masks_cover_all_pairs_of_bits():
    ms = simhash.masks()
    assert len(ms) == 7
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in ms)


def roots(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_links_and_components(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:10]:
        for _ in range(12):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    c = base[0]
    for i in range(64):
        fps.add(c ^ (1 << i))
    rows = [(f - (1 << 64) if f >> 63 else f, n) for n, f in enumerate(sorted(fps, key=lambda _: rng.random()))]
    nodes = spark.createDataFrame(rows, "fp long, node long")
    by = {n: f & (1 << 64) - 1 for f, n in rows}
    linked = [(a, b) for a, b in itertools.combinations(by, 2) if (by[a] ^ by[b]).bit_count() <= 2]
    want = roots(by, linked)
    got = {r.node: r.root for r in simhash.connected(spark, simhash.links(nodes)).collect()}
    assert {n: got.get(n, n) for n in by} == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.connected(spark, edges).collect()} == {0}


def test_nodes_of_any_size(spark):
    # The sum of these nodes is beyond a long, either way.
    for at in (-(2**63), 2**63 - 20):
        edges = spark.createDataFrame([(at + i + 1, at + i) for i in (0, 1, 5, 6, 10, 11)], "a long, b long")
        got = {r.node: r.root for r in simhash.connected(spark, edges).collect()}
        assert got == {at + i: at + i - i % 5 for i in (1, 2, 6, 7, 11, 12)}


def test_documents(spark):
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefghij") * 3 for _ in range(400))
    docs = [(9, text), (4, text), (7, text + " extra"), (1, "other words here now"), (2, None), (3, ""), (5, " \n"), (4, text), (8, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit(0))
    got = sorted(map(tuple, simhash.components(spark, df).collect()))
    fp = {i: plain(t) for i, t in docs}
    want = roots(sorted(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == sorted((i, f"{fp[i]:016x}", want[i]) for i, _ in docs)
    kept = simhash.keep_one(spark, df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns
    # One id on two texts doesn't link them.
    far = " ".join(rng.choice("klmnop") * 3 for _ in range(400))
    two = [(1, text), (1, far), (2, text), (3, far), (None, "only without an id here")]
    by = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.components(spark, spark.createDataFrame(two, "doc_id long, text string")).collect()}
    assert set(by.values()) == {1, 2**63 - 1} and len(by) == 5
    none = df.where("false")
    assert simhash.components(spark, none).count() == 0 and simhash.keep_one(spark, none).count() == 0


def test_edited_copies(spark):
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]

    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    docs = []
    for i in range(40):
        base = say(200)
        docs.append((10 * i, " ".join(base)))
        for k in range(1, 6):  # from clearly alike to clearly below the limit
            edited = list(base)
            for at in rng.sample(range(200), k * 2):
                edited[at] = "edit"
            docs.append((10 * i + k, " ".join(edited)))
    rng.shuffle(docs)
    of = {i: sets(t) for i, t in docs}
    linked = [(a, b) for a, b in itertools.combinations(sorted(of), 2) if a // 10 == b // 10 and len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b])]
    fp = {i: plain(t) for i, t in docs}
    assert sum((fp[a] ^ fp[b]).bit_count() > 2 for a, b in linked) > 20
    want = set(roots(sorted(of), linked).values())
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(spark, df).collect()) == sorted(want)


def test_near_dedup_prints_shingle_sets():
    rng = random.Random(8)
    for n in (0, 1, 2, 3, 600):
        hashes = np.array(sorted(rng.getrandbits(64) for _ in range(n)), np.uint64)
        got = int.from_bytes(simhash.wide_fingerprint(hashes), "little")
        mixed = []
        for h in hashes.tolist():
            x = [h * f % (1 << 64) for f in simhash._FACTORS.tolist()]
            x = [(v ^ v >> 32) * f % (1 << 64) for v, f in zip(x, simhash._FACTORS[::-1].tolist())]
            mixed.append(sum((v ^ v >> 29) << 64 * i for i, v in enumerate(x)))
        votes = [2 * sum(m >> b & 1 for m in mixed) + (mixed[0] >> b & 1 if n else 0) for b in range(256)]
        assert got == sum(1 << b for b, v in enumerate(votes) if v > n)


def test_near_dedup_compares_what_stands_side_by_side(spark):
    rng = random.Random(9)
    center, fps = rng.getrandbits(256), []
    for i in range(300):  # a large group, some of it near one another, and others
        bits = rng.sample(range(256), rng.randrange(10, 60)) if i < 150 else range(0)
        fps.append((center if i < 150 else rng.getrandbits(256)) ^ sum(1 << b for b in bits))
    fps += fps[:3]
    data = [(i, f.to_bytes(32, "little")) for i, f in enumerate(fps)]
    want = set()
    for order in simhash._ORDER_BITS.tolist():
        row = sorted((sum((f >> b & 1) << 31 - i for i, b in enumerate(order)), n) for n, f in enumerate(fps))
        for step in range(1, simhash.BESIDE + 1):
            want |= {(max(x, y), min(x, y)) for (_, x), (_, y) in zip(row, row[step:]) if (fps[x] ^ fps[y]).bit_count() <= simhash.NEAR_BITS}
    got = {tuple(r) for r in simhash._candidates(spark, spark.createDataFrame(data, "uid long, fp binary")).collect()}
    # Rows at the ends of partitions may meet some more; those are near as well.
    assert want <= got and len(got) < len(want) + 50 and {(300, 0), (301, 1), (302, 2)} <= got
    assert all((fps[a] ^ fps[b]).bit_count() <= simhash.NEAR_BITS for a, b in got)
