"""Windows and hits against a plain scan."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in wins.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found |= ids
        ids = sorted(found)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "ΑΣ", "É", "x1", "the", "of", "K"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, say(25)), (2, "Short One"), (12, say(11)), (3, None), (4, ""), (5, "!!!"), (2, "Short One")]
    items.append((6, items[0][1].upper().replace("É", "É")))
    docs = [(i, say(rng.randrange(0, 60))) for i in range(40)]
    docs += [(100, f"{say(5)} {items[0][1]} {say(3)}"), (101, "a SHORT, one! short one b"), (102, None), (103, ""), (104, items[0][1] + " " + items[2][1])]
    docs += [docs[-1], (104, "another text short one"), (105, " ".join(["short one"] * 3000))]
    return docs, items


@pytest.mark.parametrize("limit", [(20_000, 1000), (7, 1000), (20_000, 2), (7, 2)])
def test_against_plain_scan(spark, limit):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("exact", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.find(spark, d, b, set_limit=limit[0], hit_limit=limit[1]).collect()), key=repr)
    assert got == brute(docs, items)


def test_removal(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    kept = decontam.remove_documents(spark, d, b)
    assert kept.count() == sum(not r[5] for r in want) and kept.columns == d.columns
    cut = decontam.remove_spans(spark, d, b).where("doc_id = 101").first().text
    assert cut == "a , !   b"


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.find(spark, d, none).collect()] == [0]
    assert decontam.find(spark, d.where("false"), none).count() == 0
    assert decontam.remove_documents(spark, d, none).count() == 1
