"""Spans against a plain scan; the ledger skips what it has."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from weftline.llm import secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute(text):
    t, out = text or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(t) if len(m[0]) >= 16]
    return sorted(out)


def texts():
    rng = random.Random(7)
    parts = ["token", "Password", "api_key", "APIKEY", "secret", " ", ":", "=", '"', "'", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "abcdef", "🙂", "é", "\n", "xyz-123_abc.def", "ſecret", "Ktoken", "Z9"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(150)]
    out += [None, "", "secret: token: abcdefghijklmnopq", "token=password=abcdefghijklmnop", "x" * 30_000 + " token = abcdefghijklmnop", "token=abcdefghijkl " * 2000, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9]
    return out + out[:5]


def test_against_plain_scan(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    found, _ = secrets.scan(spark, docs)
    got = {r.doc_id: r for r in secrets.findings_by_path(docs, found).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        shown = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in want) for k in ("assign", "access", "hex")), (i, t)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        extra = [x for x in r.spans.split(",") if x and x not in shown.split(",")]
        assert all(x.split(":")[0] in ("pem", "forge") for x in extra)


def test_ledger(spark):
    one = spark.createDataFrame([(1, "token = abcdefghijklmnop"), (2, "clean")], "doc_id long, text string")
    found, pairs = secrets.scan(spark, one)
    assert found.count() == 1 and pairs.count() == 2 * len(secrets.RULES)
    again, new = secrets.scan(spark, one, pairs)
    assert again.count() == 0 and new.count() == 0
    two = one.union(spark.createDataFrame([(3, "ffffffffffffffffff")], "doc_id long, text string"))
    more, new = secrets.scan(spark, two, pairs)
    assert [r.kind for r in more.collect()] == ["hex"] and new.count() == len(secrets.RULES)
    bumped = tuple(r if r.kind != "assign" else secrets.Rule("assign", 2, r.pattern, r.min_len, r.hint) for r in secrets.RULES)
    more, new = secrets.scan(spark, one, pairs, bumped)
    assert [(r.kind, r.rule_version) for r in more.collect()] == [("assign", 2)] and new.count() == 2


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found, pairs = secrets.scan(spark, none)
    assert found.count() == pairs.count() == secrets.findings_by_path(none, found).count() == 0
