"""FLAC round trips and damage; ZIP, ZIP64 and WARC reading."""

import base64
import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import flac, warc


@pytest.mark.parametrize("raw", [b"", b"a", b"\xff" * 2000, bytes(range(256)) * 40, "éa z\n".encode() * 5000, random.Random(1).randbytes(20_000)])
def test_round_trip(raw):
    p = flac.pad(raw)
    assert len(p) % 576 == 0 and p and p.startswith(raw) and set(p[len(raw) :]) <= {255}
    stream = flac.encode(p)
    assert flac.decode(stream) == p
    assert flac.seek(stream, min(100, len(p) - 10), 10) == p[min(100, len(p) - 10) :][:10]


def test_every_damaged_byte_of_a_frame_is_found():
    s = flac.encode(flac.pad(b"some text " * 200))
    start = flac.Stream(s).start
    for i in range(start, min(start + 40, len(s))):
        bad = s[:i] + bytes([s[i] ^ 16]) + s[i + 1 :]
        with pytest.raises(ValueError):
            flac.decode(bad)


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += format(v & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, v, k):
        u = (v << 1) ^ (v >> 63)
        self.s += "0" * (u >> k) + "1"
        self.put(u, k)


def frame(body):
    head = flac._headers([0])[0]
    s = body.s + "0" * (-len(body.s) % 8)
    f = head + int(s, 2).to_bytes(len(s) // 8, "big")
    return f + flac.crc16(f).to_bytes(2, "big")


def test_linear_predictor_partitions_and_escape():
    rng = random.Random(2)
    coefs, shift, order = [14, -6, 1], 3, 3
    x = [rng.randrange(-20, 20) for _ in range(order)]
    res = [rng.randrange(-6, 7) for _ in range(576 - order)]
    for r in res:
        x.append(r + (sum(c * v for c, v in zip(coefs, x[::-1])) >> shift))
    x = [((v + 128) % 256) - 128 for v in x]
    res = [x[i] - (sum(c * v for c, v in zip(coefs, x[:i][::-1])) >> shift) for i in range(order, 576)]
    b = Bits()
    b.put(0, 1), b.put(31 + order, 6), b.put(0, 1)
    for v in x[:order]:
        b.put(v, 8)
    b.put(4, 4), b.put(shift, 5)
    for c in coefs:
        b.put(c, 5)
    b.put(1, 2), b.put(2, 4)  # 5-bit parameters, four partitions
    at = 0
    for p in range(4):
        n = 144 - (order if p == 0 else 0)
        part = res[at : at + n]
        at += n
        if p == 2:
            b.put(31, 5), b.put(12, 5)
            for v in part:
                b.put(v, 12)
        else:
            b.put(6 + p, 5)
            for v in part:
                b.rice(v, 6 + p)
    assert flac.decode_frames([frame(b)]).tolist() == x


def test_fixed_predictors_agree_with_the_bit_reader():
    rng = np.random.default_rng(3)
    x = np.clip(np.cumsum(rng.integers(-3, 4, (6, 576)), axis=1), -128, 127)
    for order in range(5):
        u = np.diff(x, n=order, axis=1)
        bodies = flac._rice_bodies(x, (u << 1) ^ (u >> 63), order, 2)
        heads = flac._headers(range(6))
        frames = [h + b for h, b in zip(heads, bodies)]
        frames = [f + flac.crc16(f).to_bytes(2, "big") for f in frames]
        assert (flac.decode_frames(frames).reshape(6, 576) == x).all()
        assert all((flac.decode_frame(f, 6) == r).all() for f, r in zip(frames, x))


def test_digest(spark):
    docs = [(1, "abc"), (2, None), (3, ""), (1, "abc"), (4, "é" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("media", F.lit(1))
    got = sorted(map(tuple, flac.digest(flac.to_media(df)).collect()))
    assert len(got) == 5
    for r in got:
        raw = next((t or "") for i, t in docs if i == r[0]).encode()
        p = flac.pad(raw)
        assert r[1:5] == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        m = flac.encode(p)
        assert r[5:7] == (len(m), hashlib.sha256(m).hexdigest())
    media = flac.to_media(df)
    blocks = flac.pcm_blocks(media.where("doc_id = 4"), 576 * 10).orderBy("first_sample").collect()
    assert b"".join(b.pcm for b in blocks) == flac.pad(("é" * 50_000).encode()) and [b.first_sample for b in blocks[:2]] == [0, 5760]
    assert flac.digest(flac.to_media(df.where("false"))).count() == 0


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k, v in members.items():
            z.writestr(k, v)
        z.comment = b"PK\x05\x06 is no end record"
    return out.getvalue()


def test_zip_reader():
    data = archive(a=b"hello", b=b"x" * 1000)
    z = warc.ZipArchive(warc.BytesSource(data))
    assert z.read("a", 1, 3) == b"ell" and len(z.read("b")) == 1000
    with pytest.raises(ValueError):
        z.read("a", 3, 5)
    with pytest.raises(ValueError):
        warc.ZipArchive(warc.BytesSource(b"no zip at all" * 10))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as d:
        d.writestr("a", b"hello" * 100)
    with pytest.raises(ValueError, match="not stored"):
        warc.ZipArchive(warc.BytesSource(out.getvalue())).read("a")


def test_zip64():
    body, name = b"payload", b"big"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, zlib.crc32(body), len(body), len(body), len(name), 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local)
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<IIQI", 0x07064B50, 0, at + len(entry), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    z = warc.ZipArchive(warc.BytesSource(local + entry + end64 + locator + end))
    assert z.read("big") == body


def test_archives(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 300_000), (None, "u", "<p>é</p>"), (5, "u", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("ref", F.lit(9))
    arch = warc.write_archives(spark, df)
    got = sorted(map(tuple, warc.read_records(arch).collect()), key=repr)
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 9, d("<p>é</p>"), "revisit", 2), (2, 9, d("<p>é</p>"), "response", None), (3, 0, d(""), "revisit", 4), (4, 0, d(""), "response", None), (None, 9, d("<p>é</p>"), "revisit", 2)]
    want += [(5, 300_000, d("z" * 300_000), "response", None)] * 2
    assert got == sorted(want, key=repr)
    path = tmp_path / "x.wacz"
    path.write_bytes(arch.first().data)
    assert [r["payload_bytes"] for r in warc.read_archive(warc.FileSource(str(path)))]
    assert warc.read_records(warc.write_archives(spark, df.where("false"))).count() == 0
    raw = warc.record(7, "u", b"abc", None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
