"""FLAC streams as media columns: encoder, checked decoder, seekable PCM blocks.

A payload of bytes is stored as one mono stream of 8-bit samples (byte - 128)
in blocks of 576 samples, each a frame with its own number, CRC-8 of the header
and CRC-16 of the whole. Frames are constant, verbatim or a fixed linear
predictor with Rice-coded residuals. A seek table names sample offsets.

The decoder takes these and also general linear predictors (LPC orders 1-32),
Rice partitions of both parameter sizes and escaped partitions. Frames of one
shape are decoded side by side with numpy: step s decodes sample s of all
frames, so the work a sample is a few array operations over all frames. Other
frames go through the bit reader. Every checksum is verified.

Defined cases: null text is the empty text, which is padded to one block like
any payload; equal texts give equal streams; texts of any length are handled
``SLICE`` bytes at a time; repeated rows each get a result row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import byte_text, chunked, map_batches

BLOCK = 576
RATE = 8000
#: Bytes coded at once; bounds memory for payloads of any length.
SLICE = BLOCK * 2048
#: One seek point for so many frames.
SEEK_EVERY = 16
MAX_RICE = 7
#: Highest fixed predictor that is tried; the decoder takes all.
MAX_ORDER = 2


def _crc_table(poly: int, width: int) -> np.ndarray:
    """Tables from the generator polynomial."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for c in range(256):
        c <<= width - 8
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


#: Leading zeros of a 16-bit number.
_ZEROS = (16 - np.ceil(np.log2(np.arange(1, 65537)))).astype(np.uint8)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ int(CRC16[(c >> 8) ^ b])
    return c


def _crc_rows(rows: np.ndarray, table: np.ndarray, wide: bool) -> np.ndarray:
    """CRC of each row of bytes; rows are padded with zeros on the left, which
    don't change a CRC that starts at zero."""
    c = np.zeros(len(rows), np.uint16)
    for col in np.ascontiguousarray(rows.T):
        c = (c << 8) ^ table[(c >> 8) ^ col] if wide else table[c ^ col]
    return c


def _utf8_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form (up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        lead >>= 1
    return bytes([((~lead << 1) & 0xFF) | n, *reversed(tail)])


def _headers(numbers: Iterable[int]) -> list[bytes]:
    out = []
    for i in numbers:
        h = b"\xff\xf8\x24\x02" + _utf8_number(i)  # fixed blocks of 576 at 8 kHz; mono, 8 bits
        out.append(h + bytes([crc8(h)]))
    return out


def encode_frames(blocks: np.ndarray, numbers: Iterable[int]) -> list[bytes]:
    """Frames of int samples [n, 576] with the given numbers."""
    n = len(blocks)
    if not n:
        return []
    x = blocks.astype(np.int16)
    best_cost = np.full(n, BLOCK * 8, np.int64)
    best_order, best_k = np.full(n, -1), np.zeros(n, np.int64)
    zigzags = []
    r = x
    for order in range(MAX_ORDER + 1):
        u = (r << 1) ^ (r >> 15)
        zigzags.append(u)
        # The parameter near the mean's logarithm, then its true cost.
        guess = np.log2(np.maximum(u.mean(axis=1), 1)).astype(np.int16)
        for step in (-1, 0):
            k = np.clip(guess + step, 0, MAX_RICE).astype(np.int16)
            cost = (u >> k[:, None]).sum(axis=1, dtype=np.int64) + (1 + k) * u.shape[1] + 8 * order + 10
            better = cost < best_cost
            best_cost[better], best_order[better], best_k[better] = cost[better], order, k[better]
        r = np.diff(r, axis=1)
    constant = (x == x[:, :1]).all(axis=1)
    heads = _headers(numbers)
    bodies: list[bytes] = [b""] * n
    for i in np.flatnonzero(constant):
        bodies[i] = bytes([0x00, int(x[i, 0]) & 0xFF])
    for i in np.flatnonzero(~constant & (best_order < 0)):
        bodies[i] = b"\x02" + blocks[i].astype(np.int8).tobytes()
    for order in range(MAX_ORDER + 1):
        for k in range(MAX_RICE + 1):
            at = np.flatnonzero(~constant & (best_order == order) & (best_k == k))
            if len(at):
                for i, body in zip(at, _rice_bodies(x[at], zigzags[order][at], order, k)):
                    bodies[i] = body
    frames = [h + b for h, b in zip(heads, bodies)]
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, _crc_rows(_right(frames), CRC16, True))]


def _right(rows: list[bytes]) -> np.ndarray:
    """Rows of bytes as a matrix, aligned on the right."""
    wide = max(map(len, rows))
    return np.frombuffer(b"".join(r.rjust(wide, b"\0") for r in rows), np.uint8).reshape(-1, wide)


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Low ``width`` bits of each value, highest first, on a new last axis."""
    return ((values[..., None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)


def _rice_bodies(x: np.ndarray, u: np.ndarray, order: int, k: int) -> list[bytes]:
    """Subframes of one predictor order and Rice parameter."""
    n = len(x)
    fixed = 8 + 8 * order + 10
    q = u >> k
    starts = np.zeros_like(u, dtype=np.int64)
    lengths = q + 1 + k
    np.cumsum(lengths[:, :-1], axis=1, out=starts[:, 1:])
    total = fixed + lengths.sum(axis=1)
    row_bytes = (total + 7) // 8
    wide = int(row_bytes.max()) * 8
    bits = np.zeros((n, wide), np.uint8)
    bits[:, 0:8] = _bits(np.array((8 + order) << 1), 8)
    if order:
        bits[:, 8 : 8 + 8 * order] = _bits(x[:, :order] & 0xFF, 8).reshape(n, -1)
    # Rice coding with 4-bit parameters (00) and one partition (0000).
    bits[:, 8 + 8 * order + 6 : fixed] = _bits(np.array(k), 4)
    flat = bits.reshape(-1)
    at = starts + q + fixed + (np.arange(n) * wide)[:, None]
    flat[at] = 1
    for j in range(k):
        flat[at + 1 + j] = (u >> (k - 1 - j)) & 1
    packed = np.packbits(bits, axis=1)
    return [packed[i, : row_bytes[i]].tobytes() for i in range(n)]


def encode(payload: bytes) -> bytes:
    """A FLAC stream of a payload whose length is a positive multiple of 576."""
    return encode_many([payload])[0]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Streams of several payloads; their blocks share the array work."""
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError("a payload must be a positive multiple of 576 bytes")
    numbers = [i for p in payloads for i in range(len(p) // BLOCK)]
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    step = SLICE // BLOCK
    frames: list[bytes] = []
    for a in range(0, len(x), step):
        frames += encode_frames(x[a : a + step].astype(np.int16) - 128, numbers[a : a + step])
    out, at = [], 0
    for p in payloads:
        n = len(p) // BLOCK
        out.append(_stream(p, frames[at : at + n]))
        at += n
    return out


def _signed(payload: bytes) -> bytes:
    return (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    md5 = hashlib.md5(_signed(payload))
    sizes = [len(f) for f in frames]
    info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big") + md5.digest()
    seek, at = b"", 0
    for i, s in enumerate(sizes):
        if i % SEEK_EVERY == 0:
            seek += (i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + BLOCK.to_bytes(2, "big")
        at += s
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


class Stream:
    """Metadata and frame places of a stream."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        self.data, at, self.seek = data, 4, []
        while True:
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind & 0x7F == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.bits, self.samples, self.md5 = ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1), body[18:34]
                self.block = int.from_bytes(body[2:4], "big")
                self.min_frame, self.max_frame = int.from_bytes(body[4:7], "big"), int.from_bytes(body[7:10], "big")
            elif kind & 0x7F == 3:
                self.seek = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big")) for i in range(0, size, 18)]
            at += 4 + size
            if kind & 0x80:
                break
        self.start = at

    def frames(self, at: int | None = None, number: int = 0) -> Iterator[tuple[int, int]]:
        """(start, end) of the frames from a byte offset on.

        The next frame starts where its exact header with a right CRC-8 stands
        and what is before it has a right CRC-16.
        """
        at = self.start if at is None else at
        while at < len(self.data):
            number += 1
            head = _headers([number])[0]
            # Only the sync code, block size and number are fixed beforehand.
            end = self.data.find(head, at + self.min_frame, at + self.max_frame + len(head))
            while end >= 0 and crc16(self.data[at:end]):
                end = self.data.find(head, end + 1, at + self.max_frame + len(head))
            if end < 0:
                end = len(self.data)
            yield at, end
            at = end


def decode(data: bytes) -> bytes:
    """All samples of a stream as unsigned bytes; raises on a wrong checksum."""
    return decode_many([data])[0]


def decode_many(streams: list[bytes]) -> list[bytes]:
    """Samples of several streams; their frames share the array work."""
    known = [Stream(d) for d in streams]
    frames = [s.data[a:b] for s in known for a, b in _frame_places(s)]
    step = SLICE // BLOCK
    raw = b"".join((decode_frames(frames[a : a + step]) + 128).astype(np.uint8).tobytes() for a in range(0, len(frames), step))
    out, at = [], 0
    for s in known:
        payload = raw[at : at + s.samples]
        if len(payload) != s.samples or hashlib.md5(_signed(payload)).digest() != s.md5:
            raise ValueError("the stream's length or MD5 does not match")
        out.append(payload)
        at += s.samples
    if at != len(raw):
        raise ValueError("the frames hold more samples than the streams name")
    return out


def _frame_places(s: Stream) -> Iterator[tuple[int, int]]:
    """Frame places by header search alone; decode_frames checks each CRC."""
    at, number, data = s.start, 0, s.data
    while at < len(data):
        number += 1
        head = b"\xff\xf8\x24\x02" + _utf8_number(number)
        head += bytes([crc8(head)])
        end = data.find(head, at + s.min_frame, at + s.max_frame + len(head))
        # A false match inside a frame leaves a wrong CRC-16 before it.
        while end >= 0 and data.find(head, end + 1, at + s.max_frame + len(head)) >= 0 and crc16(data[at:end]):
            end = data.find(head, end + 1, at + s.max_frame + len(head))
        end = len(data) if end < 0 else end
        yield at, end
        at = end


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples of whole frames of 576 samples, one after the other."""
    if _crc_rows(_right(frames), CRC16, True).any():
        raise ValueError("a frame's CRC-16 does not match")
    heads = []
    for f in frames:
        lead = f[4]
        n = 5 + (0 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length() - 1) + 1
        if f[:2] != b"\xff\xf8":
            raise ValueError("a frame has no sync code")
        heads.append(n)
    if _crc_rows(_right([f[:n] for f, n in zip(frames, heads)]), CRC8, False).any():
        raise ValueError("a frame header's CRC-8 does not match")
    out = np.empty((len(frames), BLOCK), np.int32)
    fast, orders, ks = [], [], []
    for i, (f, n) in enumerate(zip(frames, heads)):
        kind = f[n] >> 1
        if f[n] & 1 == 0 and 8 <= kind <= 12 and f[2:4] == b"\x24\x02":
            order = kind - 8
            spec = int.from_bytes(f[n + 1 + order : n + 3 + order], "big") >> 6
            if spec >> 4 == 0 and spec & 15 <= MAX_RICE:
                fast.append(i)
                orders.append(order)
                ks.append(spec & 15)
                continue
        out[i] = decode_frame(f, n)
    if fast:
        out[fast] = _decode_rice([frames[i][heads[i] :] for i in fast], np.array(orders), np.array(ks))
    return out.reshape(-1)


def _decode_rice(bodies: list[bytes], orders: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """Fixed-predictor subframes with one Rice partition, side by side."""
    n, wide = len(bodies), max(map(len, bodies)) + 4
    raw = np.frombuffer(b"".join(b.ljust(wide, b"\0") for b in bodies), np.uint8).reshape(n, wide)
    # The 32 bits from each byte on, as one number.
    words = np.zeros((n, wide), np.uint32)
    for j in range(4):
        words[:, : wide - j] |= raw[:, j:].astype(np.uint32) << np.uint32(24 - 8 * j)
    words = words.reshape(-1)
    last = (np.arange(n, dtype=np.int64) + 1) * (wide * 8) - 1
    pos = np.arange(n, dtype=np.int64) * (wide * 8) + (8 + 8 * orders + 10)
    k, rest = ks.astype(np.uint32), (31 - ks).astype(np.uint32)
    u = np.empty((BLOCK, n), np.int32)
    # A frame of order o has o residuals less; what it reads beyond is dropped.
    for s in range(BLOCK):
        win = words[pos >> 3] << (pos & 7).astype(np.uint32)
        q = _ZEROS[win >> np.uint32(16)]
        if q.max() < 16:
            quotient = q.astype(np.uint32)
        else:
            quotient = q.astype(np.uint32)
            long = np.flatnonzero(q == 16)
            while len(long):  # a run of 16 zeros or more
                pos[long] = np.minimum(pos[long] + 16, last[long])
                win[long] = words[pos[long] >> 3] << (pos[long] & 7).astype(np.uint32)
                q[long] = _ZEROS[win[long] >> np.uint32(16)]
                quotient[long] += q[long]
                long = long[(q[long] == 16) & (pos[long] < last[long])]
        skip = q + np.uint32(1)
        u[s] = (quotient << k) | ((win << skip) >> np.uint32(1)) >> rest
        pos += skip + k
        np.minimum(pos, last, out=pos)
    r = ((u >> 1) ^ -(u & 1)).T
    out = np.empty((n, BLOCK), np.int32)
    for order in np.unique(orders):
        at = np.flatnonzero(orders == order)
        warm = raw[at, 1 : 1 + order].astype(np.int8).astype(np.int32)
        out[at] = _integrate(r[at, : BLOCK - order], warm, order)
    return out


def _integrate(r: np.ndarray, warm: np.ndarray, order: int) -> np.ndarray:
    """Undo ``order`` differences, given the first samples."""
    lead = [warm]
    for _ in range(order):
        lead.append(np.diff(lead[-1], axis=1))
    out = r
    for d in range(order - 1, -1, -1):
        out = np.cumsum(np.concatenate([lead[d][:, :1], out], axis=1), axis=1, dtype=np.int32)
    return out


class _BitReader:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("a frame ends early")
        return (self.value >> self.left) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.read(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        rest = self.value & ((1 << self.left) - 1)
        if not rest:
            raise ValueError("a frame ends early")
        q = self.left - rest.bit_length()
        self.left -= q + 1
        return q


def decode_frame(frame: bytes, head: int, block: int = BLOCK, bits: int = 8) -> np.ndarray:
    """One frame of any subframe type, bit by bit."""
    b = _BitReader(frame[head:-2])
    if b.read(1):
        raise ValueError("a subframe starts with a wrong bit")
    kind = b.read(6)
    wasted = b.unary() + 1 if b.read(1) else 0
    bits -= wasted
    if kind == 0:
        x = [b.signed(bits)] * block
    elif kind == 1:
        x = [b.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 12:
        order = kind - 8
        x = [b.signed(bits) for _ in range(order)]
        coefs = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order]
        for r in _residuals(b, block, order):
            x.append(r + sum(c * v for c, v in zip(coefs, reversed(x))))
    elif kind >= 32:
        order = kind - 31
        x = [b.signed(bits) for _ in range(order)]
        precision, shift = b.read(4) + 1, b.signed(5)
        coefs = [b.signed(precision) for _ in range(order)]
        for r in _residuals(b, block, order):
            x.append(r + (sum(c * v for c, v in zip(coefs, reversed(x))) >> shift))
    else:
        raise ValueError(f"reserved subframe type {kind}")
    return np.array(x, np.int64) << wasted


def _residuals(b: _BitReader, block: int, order: int) -> Iterator[int]:
    width = 4 + b.read(2)
    parts = b.read(4)
    for p in range(1 << parts):
        n = (block >> parts) - (order if p == 0 else 0)
        k = b.read(width)
        if k == (1 << width) - 1:
            raw = b.read(5)
            for _ in range(n):
                yield b.signed(raw)
        else:
            for _ in range(n):
                u = (b.unary() << k) | (b.read(k) if k else 0)
                yield (u >> 1) ^ -(u & 1)


def seek(data: bytes, sample: int, count: int) -> bytes:
    """``count`` samples from one offset on, from the nearest seek point."""
    s = Stream(data)
    first, offset = max((p for p in s.seek if p[0] <= sample), default=(0, 0))
    need, frames = sample + count - first, []
    for at, end in s.frames(s.start + offset, first // s.block):
        frames.append(data[at:end])
        if len(frames) * s.block >= need:
            break
    x = decode_frames(frames)[sample - first : need]
    return (x + 128).astype(np.uint8).tobytes()


def pad(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of the block."""
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def feature(payload: bytes) -> str:
    """Loudness and sign changes of the samples, as exact integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"energy={int((x * x).sum())};peak={int(np.abs(x).max())};sum={int(x.sum())};changes={changes}"


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows that are coded together: their blocks share the array work."""
    return chunked(sizes, SLICE)


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a FLAC stream."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for a, z in _groups([len(t) + 1 for t in texts]):
            media = encode_many([pad(t) for t in texts[a:z]])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array([len(t) for t in texts[a:z]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), byte_text().alias("b")), run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, samples: int = 64 * BLOCK) -> DataFrame:
    """Decoded blocks with their sample offsets: (doc_id, first_sample, pcm)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        streams = batch.column(1).to_pylist()
        for a, z in _groups([len(m) for m in streams]):
            ids, starts, blocks = [], [], []
            for row, pcm in enumerate(decode_many(streams[a:z]), a):
                for at in range(0, len(pcm), samples):
                    ids.append(row)
                    starts.append(at)
                    blocks.append(pcm[at : at + samples])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(blocks, pa.binary())], names=["doc_id", "first_sample", "pcm"])

    return map_batches(media.select("doc_id", "media"), run, "doc_id long, first_sample long, pcm binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: DataFrame) -> DataFrame:
    """What the stored streams of ``to_media`` hold, from their decoded samples."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        streams = batch.column(2).to_pylist()
        for a, z in _groups([len(m) for m in streams]):
            rows = []
            for m, p in zip(streams[a:z], decode_many(streams[a:z])):
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            cols = [batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), *map(pa.array, zip(*rows))]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in DIGEST.split(", ")])

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, DIGEST)
