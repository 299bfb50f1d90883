"""Line dedup by content-defined chunks.

A rolling hash over the hashes of ``WINDOW`` consecutive lines chooses boundaries:
one window in ``DIVISOR`` ends a chunk, so a boundary depends on the lines before
it alone and shifts with them. Finer chunks catch short blocks: every window is a
chunk of its own but where its rolling hash is the highest of the ``2 * SPREAD + 1``
around it. Of two windows side by side one at least is a chunk, whatever is around
them, so any block of three lines and more holds one; a block of two lines holds one
if its window is chosen in both places (about 5 of 6).

Chunks of two lines and more are grouped by a 128-bit digest of their bytes, with
values of fixed width alone. A chunk that stands at an earlier place (smallest
doc_id, then position) is a repeat. Repeats of one document in one other are joined
to segments; the bytes of the earlier place, with a line on either side, are sent
to the later one, compared there, and the segment grows over the lines that are
equal too. What is equal goes; the first place of every line stays, as no earlier
place holds it. Chunks of empty lines, which part paragraphs, don't count, nor does
one that overlaps its own first place.

A hot chunk has a row for each of its places, which Spark splits where the places
are joined with their first; texts move by row, in one exchange that both joins
read.

Defined cases: null texts stay null; texts of one line, and empty ones, are left
alone; lines are what newlines part; a document that repeats a block keeps the
first; repeated rows are rows of their own, and the later lose their repeated
blocks; ties in doc_id are settled by the row's place in the input; null ids come
last; empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import byte_text, chunked, discard, free_name, map_batches, materialize

WINDOW = 2
#: One window in four ends a chunk.
DIVISOR = 4
SPREAD = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split(text: bytes) -> list[bytes]:
    """Lines without their newlines."""
    out = text.split(b"\n")
    return out if out[-1] else out[:-1]


def _rolling(lines: list[bytes]) -> np.ndarray:
    """Hash of the window that ends at each line; the first ones are shorter."""
    one = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    h = one.copy()
    for k in range(1, WINDOW):
        h[k:] += one[:-k] * np.uint64(pow(int(_MIX), k, 1 << 64))
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h >> np.uint64(1)


def boundaries(lines: list[bytes]) -> list[int]:
    """Ends (exclusive) of the chunks that make up a text."""
    ends = (np.flatnonzero(_rolling(lines) % np.uint64(DIVISOR) == 0) + 1).tolist() if lines else []
    return ends if not lines or ends and ends[-1] == len(lines) else [*ends, len(lines)]


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, lines) of all chunks of two lines and more, the finer ones included."""
    if len(lines) < WINDOW:
        return []
    ends = boundaries(lines)
    out = {(a, z - a) for a, z in zip([0, *ends], ends) if z - a > 1}
    r = _rolling(lines)[WINDOW - 1 :]
    padded = np.concatenate([np.zeros(SPREAD, np.uint64), r, np.zeros(SPREAD, np.uint64)])
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * SPREAD + 1)
    out_of = (r == around.max(axis=1)) & ((around == r[:, None]).sum(axis=1) == 1)
    out_of[0] = out_of[-1] = False
    out |= {(i, WINDOW) for i in np.flatnonzero(~out_of).tolist()}
    return sorted((a, n) for a, n in out if any(lines[a : a + n]))


def _places(rows: DataFrame, uid: str) -> DataFrame:
    """(h1, h2, uid, id, pos, n): digests of all chunks."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(2).to_pylist()
        for a, z in chunked([len(t) + 64 for t in texts], 8 << 20):
            digests, take, pos, size = [], [], [], []
            for row in range(a, z):
                lines = split(texts[row])
                for i, n in chunks(lines):
                    digests.append(blake2b(b"\n".join(lines[i : i + n]), digest_size=16).digest())
                    take.append(row)
                    pos.append(i)
                    size.append(n)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(take, pa.int64())
            cols = [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "uid", "id", "pos", "n"])

    return map_batches(rows.select(uid, F.col("doc_id").cast("long"), byte_text()), run, "h1 long, h2 long, uid long, id long, pos int, n int")


def segments(marks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(place, first place, lines) of repeats that meet, joined."""
    out: list[list[int]] = []
    for pos, first, n in sorted(marks, key=lambda m: (m[0] - m[1], m[0])):
        if out and out[-1][0] - out[-1][1] == pos - first and pos <= out[-1][0] + out[-1][2]:
            out[-1][2] = max(out[-1][2], pos + n - out[-1][0])
        else:
            out.append([pos, first, n])
    return [tuple(x) for x in out]


def _first_bytes(rows: DataFrame, uid: str, later: DataFrame) -> DataFrame:
    """(uid, parts): the lines of each segment's first place, and those next to it."""
    marks = later.groupBy("uid", "first_uid").agg(F.collect_list(F.struct("pos", "first_pos", "n")).alias("marks"))
    own = [free_name(rows, x) for x in ("later", "first", "marks")]
    marks = marks.toDF(*own)
    text = rows.columns.index("text")
    width = len(rows.columns)
    part = "struct<pos:int,n:int,before:binary,body:binary,after:binary>"
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("before", pa.binary()), ("body", pa.binary()), ("after", pa.binary())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, 64):
            piece = batch.slice(a, 64)
            out = []
            for t, found in zip(piece.column(text).to_pylist(), piece.column(width + 2).to_pylist()):
                lines = split((t or "").encode())
                at = lambda i, lines=lines: lines[i] if 0 <= i < len(lines) else None
                out.append([(p, n, at(f - 1), b"\n".join(lines[f : f + n]), at(f + n)) for p, f, n in segments([tuple(m.values()) for m in found])])
            yield pa.RecordBatch.from_arrays([piece.column(width), pa.array([[dict(zip(("pos", "n", "before", "body", "after"), x)) for x in p] for p in out], kind)], names=["uid", "parts"])

    joined = rows.join(marks.hint("merge"), rows[uid] == marks[own[1]]).select(*rows.columns, *own)
    return map_batches(joined, run, f"uid long, parts array<{part}>")


def repeated(lines: list[bytes], parts: list[dict]) -> set[int]:
    """Lines that are byte for byte at an earlier place."""
    out: set[int] = set()
    for p in parts:
        a, z = p["pos"], p["pos"] + p["n"]
        if b"\n".join(lines[a:z]) != p["body"]:
            continue  # two chunks with one digest
        out.update(range(a, z))
        if a and p["before"] is not None and lines[a - 1] == p["before"]:
            out.add(a - 1)
        if z < len(lines) and p["after"] is not None and lines[z] == p["after"]:
            out.add(z)
    return out


def dedup(spark: SparkSession, docs: DataFrame, counts: bool = False) -> DataFrame:
    """All columns, with repeated blocks of two lines and more taken out of the text.

    With ``counts``: doc_id, text, n_chunks and n_removed instead, of the chunks
    that make up the text and those of them that are taken out whole.
    """
    if counts:
        docs = docs.select("doc_id", "text")
    uid = free_name(docs, "uid")
    rows = materialize(spark, docs.withColumn("text", F.col("text").cast("string")).withColumn(uid, F.monotonically_increasing_id()), "line-docs")
    # No id is null; said here, both joins below read the rows through one exchange.
    rows = rows.where(F.col(uid).isNotNull())
    places = materialize(spark, _places(rows, uid), "line-chunks")
    place = F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "uid", "pos")
    first = places.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count("*").alias("many")).where("many > 1")
    # As a table of its own both sides of the join are plain shuffles, which Spark
    # splits where one chunk has very many places.
    first = materialize(spark, first.select("h1", "h2", F.col("at.uid").alias("first_uid"), F.col("at.pos").alias("first_pos")), "line-firsts")
    later = places.join(first.hint("merge"), ["h1", "h2"]).where("uid <> first_uid or pos >= first_pos + n")
    later = materialize(spark, later.select("uid", "first_uid", "pos", "first_pos", "n"), "line-repeats")
    discard(places, first)
    # As many parts as a document has lines at most.
    parts = _first_bytes(rows, uid, later).groupBy("uid").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    own = [free_name(rows, x) for x in ("later", "parts")]
    parts = parts.toDF(*own)
    both = rows.join(parts.hint("merge"), rows[uid] == parts[own[0]], "left").select(*rows.columns, own[1])
    schema = docs.withColumn("text", F.col("text").cast("string")).schema
    schema = schema.add("n_chunks", "long").add("n_removed", "long") if counts else schema
    text, width = rows.columns.index("text"), len(rows.columns)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(text).to_pylist()
        for a, z in chunked([len(t or "") + 64 for t in texts], 8 << 20):
            piece = batch.slice(a, z - a)
            new, n_chunks, n_removed = texts[a:z], [], []
            for row, found in enumerate(piece.column(width).to_pylist()):
                t = new[row]
                whole = (t or "").split("\n")
                out: set[int] = set()
                if found:
                    out = repeated(split(t.encode()), found)
                    new[row] = "".join(x + "\n" * (i + 1 < len(whole)) for i, x in enumerate(whole) if i not in out)
                if counts:
                    ends = boundaries(split(t.encode())) if t else []
                    n_chunks.append(len(ends))
                    n_removed.append(sum(out.issuperset(range(b, e)) for b, e in zip([0, *ends], ends)) if out else 0)
            cols = [pa.array(new, pa.string()) if i == text else piece.column(i) for i in range(width - 1)]
            cols += [pa.array(n_chunks, pa.int64()), pa.array(n_removed, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return map_batches(both, run, schema)
