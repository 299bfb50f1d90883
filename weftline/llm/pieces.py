"""SentencePiece encoding and decoding by a streaming Viterbi.

The lattice of a text has a node at each character boundary and an arc for each
piece. A text is read in windows of ``WINDOW`` times the longest piece. In a
window the forward pass gives every node the best way to it and a backpointer;
arcs into later nodes can only start at the last nodes, as many as the longest
piece has characters. Where the ways to all of these run through one boundary,
the ids before it are final: they are committed, and the next window starts
there. A window whose ways don't meet yet is read again at twice the width, so
memory follows the window and the open part, not the text.

All windows of a group of texts advance side by side: step s of the forward pass
handles the arcs into node s of every window as one array. Texts are cut at the
boundaries that no piece crosses (before a space mark, if no piece holds one
behind another character, and around a newline), where all ways meet whatever
the text is; equal segments of a group share one lattice. Nothing outlives its
group but the model and a table of known pairs of pieces, whose sizes are fixed.

A unigram model keeps the way of the highest sum of piece scores. A BPE model's
encoding of a prefix is unique, so a node has one valid way: the arc whose
piece follows the piece before it as the merges would leave them. Two adjacent
pieces are compatible exactly if merging their joined characters gives these
two again. The result is the model's own encoding.

Defined cases: null text gives null ids and null decoded text; empty text gives
no ids; characters the model lacks become their bytes; repeated rows each get a
result row; of ways with one sum the one whose last piece is longest wins; empty
tables give empty results; other columns of the input are kept by ``encode``,
those named ``ids``, ``n_ids`` and ``exact`` renamed.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm._common import chunked, rename_clashes

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Width of a window, in longest pieces.
WINDOW = 16
#: Characters of the texts that are encoded side by side.
GROUP = 1 << 20
#: Places for known pairs of pieces, a power of two.
PAIR_BITS = 19
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value, at
            shift += 7

    while at < end:
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class _Table:
    """A map of long keys to ints with open addressing, for whole arrays."""

    def __init__(self, bits: int):
        self.bits, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.zeros(self.mask + 1, np.int32)
        self.n = 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (held != -1)
            todo, at = todo[go], at[go]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that aren't there yet."""
        self.n += len(keys)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of those that meet one stays
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & self.mask


class Model:
    """Pieces, scores and normaliser settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.prefix, self.squeeze = UNIGRAM, True, True
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif field == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("a model with a character map is not supported")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.penalty = min(self.scores, default=0.0) - 10.0
        self._tree()
        # Boundaries that no arc crosses: before a space mark, if no piece holds
        # one behind another character, and around a newline, if none holds it.
        marks = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        breaks = not any("\n" in p for p in self.ids if len(p) > 1)
        self.cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+") if marks and breaks else re.compile(r".+", re.S)
        self.pairs = _Table(PAIR_BITS)
        self.whole = np.full(len(self.pieces), -1, np.int8)
        self.made: dict[int, tuple[int, int] | None] = {}
        self.odd = False  # whether a piece scores better than one that it is made of
        self._scores = np.array(self.scores)
        self.text = [_shown(p) if k != BYTE else None for p, k in zip(self.pieces, self.kinds)]

    def _tree(self) -> None:
        """Beginnings of pieces as states, and the steps between them."""
        begins: dict[str, int] = {"": 0}
        for p in self.ids:
            for n in range(1, len(p) + 1):
                begins.setdefault(p[:n], len(begins))
        chars = sorted({c for p in self.ids for c in p})
        self.classes = np.zeros(0x110000, np.int16 if len(chars) < 1 << 15 else np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        of = {c: i for i, c in enumerate(chars, 1)}
        self.n_classes = len(chars) + 1
        self.piece_of = np.full(len(begins), -1, np.int32)
        for p, i in self.ids.items():
            self.piece_of[begins[p]] = i
        keys = np.array([begins[p[:-1]] * self.n_classes + of[p[-1]] for p in begins if p], np.int64)
        self.steps = _Table(max(4, (2 * len(begins)).bit_length()))
        self.steps.put(keys, np.array([i for p, i in begins.items() if p], np.int32))

    # -- merges

    def merged(self, chars: list[str]) -> list[str]:
        """Best merge first, leftmost among equals, until none is left."""
        parts, ids, scores = list(chars), self.ids, self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], i
            if at < 0 or len(parts) == 2:
                return parts if at < 0 else [*parts, parts[0] + parts[1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def parts(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that a piece is merged from at last; None for a
        character, (-1, -1) for a piece that merges never make."""
        if piece not in self.made:
            chars = self.pieces[piece]
            last = self.merged([*chars]) if len(chars) > 1 else None
            made = None if last is None else (-1, -1)
            if last is not None and len(last) == 3 and all(c in self.ids for c in last[:2]):
                made = self.ids[last[0]], self.ids[last[1]]
                self.odd |= min(self.scores[p] if len(self.pieces[p]) > 1 else self.scores[piece] + 1 for p in made) <= self.scores[piece]
            elif last is not None and len(last) == 3:
                self.odd = True  # made of characters that are no pieces themselves
                made = -2, -2
            self.made[piece] = made
        return self.made[piece]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces leaves these two.

        The merges are undone, the last first. Two pieces that stand side by side
        at some moment would have been merged if that scores better than the merge
        which parted them.
        """
        ids, scores, pieces = self.ids, self.scores, self.pieces
        one, two = pieces[left], pieces[right]
        limit, tie = float("-inf"), False
        while not self.odd:
            both = ids.get(pieces[left] + pieces[right])
            if both is not None and (scores[both] > limit or tie and scores[both] == limit):
                return False
            x, y = self.parts(left), self.parts(right)
            if x is None and y is None:
                return True
            if y is None or x is not None and scores[left] < scores[right]:
                limit, tie, left = scores[left], False, x[1]
            else:
                limit, tie, right = scores[right], True, y[0]
        return one + two not in ids and self.merged([*one, *two]) == [one, two]

    def _fits(self, left: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether BPE ways that end in ``left`` may go on with ``piece``; -1 is a
        character without a piece, or the beginning, and -2 no way at all."""
        out = left != -2
        both = np.flatnonzero((left >= 0) & (piece >= 0))
        keys = left[both].astype(np.int64) << 24 | piece[both]
        good = self.pairs.get(keys)
        new = np.unique(keys[good < 0])
        if len(new):
            if self.pairs.n + len(new) > self.pairs.mask // 2:
                self.pairs.clear()
            found = np.fromiter((self.follows(k >> 24, k & 0xFFFFFF) for k in new.tolist()), np.int32, len(new))
            if len(new) <= self.pairs.mask // 2:
                self.pairs.put(new, found)
            good = np.where(good < 0, found[np.minimum(np.searchsorted(new, keys), len(new) - 1)], good)
        out[both] = good > 0
        return out

    def _arcs(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of all arcs between nodes; piece -1 for a character without one."""
        kinds = self.classes[chars].astype(np.int64)
        lane = np.repeat(np.arange(len(sizes)), sizes)
        node = np.arange(len(chars)) + lane
        room = (np.cumsum(sizes + 1) - 1)[lane] - node
        at = np.flatnonzero(kinds)
        state = self.steps.get(kinds[at])
        lone = np.ones(len(chars), bool)
        begins, ends, pieces = [], [], []
        for k in range(1, self.longest + 1):
            piece = self.piece_of[state]
            has = piece >= 0
            begin = node[at[has]]
            begins.append(begin)
            ends.append(begin + k)
            pieces.append(piece[has])
            if k == 1:
                lone[at[has]] = False
            more = room[at] > k
            at, state = at[more], state[more]
            if not len(at):
                break
            state = self.steps.get(state.astype(np.int64) * self.n_classes + kinds[at + k])
            more = state >= 0
            at, state = at[more], state[more]
        begins.append(node[lone])
        ends.append(node[lone] + 1)
        pieces.append(np.full(len(begins[-1]), -1, np.int32))
        begin, end, piece = np.concatenate(begins), np.concatenate(ends), np.concatenate(pieces)
        if self.type == BPE:  # pieces that merges never make are no arcs
            for p in np.unique(piece[self.whole[piece] < 0]).tolist():
                if p >= 0:
                    self.whole[p] = self.parts(p) != (-1, -1)
            keep = (piece < 0) | (self.whole[piece] > 0)
            begin, end, piece = begin[keep], end[keep], piece[keep]
        return begin, end, piece

    def _window(self, texts: list[str], left: np.ndarray, last_one: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward passes over a window of each lane, and what they commit.

        ``left`` is the piece before each window, ``last_one`` whether its text
        ends there. Returns the number of characters committed and the piece
        before that boundary by lane, and lane and id of all committed ids.
        """
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.cumsum(sizes + 1) - 1
        start = stop - sizes
        begin, end, piece = self._arcs(chars, sizes)
        lane = np.repeat(np.arange(len(sizes)), sizes + 1)
        step = end - start[lane[end]]
        order = np.argsort(step.astype(np.int16) if step.max(initial=0) < 1 << 15 else step, kind="stable")
        begin, end, piece = begin[order], end[order], piece[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(step, minlength=1))]).tolist()
        # A node that no way from the window's start leads to isn't on the final way.
        back, last = np.full(len(lane), -1), np.full(len(lane), -2, np.int32)
        last[start] = left
        best = np.zeros(len(lane))
        cost = np.where(piece >= 0, self._scores[piece], self.penalty)
        for a, z in zip(edges[1:], edges[2:]):
            x, y, p = begin[a:z], end[a:z], piece[a:z]
            if self.type == BPE:
                ok = self._fits(last[x], p)
                x, y, p = x[ok], y[ok], p[ok]
            else:
                total = best[x] + cost[a:z]
                o = np.lexsort((-x, total))  # the best comes last, and stays
                x, y, p = x[o], y[o], p[o]
                best[y] = total[o]
            back[y], last[y] = x, p
        # Where do the ways to the nodes that later arcs can start from all meet?
        ways = np.maximum(stop[:, None] - np.arange(self.longest), start[:, None])
        ways[last_one] = stop[last_one, None]
        open_ = np.arange(len(sizes))
        while len(open_):
            w = ways[open_]
            top = w.max(axis=1)
            open_, w, top = (v[top > w.min(axis=1)] for v in (open_, w, top))
            ways[open_] = np.where(w == top[:, None], back[top][:, None], w)
        cut = ways[:, 0]
        at = np.flatnonzero(cut > start)
        nodes, now = [], cut[at]
        while len(now):
            nodes.append(now)
            now = back[now]
            now = now[now > start[lane[now]]]
        at = np.sort(np.concatenate(nodes)) if nodes else np.zeros(0, np.int64)
        ids, whose = last[at], lane[at]
        lost = np.flatnonzero(ids < 0)
        if len(lost):  # characters without a piece, as their bytes
            points, kind = np.unique(chars[at[lost] - 1 - whose[lost]], return_inverse=True)
            spelt = [self.encode_piece(chr(c)) for c in points.tolist()]
            n = np.ones(len(ids), np.int64)
            n[lost] = np.array([len(x) for x in spelt])[kind]
            first = np.cumsum(n) - n
            ids, whose = np.repeat(ids, n), np.repeat(whose, n)
            for j in range(max(map(len, spelt))):
                have = np.array([len(x) > j for x in spelt])[kind]
                ids[first[lost[have]] + j] = np.array([x[j] if len(x) > j else 0 for x in spelt], np.int32)[kind[have]]
        return cut - start, last[cut], whose, ids

    def _stream(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text number, id) of what each round of windows commits, in order by text."""
        at, left = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int32)
        width = np.full(len(texts), WINDOW * self.longest)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        todo = np.flatnonzero(sizes)
        while len(todo):
            ends = at[todo] + width[todo]
            windows = [texts[i][a:z] for i, a, z in zip(todo.tolist(), at[todo].tolist(), ends.tolist())]
            done, piece, whose, ids = self._window(windows, left[todo], ends >= sizes[todo])
            yield todo[whose], ids
            width[todo] = np.where(done > 0, WINDOW * self.longest, 2 * width[todo])
            at[todo] += done
            left[todo] = np.where(done > 0, piece, left[todo])
            todo = todo[at[todo] < sizes[todo]]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Committed ids of a normalised text, in order."""
        for _, ids in self._stream([text]):
            if len(ids):
                yield ids.tolist()

    def encode_piece(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8")]
        return [self.unknown]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one behind the other, and how many each has."""
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__
        at: list[int] = []
        many = np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts):
            parts = self.cut.findall(self.normalise(text))
            many[n] = len(parts)
            at += map(known.__getitem__, parts)
        rounds = list(self._stream(list(known)))
        whose = np.concatenate([r[0] for r in rounds]) if rounds else np.zeros(0, np.int64)
        ids = np.concatenate([r[1] for r in rounds]) if rounds else np.zeros(0, np.int32)
        if len(rounds) > 1:
            order = np.argsort(whose, kind="stable")
            whose, ids = whose[order], ids[order]
        n_ids = np.bincount(whose, minlength=len(known))
        first = np.cumsum(n_ids) - n_ids
        used = np.array(at, np.int64)
        n = n_ids[used]
        out = ids[np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(many)]
        return out, np.diff(np.concatenate([[0], ends]))

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        text = self.text
        try:
            out = "".join([text[i] for i in ids])
        except TypeError:
            out = self._decode_bytes(ids)
        return out[1:] if self.prefix and out[:1] == " " else out

    def _decode_bytes(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            piece = self.text[i]
            if piece is None:
                run.append(int(self.pieces[i][3:5], 16))
            else:
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(piece)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


def _shown(piece: str) -> str:
    return piece.replace(SPACE, " ")


_MODEL: list[tuple[bytes, Model]] = []


def _model(data: bytes) -> Model:
    """The worker's one model. It takes some 30 MB, whatever it reads."""
    if not _MODEL or _MODEL[0][0] != data:
        _MODEL[:] = [(data, Model(data))]
    return _MODEL[0][1]


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes, read on the driver (under 1 MB) and shipped."""
    with open(path, "rb") as f:
        return f.read()


def encode(spark: SparkSession, docs: DataFrame, model: bytes) -> DataFrame:
    """All columns, with ids array<int>, n_ids and whether decoding gives the text."""
    docs = rename_clashes(docs, {"ids", "n_ids", "exact"})
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema]).add("ids", T.ArrayType(T.IntegerType())).add("n_ids", "long").add("exact", "boolean")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            for a, z in chunked([len(t or "") + 64 for t in texts], GROUP):
                part = b.slice(a, z - a)
                flat, n = m.encode_many([t or "" for t in texts[a:z]])
                edges = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                same = [None if t is None else m.decode(flat[i:j].tolist()) == t for t, i, j in zip(texts[a:z], edges.tolist(), edges[1:].tolist())]
                none = pa.array([t is None for t in texts[a:z]])
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, pa.int32()), mask=none)
                cols = [ids, pa.array(n, mask=none.to_numpy(zero_copy_only=False)), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, "ids", "n_ids", "exact"])

    return docs.mapInArrow(run, schema)


def decode(spark: SparkSession, encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared.value)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
