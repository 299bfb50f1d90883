"""Main text of HTML pages by a maximum-scoring subsequence.

A page becomes a sequence of blocks (the words between two block-level tags) and
tags. A word scores by the block element it stands in, by whether it is link text,
and by the tags, class names and ids of the elements around it; a block scores
the sum over its words, so links pull a block down and running text lifts it. Tags
score below zero. One linear scan finds the contiguous run of blocks and tags
with the highest sum; its blocks of a score above zero are the text.

The weights are learnt from labelled pages, those that mark their content with
``article`` or ``main``: a logistic regression of inside against outside on the
features of the words, all but the marks themselves. It starts from ``PRIOR`` and is
held near it, so what the sample doesn't show keeps its prior weight and what it
shows moves. The sample has at most ``SAMPLE`` distinct pages, those with the
smallest hash; only hashes are ordered, the pages are fetched afterwards. Feature
sets are counted on the executors.

A block takes at most ``BRIDGE`` from a run's sum (less inside the marks), so an advert between two halves
of an article doesn't part them; it scores below zero and is left out.

Defined cases: null html and pages without words give the empty text; markup
that isn't closed is closed by the element around it; a page without ``body`` is
read behind its ``head``, or whole; an element that isn't closed hides no text but
for scripts, styles and the like, which hide the rest as in a browser; repeated
rows each get a result row; among equal sums the first and then the shortest run
wins; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import map_batches

SAMPLE = 2000
BRIDGE = 2.0
#: The same for a block inside the marks.
BRIDGE_MARKED = 0.25
#: Weight of a tag: a run pays it for leading across one.
TAG = -0.05
MARK = 1.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|iframe|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|svg|select)(?=[\s/>])[^>]*>.*?</\2\s*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_START = re.compile(r"<body(?=[\s/>])|</head\s*>", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img label".split())
CONTAINER = frozenset("article main section div nav aside header footer form ul ol li table tr td th dl dd dt figure figcaption blockquote body html button dialog menu fieldset details address p h1 h2 h3 h4 h5 h6 pre".split())
#: Elements that a start tag of the same kind closes.
SIBLING = frozenset("li td th tr dd dt p".split())
#: Elements whose name says something of all they hold.
REGION = frozenset("section nav aside header footer form button dialog menu fieldset address figure table".split())
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Prior weights of class names and ids, of tags and of link text.
_NAMES = (
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer ad ads advert adverts advertisement promo promotion sponsor sponsored banner cookie cookies consent notice gdpr popup "
    "modal newsletter subscribe signup comment comments disqus reply replies share sharing social related recommended recommendations widget login masthead topbar toolbar pager pagination"
)
PRIOR = {f"c:{name}": -4.5 for name in _NAMES.split()}
PRIOR |= {"t:nav": -4.5, "t:aside": -4.5, "t:footer": -4.5, "t:form": -3.0, "t:button": -4.5, "t:dialog": -4.5, "t:menu": -4.5, "t:fieldset": -3.0, "t:header": -1.2}
PRIOR |= {"b": 0.5, "link": -1.5, "mark": MARK}
#: Words of compound names that say no more than the other part does.
_PLAIN = frozenset("site page main top left right bottom post user reader inner outer box bar block wrap wrapper container list section area item items link links content text inline google".split())


def _names(attrs: str) -> list[str]:
    """Features of class names, ids and roles: each name, and for a compound of
    known and plain words the known ones."""
    out = []
    for groups in _ATTR.findall(attrs):
        for name in " ".join(groups).lower().split():
            if f"c:{name}" in PRIOR:
                out.append(f"c:{name}")
                continue
            parts = [p for p in re.split(r"[_-]+", name) if p]
            known = [p for p in parts if f"c:{p}" in PRIOR]
            if known and all(p in _PLAIN or p in known for p in parts):
                out += [f"c:{p}" for p in known]
            out.append(f"c:{name[:32]}")
    return out


class Node:
    __slots__ = ("name", "features", "marked")

    def __init__(self, name: str, features: frozenset, marked: bool):
        self.name, self.features, self.marked = name, features, marked


def tokens(page: str) -> Iterator[tuple[str, str, frozenset, bool]]:
    """(tag, "", ...) for a tag that parts blocks, and ("", text, features, marked)
    for a run of characters; ``marked`` is whether ``article`` or ``main`` is around it."""
    at = 0
    for m in _START.finditer(page):
        at = m.start()
        if m[0][1] != "/":
            break
    stack = [Node("body", frozenset(), False)]
    link, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        start = m.start() if m else size
        if start > at:
            top = stack[-1]
            yield "", page[at:start], top.features | {f"b:{top.name}", "link" if link else "b"}, top.marked
        if not m:
            return
        at = m.end()
        if m[4] is None:
            continue
        name, attrs = m[4].lower(), m[5] or ""
        if name in INLINE:
            if name == "a":
                link = 0 if m[3] else 1
            elif name == "br":
                yield "", " ", stack[-1].features, stack[-1].marked
            continue
        link = 0
        yield name, "", frozenset(), False
        if name not in CONTAINER:
            continue
        if m[3]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        top = stack[-1]
        if top.name == name and name in SIBLING or top.name == "p":
            stack.pop()
            top = stack[-1] if stack else Node("body", frozenset(), False)
            stack = stack or [top]
        marks = name in ("article", "main") or bool(attrs) and re.search(r"\brole\s*=\s*[\"']?main\b", attrs, re.I) is not None
        features = top.features
        if name in REGION:
            features = features | {f"t:{name}"}
        if attrs and name not in ("body", "html"):
            features = features.union(_names(attrs))
        if not attrs.endswith("/"):
            stack.append(Node(name, features, top.marked or marks))


def blocks(page: str) -> Iterator[tuple[str, str, list]]:
    """(tag, "", []) and ("", text, [(features, marked, words)])."""
    text, runs = [], []
    for tag, run, features, marked in tokens(page):
        if not tag:
            text.append(run)
            n = len(run.split())
            if n:
                runs.append((features, marked, n))
            continue
        if runs:
            yield "", "".join(text), runs
        text, runs = [], []
        yield tag, "", []
    if runs:
        yield "", "".join(text), runs


def count_features(page: str) -> Counter | None:
    """Words by (features, marked), if any are marked."""
    out: Counter = Counter()
    for _, _, runs in blocks(page):
        for features, marked, n in runs:
            out[(features, marked)] += n
    return out if any(marked for _, marked in out) else None


def learn(counts: dict[tuple[frozenset, bool], int], rounds: int = 300, hold: float = 0.02) -> dict[str, float]:
    """Weights of a logistic regression of marked words against others, from the
    prior on and held near it."""
    if not counts:
        return dict(PRIOR)
    names = sorted({f for features, _ in counts for f in features})
    at = {f: i for i, f in enumerate(names)}
    order = sorted(counts, key=lambda k: (sorted(k[0]), k[1]))
    rows = np.repeat(np.arange(len(order)), [len(k[0]) for k in order])
    cols = np.array([at[f] for k in order for f in sorted(k[0])], np.int64)
    inside = np.array([k[1] for k in order], float)
    n = np.array([counts[k] for k in order], float)
    # Both sides weigh the same, whatever their numbers of words.
    n = np.where(inside > 0, n / max(1, n[inside > 0].sum()), n / max(1, n[inside == 0].sum())) / 2
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    w = prior.copy()
    steps = np.ones(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], len(order)), -30, 30)))
        up = np.bincount(cols, (n * (inside - p))[rows], len(names)) - hold * (w - prior)
        steps += up * up
        w += up / np.sqrt(steps) * 4
    out = dict(PRIOR)
    out.update(zip(names, np.clip(w, -6, 3).tolist()))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the highest sum above zero, in one scan."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, span = total, (start, i + 1)
    return span


def extract(page: str, weight: dict[str, float]) -> str:
    """The text of the best run."""
    parts, scores = [], []
    mark, known = weight.get("mark", MARK), {}
    for tag, text, runs in blocks(page):
        total = TAG
        if not tag:
            total = 0.0
            for features, marked, n in runs:
                w = known.get(features)
                if w is None:
                    w = known[features] = sum(weight.get(f, 0.0) for f in features)
                total += n * max(-4.0, min(2.0, w + mark * marked))
        parts.append(text)
        scores.append(max(total, -(BRIDGE_MARKED if runs and runs[0][1] else BRIDGE)))
    a, b = best_run(scores)
    shown = (" ".join(entities.unescape(p).split()) for p, x in zip(parts[a:b], scores[a:b]) if x > 0)
    return "\n\n".join(t for t in shown if t)


def train(spark: SparkSession, pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` distinct labelled pages, the smallest by hash."""
    marked = F.lower("html").rlike(r"<(?:article|main)\b|role\s*=\s*.?main")
    keyed = pages.where(marked).select(F.xxhash64("page_id", "html").alias("h"), "html")
    chosen = keyed.select("h").distinct().orderBy("h").limit(sample)
    found = keyed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(count_features(page) or ())
        keys = list(total)
        cols = [pa.array([sorted(k[0]) for k in keys], pa.list_(pa.string())), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["f", "marked", "n"])

    counted = found.select("html").mapInArrow(run, "f array<string>, marked boolean, n long").groupBy("f", "marked").agg(F.sum("n").alias("n"))
    return learn({(frozenset(r.f), r.marked): r.n for r in counted.collect()})  # as many as a bounded sample has


def main_text(spark: SparkSession, pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    weight = train(spark, pages) if weight is None else weight

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [extract(p or "", weight) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(src, run, "page_id long, url string, text string, n_chars long")
