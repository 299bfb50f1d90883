"""Pieces against the library, pages, lines, passages, quality, pipeline."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import htmltext, lines, passages, pieces, quality

D = "/root/testdata/sf0.001"


# --- pieces -----------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    if not os.path.exists(pieces.DEFAULT_MODEL):
        pytest.skip("no vocabulary file")
    return pieces.read_model()


def noise(rng, n):
    return "".join(rng.choice(["a", "b", " ", "e", "\n", " ", "▁", "th", "é", "x1", "\t", "ñ", "日本", "🙂", "  "]) for _ in range(n))


def test_ids_are_the_models_own(model):
    spm = pytest.importorskip("sentencepiece")
    m, lib = pieces.Model(model), spm.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rng = random.Random(1)
    texts = ["", " ", "  a  b ", "a" * 300, "x" * 2000, "=" * 1500, "\n\n x", "a" * 50 + " " * 40 + "b", "".join(chr(rng.randrange(97, 110)) for _ in range(2000)), "日本x" * 400]
    texts += [noise(rng, rng.randrange(60)) for _ in range(400)]
    for t in texts:
        want = lib.encode(t)
        assert m.encode(t) == want, t
        assert [i for part in m.stream(m.normalise(t)) for i in part] == want, t  # without cuts
        if "▁" not in t:
            assert m.decode(want) == t


def test_unigram_viterbi_is_the_best_path(model):
    m = pieces.Model(model)
    m.type, m._scores = pieces.UNIGRAM, np.array([-len(p) ** 0.5 - i / 40_000 for i, p in enumerate(m.pieces)])
    m.scores = m._scores.tolist()
    rng = random.Random(2)
    for n in [*range(1, 60), 300, 1000]:
        t = "".join(rng.choice("etaoin") for _ in range(n))
        best = [0.0] + [None] * len(t)
        for end in range(1, len(t) + 1):
            for begin in range(max(0, end - m.longest), end):
                i = m.ids.get(t[begin:end])
                if i is not None and (best[end] is None or best[begin] + m.scores[i] > best[end]):
                    best[end] = best[begin] + m.scores[i]
        got = [i for part in m.stream(t) for i in part]
        assert "".join(m.pieces[i] for i in got) == t and abs(sum(m.scores[i] for i in got) - best[-1]) < 1e-6


def test_commits_are_early(model):
    m = pieces.Model(model)
    widths = []
    plain = m._window
    m._window = lambda texts, *rest: widths.extend(map(len, texts)) or plain(texts, *rest)
    parts = list(m.stream("▁" + "the▁cat▁" * 500))
    assert len(parts) > 10 and max(widths) == pieces.WINDOW * m.longest
    # Ways that don't meet within a window: it is read again, wider.
    lone = pieces.Model(model)
    lone.type, lone.ids = pieces.UNIGRAM, {p: i for p, i in lone.ids.items() if p in ("a", "aa", "aaa")}
    lone.longest, lone._scores = 3, np.zeros(len(lone.pieces))
    lone._tree()
    assert "".join(lone.pieces[i] for part in lone.stream("a" * 1001) for i in part) == "a" * 1001


def test_encode_frames(spark, model):
    df = spark.createDataFrame([(1, "the cat"), (2, None), (3, ""), (1, "the cat"), (4, "x" * 20_000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = pieces.encode(spark, df, model)
    assert "in_ids" in out.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].ids is None and rows[3].ids == [] and all(r.exact for i, r in rows.items() if i != 2) and out.count() == 5
    assert {r.doc_id: r.text for r in pieces.decode(spark, out, model).collect()} == {1: "the cat", 2: None, 3: "", 4: "x" * 20_000}
    assert pieces.encode(spark, df.where("false"), model).count() == 0


# --- pages ------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header><h1>Site name</h1><a href="/">Home</a></header><div class="cookie-notice">We use cookies, please accept all of them now</div>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="content"><h2>Title &amp; more</h2><p>First   paragraph with quite some words and an <a href="x">inline link</a> inside.<!-- note -->
<script>var t="</p>";</script><p>Unclosed paragraph, with <b>bold words<br>and a break.
<form><input> Sign up to our newsletter now</form><div class="ad">Buy this thing today</div><ul><li>item one of list<li>item two of list</ul></div>
<div id="comments"><p>Great article, I liked it very much, thanks for posting this here</p></div><footer>&copy; words</footer></body></html>"""


LEARNT = {"b": 1.4, "b:p": 1.3, "b:div": -0.3, "b:li": 0.0}


def test_main_text():
    got = htmltext.extract(PAGE, htmltext.PRIOR)
    assert got == "Title & more\n\nFirst paragraph with quite some words and an inline link inside.\n\nUnclosed paragraph, with bold words and a break."
    assert htmltext.extract(PAGE, htmltext.PRIOR | LEARNT) == got + "\n\nitem one of list\n\nitem two of list"
    for odd in ("", "no markup at all", "<p>", "<<<>>>", "<div" * 50, "<!-- never closed", "<script>x", "<p a='>'>text</p>", "</p></p><li></li>"):
        assert isinstance(htmltext.extract(odd, htmltext.PRIOR), str)
    assert htmltext.extract("no markup at all", htmltext.PRIOR) == "no markup at all"


P = "<p>Some words of the text for all to read, and more of them.</p>"
TEXT = "Some words of the text for all to read, and more of them."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><header><h1>Title of it</h1></header><div>{P * 3}</div></body>", ["Title of it", TEXT, TEXT, TEXT]),
        (P * 3, [TEXT] * 3),
        (f"<head><title>x</title>{P * 2}", [TEXT] * 2),
        (f"<head-line>Big</head-line>{P * 2}", ["Big", TEXT, TEXT]),
        (f'<body><div class="related-work">{P * 2}</div><div class="side-effects">{P}</div><div id="search-results">{P}</div>', [TEXT] * 4),
        (f'<body><div class="page has-sidebar"><form><article>{P * 2}</article></form><div class="left-sidebar">{P}</div></div>', [TEXT] * 2),
        (f"<article>{P}<div class='ad-box'>{P}</div><nav>one two</nav><p>Short.</p></article><section id='comments'>{P}</section>", [TEXT, "Short."]),
        (f"<body>{P}<svg><text>no</text></svg><select><option>no{P}", [TEXT, "no", TEXT]),
    ],
)
def test_odd_pages(page, want):
    assert htmltext.extract(page, htmltext.PRIOR | LEARNT).split("\n\n") == want


def test_best_run_is_the_best():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.choice([-3, -2, -1, -0.5, 0.5, 1, 2]) for _ in range(rng.randrange(14))]
        a, b = htmltext.best_run(x)
        assert sum(x[a:b]) == max((sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1)), default=0)


def test_the_scan_cuts_what_no_list_names(monkeypatch):
    monkeypatch.setattr(htmltext, "PRIOR", {"mark": htmltext.MARK})
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefgh") * 3 for _ in range(n))

    def page(mark):
        links = "".join(f"<li><a href=x>{say(2)}</a></li>" for _ in range(6))
        parts = [say(rng.randrange(2, 40)) for _ in range(rng.randrange(1, 6))]
        text = "".join(f"<p>{x}</p>" for x in parts)
        html = f"<body><div class=zig><ul>{links}</ul></div><{mark}>{text}</{mark}><div class=zag><span>{say(12)}</span></div><td>{say(9)}</td></body>"
        return html, "\n\n".join(parts)

    counts = sum((htmltext.count_features(page("article")[0]) for _ in range(60)), htmltext.Counter())
    weight = htmltext.learn(counts)
    for _ in range(60):  # pages that mark nothing
        html, want = page("div")
        assert htmltext.extract(html, weight) == want


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (4, "u", "<article><p>" + "word " * 50_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("h", F.lit("x"))
    got = {r.page_id: r for r in htmltext.main_text(spark, df).collect()}
    assert got[2].text == got[3].text == "" and got[4].n_chars == 249_999 and got[1].n_chars == len(got[1].text) > 0
    assert htmltext.main_text(spark, df.where("false")).count() == 0


# --- lines --------------------------------------------------------------------


def line_docs():
    rng = random.Random(6)
    say = lambda: " ".join(rng.choice("abcdefghijklm") for _ in range(6))
    shared = "\n".join(say() for _ in range(30))
    docs = [(i, "\n".join(say() for _ in range(rng.randrange(1, 20)))) for i in range(20)]
    docs += [(50 + i, "\n".join([*(say() for _ in range(3)), shared, *(say() for _ in range(3))])) for i in range(6)]
    docs += [(70, None), (71, ""), (72, "one line"), (73, "one line"), (74, "\n\n\n"), (75, shared + "\n" + shared), (50, docs[20][1]), (76, "x\ny\n" * 3000)]
    return [*docs, (None, "p\nq\nr"), (90, "p\nq\nr\n"), (91, "one\n\n\ntwo"), (92, "three\n\n\nfour"), (93, "k\nk\nk\nk\nk")]


def test_lines(spark):
    rng = random.Random(13)
    say = lambda: " ".join(rng.choice("abcdefghijklm") for _ in range(6))
    docs, blocks = line_docs(), {}
    for n in range(2, 9):
        for k in range(20):
            block = [say() for _ in range(n)]
            i = 1000 + 100 * n + 2 * k
            docs.append((i, "\n".join([say(), say(), *block, say(), say()])))
            ends = [say() for _ in range(4)]
            docs.append((i + 1, "\n".join([*ends[:2], *block, *ends[2:]])))
            blocks[i + 1] = (n, "\n".join(ends))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).withColumn("uid", F.lit("u")).withColumn("_uid", F.lit("v")).withColumn("parts", F.lit(2.5))
    out = lines.dedup(spark, df)
    rows = out.collect()
    assert out.columns == df.columns and len(rows) == len(docs) and {(r.uid, r._uid, r.parts) for r in rows} == {("u", "v", 2.5)}
    # What went stands at an earlier place, with a line next to it; what repeats there and has three lines went.
    order = sorted(range(len(docs)), key=lambda n: (docs[n][0] is None, docs[n][0] or 0, n))
    split = [(t or "").split("\n") for _, t in docs]
    seen, pairs = {}, {}
    for n in order:
        for i, x in enumerate(split[n]):
            seen.setdefault(x, (n, i))
            pairs.setdefault(tuple(split[n][i : i + 2]), []).append((n, i))
    known = {}
    for r in rows:
        known.setdefault(r.doc_id, []).append(r.text)
    gone = 0
    for n, (i, t) in enumerate(docs):
        if t is None:
            assert known[i] == [None]
            continue
        # First places of lines stay, in order.
        first = [x for k, x in enumerate(split[n]) if seen[x] == (n, k) and x]
        assert any(list(filter(set(first).__contains__, dict.fromkeys(x.split("\n")))) == list(dict.fromkeys(first)) for x in known[i])
        # Lines that go have an earlier pair.
        again = {k + j for k in range(len(split[n]) - 1) for j in (0, 1) if pairs[tuple(split[n][k : k + 2])][0] < (n, k) or order.index(pairs[tuple(split[n][k : k + 2])][0][0]) < order.index(n)}
        left = split[n] if known[i][0] is None else max(known[i], key=len).split("\n")
        assert len(split[n]) - len(left) <= len(again)
        gone += len(split[n]) - len(left)
    assert gone > 5000
    texts = {r.doc_id: r.text for r in rows if r.doc_id in blocks}
    assert all(texts[i] == want for i, (n, want) in blocks.items() if n > 2)
    assert sum(texts[i] == want for i, (n, want) in blocks.items() if n == 2) >= 12
    assert sorted(known[50], key=len)[0].count("\n") < 8 and known[73] == ["one line"] and known[74] == ["\n\n\n"] and known[93] == ["k\nk\n"]
    assert known[91] == ["one\n\n\ntwo"] and known[92] == ["three\n\n\nfour"] and known[90] == ["p\nq\nr\n"]
    counts = lines.dedup(spark, df, counts=True)
    assert counts.columns == ["doc_id", "text", "n_chunks", "n_removed"]
    got = counts.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((r.doc_id, r.text) for r in rows), key=repr)
    assert sum(r.n_removed > 3 for r in got if 51 <= (r.doc_id or 0) <= 55) == 5
    assert lines.dedup(spark, df.where("false")).count() == 0


def test_chunks_shift_and_cover():
    t = lines.split(line_docs()[20][1].encode())
    parts = lambda x: {b"\n".join(x[a : a + n]) for a, n in lines.chunks(x)}
    assert len(parts(t) & parts([b"new first line", *t])) >= len(parts(t)) - 3
    ends = lines.boundaries(t)
    assert ends == sorted(set(ends)) and ends[-1] == len(t)
    rng = random.Random(3)
    for _ in range(200):
        x = [b"%d" % rng.randrange(10**6) for _ in range(rng.randrange(2, 40))]
        small = {a for a, n in lines.chunks(x) if n == 2}
        assert all(i in small or i + 1 in small for i in range(len(x) - 2))


def test_one_digest_isnt_enough():
    part = {"pos": 0, "n": 2, "before": None, "body": b"a\nb", "after": b"c"}
    assert lines.repeated([b"a", b"b", b"c"], [part]) == {0, 1, 2} and lines.repeated([b"a", b"x", b"c"], [part]) == set()


# --- passages -----------------------------------------------------------------


def test_chain_is_the_best_chain():
    rng = random.Random(8)
    k, cost = passages.K, passages.GAP_COST
    longest = 0
    for turn in range(300):
        size = 60 if turn % 2 else 25
        ms = sorted({(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randrange(1, 25))})
        ms += [(p + 4, r + 4) for p, r in ms[::3]]
        parts = passages.runs(ms)
        assert sorted(m for x in parts for m in x[3]) == sorted(set(ms))
        best = [float(n) for _, _, n, _ in parts]
        for i, (p, r, n, _) in enumerate(parts):
            for j, (a, b, m, _) in enumerate(parts):
                a, b = a + m - k + 1, b + m - k + 1
                if j != i and a <= p and b <= r:
                    best[i] = max(best[i], n + best[j] - cost * (p - a + r - b))
        score, back = passages.chain_runs(parts)
        assert np.allclose(score, best)
        longest = max(longest, sum(b >= 0 for b in back))
        ways = passages.chain(ms)
        assert sorted(m for w in ways for m in w) == sorted(set(ms))
        assert all(x[0] < y[0] and x[1] < y[1] for w in ways for x, y in zip(w, w[1:]))
    assert longest > 5


def test_words_and_seeds():
    text = b" The  cat\nsat\t" + b"y" * 700 + b" cat \xc3\xa9 " + b"y" * 699 + b"z"
    h, start, end = passages.words(text)
    assert [text[a:b] for a, b in zip(start, end)] == text.split()
    same = text.split()
    assert all((h[i] == h[j]) == (same[i] == same[j]) for i in range(len(same)) for j in range(len(same)))
    rng = np.random.default_rng(9)
    for n in (5, 6, 17, 18, 90):
        one = rng.integers(0, 1 << 63, n, np.uint64)
        every = passages.seeds(one, w=1)
        at = set(passages.seeds(one)[1].tolist())
        h = every[0].view(np.uint64).tolist()
        want = {min(range(s, min(s + passages.W, len(h))), key=h.__getitem__) for s in range(max(1, len(h) - passages.W + 1))} if h else set()
        assert at == want
    assert not len(passages.words(b"")[0]) and not len(passages.words(b" \n ")[0])


def test_texts_side_by_side():
    """Seeds and places of many texts at once are those of each text by itself."""
    rng = random.Random(21)
    texts = [b"", b" ", b"a b c", b"a b c d e f", b" ".join([b"x"] * 200)]
    texts += [b"\n".join(rng.choice([b"a", b"B", b"\xc3\xa9", b"w%d" % rng.randrange(30)]) for _ in range(rng.randrange(90))) for _ in range(200)]
    rng.shuffle(texts)
    some = passages.Texts(texts)
    h, at = some.seeds()
    row, pos, around = some.places(at)
    got = sorted(zip(row.tolist(), pos.tolist(), h.tolist(), around.tolist()))
    want = []
    for i, text in enumerate(texts):
        one, start, end = passages.words(text.lower())
        for x, p in zip(*(c.tolist() for c in passages.seeds(one))):
            want.append((i, p, x, int(start[max(p - passages.MARGIN, 0)]) << 32 | int(end[min(p + passages.K + passages.MARGIN, len(one)) - 1])))
    assert len(want) > 500 and got == sorted(want)
    one = np.random.default_rng(22).integers(0, 1 << 63, 120, np.uint64)
    for n in (1, 2, 6, 7, 50, 120):
        slow = []
        for i in range(len(one) - n + 1):
            x = 0
            for y in one[i : i + n].tolist():
                x = (x * int(passages._MIX) + y) % (1 << 64)
            x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 % (1 << 64)
            slow.append(x ^ x >> 27)
        assert passages._runs_of(one, n).tolist() == slow


def test_single_anchors_side_by_side(monkeypatch):
    """Alignments of one anchor are those of ``align``, which is asked for few of them."""
    rng = random.Random(23)
    jobs = []
    for _ in range(1500):
        a = [rng.randrange(9) for _ in range(rng.randrange(6, 135))]
        rate = rng.choice([0.3, 0.5, 0.85, 0.95, 1])
        b = [x if rng.random() < rate else -1 for x in a]
        p = rng.randrange(max(0, len(a) - 70), min(65, len(a) - 5))
        r = rng.choice([p, rng.randrange(p + 1)])
        b = b[p - r :]
        b[r : r + 6] = a[p : p + 6]
        jobs.append((a, b, p, r))
    a = list(range(134))  # the best stretch is behind the anchor, another across it
    jobs.append((a, [-1] * 20 + a[20:70] + [-1] * 13 + a[83:], 64, 64))
    want = [list(passages.align(a, b, [(p, r)])) for a, b, p, r in jobs]
    asked, ask = [], passages.align
    monkeypatch.setattr(passages, "align", lambda *a: asked.append(1) or ask(*a))
    assert passages.align_ones(jobs) == want and passages.align_ones([]) == []
    assert sum(map(bool, want)) > 300 and max(map(len, want)) > 1 and len(asked) < 0.1 * len(jobs)


def test_long_gaps_are_aligned():
    rng = random.Random(14)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    ends, middle = (say(30), say(30)), say(120)
    a, b = [*ends[0], *middle, *ends[1]], [*ends[0], "one", *middle[:60], "more", *middle[60:], *ends[1]]
    got = list(passages.align(a, b, [(0, 0), (24, 24), (150, 152), (174, 176)]))
    assert got == [(0, 180, 0, 182, 180, 182)]


def test_a_passage_behind_its_pieces(spark):
    rng = random.Random(15)
    say = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    docs, want = [], set()
    for case, (n, size, step) in enumerate([(120, 40, 27), (120, 40, 27), (200, 30, 20), (90, 45, 15)]):
        p = say(n)
        pieces_of = [" ".join([*say(20), *p[a : a + size], *say(20)]) for a in range(0, n - size + step, step)]
        at = 1000 * case
        first, later = (at + 500, at + 600) if case != 1 else (at + 1, at + 600)
        docs += [(at + 10 + i, t) for i, t in enumerate(pieces_of)]
        docs += [(first, " ".join([*say(9), *p, *say(9)])), (later, " ".join([*p, *say(30)]))]
        want.add((later, first))
    got = {(r.doc_id, r.ref_doc_id) for r in passages.passages(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_a_passage_behind_many_pieces(spark):
    """Pieces of a passage stand in more earlier documents than there are rounds or seeds paired all with all."""
    rng = random.Random(16)
    say = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    docs, want = [], set()
    for case, (n, times) in enumerate([(120, 3), (120, passages.FEW + 5), (51, passages.FEW + 5)]):
        p, at, step = say(n), 10_000 * case, 27 if n > 51 else 6
        starts = range(0, n - 40 + step, step)
        docs += [(at + 100 * i + j, " ".join([*say(20), *p[a : a + 40], *say(20)])) for i, a in enumerate(starts) for j in range(times)]
        docs += [(at + 5000 + i, " ".join([*say(9 * i), *p, *say(20)])) for i in range(3)]
        want |= {(at + 5000 + i, at + 5000) for i in (1, 2)}
    # An earlier document has the passage's first 60 words, others a piece of the rest.
    p, at = say(85), 90_000
    docs += [(at, " ".join([*say(9), *p[:60], *say(9)])), *((at + 1 + i, " ".join([*say(20), *p[48:], *say(20)])) for i in range(3))]
    docs += [(at + 10, " ".join([*say(9), *p, *say(9)])), (at + 11, " ".join([*p, *say(30)]))]
    want |= {(at + 10, at), (at + 11, at), (at + 11, at + 10)}
    got = {(r.doc_id, r.ref_doc_id): r for r in passages.passages(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == want
    assert (got[at + 11, at + 10].start_word, got[at + 11, at + 10].end_word) == (0, 85)


def test_passages_against_all_pairs(spark):
    """Documents that share a run of MIN_WORDS words have it from one document, or one from the other."""
    rng = random.Random(17)
    pool = [[f"w{rng.randrange(9000)}" for _ in range(rng.randrange(60, 200))] for _ in range(6)]
    docs = []
    for i in range(160):
        text = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(pool[:2] if i % 2 else pool)
            a = rng.randrange(len(p) - 20)
            text += p[a : a + rng.randrange(20, 90)] + [f"w{rng.randrange(9000)}" for _ in range(rng.randrange(3, 30))]
        docs.append((i, " ".join(text)))
    docs += [(200 + i, docs[i][1]) for i in range(20)]
    n, of = passages.MIN_WORDS, {d: t.split() for d, t in docs}
    got: dict = {}
    for r in passages.passages(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r.ref_doc_id < r.doc_id and r.n_words >= n and r.identity >= 0.8
        got.setdefault(r.doc_id, []).append(r)
    inside = lambda d, e, a: [r for r in got.get(d, []) if (e is None or r.ref_doc_id == e) and r.start_word <= a and a + n <= r.end_word]
    places: dict = {}
    for d, t in of.items():
        for a in range(len(t) - n + 1):
            places.setdefault(tuple(t[a : a + n]), []).append((d, a))
    shared = [x for x in places.values() if len({d for d, _ in x}) > 1]
    assert len(shared) > 200 and max(map(len, shared)) > passages.FEW
    for at in shared:
        linked = {d: d for d, _ in at}

        def root(d):
            while linked.get(d, d) != d:
                d = linked[d]
            return d

        for d, a in at:
            for r in inside(d, None, a):
                x, y = root(d), root(r.ref_doc_id)
                linked[max(x, y)] = min(x, y)
        assert len({root(d) for d, _ in at}) == 1
        first = min(d for d, _ in at)
        assert all(inside(d, None, a) for d, a in at if d != first)


def test_passages(spark):
    rng = random.Random(10)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    p = say(60)
    near = [w if i % 12 else "changed" for i, w in enumerate(p)]
    gap = p[:30] + ["put", "in"] + p[30:]
    docs = [(i, " ".join(say(80))) for i in range(10)]
    docs += [(20, " ".join([*say(40), *p, *say(30)])), (21, " ".join([*p, *say(10)]).upper().lower()), (22, "\n".join([*say(5), *near])), (23, " ".join([*gap, *say(50)])), (24, " ".join(p[:20]))]
    docs += [(30, docs[0][1]), (31, None), (32, ""), (33, "few words"), (20, docs[10][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("x"))
    got = [r for r in passages.passages(spark, df).collect()]
    pairs = {(r.doc_id, r.ref_doc_id) for r in got}
    assert pairs == {(21, 20), (22, 20), (23, 20), (30, 0)}
    exact = next(r for r in got if r.doc_id == 21)
    assert (exact.start_word, exact.end_word, exact.ref_start, exact.ref_end, exact.identity) == (0, 60, 40, 100, 1.0)
    assert all(r.n_words >= 50 and r.identity >= 0.8 for r in got)
    assert passages.passages(spark, df.where("false")).count() == 0


def test_passages_with_one_partner(spark):
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs, want = [], set()
    for i, gap in enumerate([20, 50, 80, 100, 130, 150, 200]):
        parts = [say(60 + 10 * i) for _ in range(3)]
        n = 60 + 10 * i
        a = [*say(30), *parts[0], *say(gap), *parts[1], *say(gap), *parts[2], *say(30)]
        b = [*parts[0], *say(gap), *parts[1], *say(gap + 5), *parts[2]]
        docs += [(100 * i, " ".join(a)), (100 * i + 1, " ".join(b))]
        at = [(0, 30), (n + gap, 30 + n + gap), (2 * n + 2 * gap + 5, 30 + 2 * n + 2 * gap)]
        want |= {(100 * i + 1, p, p + n, 100 * i, q, q + n) for p, q in at}
    got = [tuple(r)[:6] for r in passages.passages(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# --- quality ------------------------------------------------------------------


def corpus(n=1500):
    rng = random.Random(11)
    good = [f"g{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randrange(20, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vile", "scorn"])
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(9001, None), (9002, ""), (0, docs[0][1]), (9003, "g1 " * 40_000)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("log_weight", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.score(spark, df, lab).collect()
    assert len(rows) == len(docs) + 4
    unseen = [r for r in rows if r.doc_id % 2 and r.doc_id < 9000]
    right = sum(r.selected == (r.doc_id % 5 != 0) for r in unseen)
    assert right > 0.97 * len(unseen)
    by = {r.doc_id: r for r in rows}
    assert by[9001].log_weight == by[9002].log_weight == 0
    kept = quality.keep_selected(spark, df, lab)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.selected)
    none = quality.score(spark, df.where("false"), lab)
    assert none.count() == 0 and quality.keep_selected(spark, df, lab.where("false")).count() > 0


def test_weights_and_draw_by_brute_force(spark):
    docs, labels = corpus(600)
    docs += [(9001, None), (9002, ""), (9003, "Said said said said said!! again"), (9004, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_weight", F.lit("x")).withColumn("_key", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [set(quality.ngram_buckets(t).tolist()) for _, t in docs]
    good = {i for i, q, t in labels if q and not t}
    raw, target = {}, {}
    for (i, _), have in zip(docs, held):
        for b in have:
            raw[b] = raw.get(b, 0) + 1
            target[b] = target.get(b, 0) + (i in good)

    def weight(b, own=0):
        c, e = max(target[b] - own, 0), raw[b] * len(good) / len(docs)
        z = ((c - e) / (e + 1) ** 0.5) ** 4
        w = np.log((c + 1) / (e + 1)) * z / (z + (7 if quality.BUCKETS <= b < quality.RUN else 3) ** 4)
        return w if abs(w) >= 0.01 else 0.0

    want = {i: sum(map(weight, have)) for (i, _), have in zip(docs, held)}
    rows = {r.doc_id: r for r in quality.score(spark, df, lab).collect()}
    assert all(abs(rows[i].log_weight - w) < 1e-4 for i, w in want.items()) and any(w > 0 for w in want.values())
    by = dict(zip((i for i, _ in docs), held))
    train = np.array([sum(weight(b, i in good) for b in by[i]) for i, _, _ in labels])
    cut = quality.best_cut(train, np.array([i in good for i, _, _ in labels]))
    k = sum(w >= cut for w in want.values())
    keys = sorted((r.gumbel_key for r in rows.values()), reverse=True)
    assert 0 < k < len(docs) and all(r.selected == (r.gumbel_key >= keys[k - 1]) for r in rows.values())
    # The noise matters: at a high temperature the draw isn't the cut.
    hot = quality.score(spark, df, lab, temperature=20.0).collect()
    assert 0 < sum(r.selected != (r.log_weight >= cut) for r in hot)
    kept = quality.keep_selected(spark, df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.selected}
    assert quality.RUN in by[9003] and not by[9001]


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 0.25), [1e300, -1e300]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    order = np.sort(x)[::-1]
    for k in (1, 2, 700, 1500, len(x)):
        assert quality.kth_largest(df, "v", k, few=50) == order[k - 1]
    assert quality.kth_largest(df, "v", 0) is None and quality.kth_largest(df.where("false"), "v", 3) is None


# --- pipeline -------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
def test_pipeline(spark, model):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, D).persist()
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in seen.collect()}, name
        seen = after
    final = corpus_pipeline.run(spark, D).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in seen.collect()} and all(r.exact in (True, None) for r in final)
