"""The pipeline on small tables with every odd case."""

import os
import random

import pytest

from weftline.llm import pieces

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="no vocabulary file")
DOCS = "doc_id long, text string, lang string, _uid int, uid int, _set string, weight int, parts int"


def tables(spark, path, docs, labels=(), items=()):
    rows = [(i, t, "en", n, n, "s", 3, 4) for n, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_documents(spark, tmp_path):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    block = "\n".join(say(9) for _ in range(4))
    item, base, long = say(14), say(300), say(20_000)
    near = base.split()
    near[100], near[200] = "other", "words"
    docs = [(1, None), (2, ""), (3, None), (4, base), (5, base), (6, " ".join(near)), (7, f"{say(30)} {item} {say(30)}"), (8, long), (9, "one"), (9, "one")]
    docs += [(10, f"{say(20)}\n{block}\n{say(20)}"), (11, f"{say(20)}\n{block}\n{say(20)}"), (None, "no id here"), (None, "no id here"), (12, "🙂 é\n\n\n x")]
    d = tables(spark, tmp_path, docs, items=[(1, item), (2, None), (3, "")])
    kept = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == [c.split()[0] for c in DOCS.split(", ")], name
    rows = kept.collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 0, 1, 4, 8, 9, 10, 11, 12]
    assert {r._set for r in rows} == {"s"} and {r.weight for r in rows} == {3}
    texts = {r.doc_id: r.text for r in rows}
    assert block in texts[10] and block not in texts[11] and texts[8] == long and texts[1] is None
    out = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id or 0) for r in out) == sorted((r.doc_id or 0) for r in rows)
    assert all(r.exact for r in out if r.doc_id != 1) and [r.ids for r in out if r.doc_id == 1] == [None]


def test_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, d).count() == 0
