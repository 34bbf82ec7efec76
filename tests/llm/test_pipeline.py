"""The pipeline's stages: each keeps the columns of documents, takes effect, and leaves clean documents alone."""

import random

import corpus_pipeline
from certjobs.llm.common import written


def test_stages(spark, tmp_path):
    r = random.Random(5)
    words = ["river", "stone", "window", "garden", "letter", "morning", "silver", "table", "winter", "yellow"]
    prose = lambda n: " ".join(r.choice(words) + r.choice(["", "s", "ed", "ing"]) for _ in range(n)) + "."
    texts = [prose(80) for _ in range(120)] + ["$$$ ".join(prose(60).upper().split()) for _ in range(60)]
    near = texts[0].split()
    near[40] = "changed"
    passage = " ".join(texts[3].split()[10:25])
    texts += [texts[1], " ".join(near), prose(30) + " " + passage + " " + prose(30)]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, n_hit double")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = docs
    alive = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, folder), name)
        assert kept.columns == docs.columns
        alive.append({x["doc_id"] for x in kept.select("doc_id").collect()})
    quality, exact, near_, clean = alive
    assert len(quality & set(range(120))) >= 115 and len(quality & set(range(120, 180))) <= 5
    assert quality - exact == {1} and exact - near_ == {181} and near_ - clean == {3, 182}
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert {x["doc_id"] for x in pieces.select("doc_id").distinct().collect()} == clean


def test_rows_without_or_with_shared_ids(spark):
    """Rows are judged by doc_id and text: null ids stay, a repeated row stays once, two texts of one id are two rows."""
    words = "river stone window garden letter morning silver table winter yellow amber".split()
    text = lambda i: " ".join(words[(i * k + k * k) % 11] + str((i + k) % 9) for k in range(12))
    rows = [(None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (6, text(3)), (7, text(5)), (7, text(5)), (8, None), (None, ""), (9, text(5) + " end")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    order = lambda found: sorted(found, key=str)
    once = corpus_pipeline.exact(spark, docs, "")
    assert once.columns == docs.columns
    kept = [(None, text(1)), (None, text(2)), (5, text(4)), (6, text(3)), (7, text(5)), (8, None), (9, text(5) + " end")]
    assert order((r["doc_id"], r["text"]) for r in once.collect()) == order(kept)
    assert order((r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, written(once, "once"), "").collect()) == order(kept[:-1])
    assert corpus_pipeline.near(spark, docs.limit(0), "").count() == 0 and corpus_pipeline.exact(spark, docs.limit(0), "").count() == 0


def test_run(spark, tmp_path):
    """run() equals the stages one after the other, by the ids of what is packed."""
    words = "river stone window garden letter morning silver table winter yellow".split()
    texts = [" ".join(words[(i * k + k * k) % 10] for k in range(50)) for i in range(30)]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[9].split()[:12]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), name)
    key = ["doc_id", "start", "length", "ids_crc32", "sequence_id"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))
