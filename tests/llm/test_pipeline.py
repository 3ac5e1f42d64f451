"""The corpus pipeline on a small folder, with columns that it doesn't know."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    prose = [" ".join(f"w{(i * 7 + j * j) % 97}x{i}" for j in range(60)) for i in range(40)]
    rows = [(i, t, "en", "s", len(t), 1.5) for i, t in enumerate(prose)]
    rows += [(100, prose[3], "en", "s", 1, 1.5), (101, "mail me at a.b@c.org please", "en", "s", 1, 1.5), (102, prose[5] + " " + prose[6], "en", "s", 1, 1.5), (103, None, "en", "s", 1, 1.5), (103, None, "en", "s", 1, 1.5), (None, "x", "en", "s", 1, 1.5)]
    d = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(prose[9].split()[:30]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, d)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        kept = spark.read.parquet(f"{d}/{name}")
    ids = [r["doc_id"] for r in kept.collect()]
    assert 100 not in ids and 9 not in ids and 3 in ids and ids.count(103) == 1 and None in ids
    text = spark.read.parquet(f"{d}/pii").where("doc_id = 101").select("text", "n_chars").first()
    assert text["text"] == "mail me at <EMAIL> please" and text["n_chars"] == len(text["text"])
    assert corpus_pipeline.run(spark, d).count() == len(ids)
    assert kept.where(F.col("doc_id") == 101).first()["n_tokens"] > 3


def test_empty_tables(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for full in (None, "documents"):
        d = str(tmp_path / str(full))
        for name, schema in schemas.items():
            rows = [(1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (3, None, None, None, None)] if name == full else []
            spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
        assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()) == ([1, 3] if full else [])


def test_like_the_operators_by_themselves(spark, tmp_path):
    """What each stage keeps follows from brute force on its own input."""
    import random

    from symdex.llm import decontamination, jaccard, toxicity

    rng = random.Random(21)
    plain = [f"w{i}x" for i in range(300)]
    texts = {i: " ".join(rng.choice(plain) for _ in range(rng.randint(5, 80))) for i in range(150)}
    for i in range(0, 40, 4):
        texts[200 + i] = texts[i] + (" tail" if i % 8 else "")
    for i in range(300, 340):
        texts[i] = " ".join(rng.choice([*plain, "grobword", "nastyish", "grobling"]) if j % 4 else "grobword" for j in range(40))
    items = {1: " ".join(texts[7].split()[:20]), 2: " ".join(texts[9].split()[:5])}
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.report(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    kept = {i: t for i, t in texts.items() if scores[i] < 0.5}
    assert not any(i >= 300 for i in kept) and len(kept) > 140
    kept = {i: kept[i] for i, (_, component, _) in jaccard.brute_force(kept).items() if i == component}
    kept = {i: kept[i] for i, found in decontamination.brute_force(kept, items).items() if not found[-1]}
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()) == sorted(kept)
