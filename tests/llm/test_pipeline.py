"""The pipeline on a small corpus with planted cases, each stage against plain Python."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import edited, prose


def corpus(spark, folder):
    texts, labels = [], []
    passage, item = prose(900, 70), prose(901, 40)
    for i in range(300):
        t = prose(i, 100)
        if i % 6 == 0:
            t = " ".join(w + "###" for w in t.split())
        labels.append((i, int(i % 6 != 0), 0))
        texts.append(t)
    for i in (1, 8, 9):
        words = texts[i].split()
        texts[i] = " ".join(words[:50]) + " " + passage + " " + " ".join(words[50:])
    texts[11] += " " + item
    texts += [texts[2], edited(texts[3], 30), "", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, passage


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts, passage = corpus(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
    good = {i for i in range(300) if i % 6}
    assert good | {300, 301} == set(seen["quality"]) & set(range(302))
    assert set(seen["quality"]) - set(seen["near_dup"]) == {300, 301}
    assert set(seen["near_dup"]) == set(seen["passages"])
    assert sum(passage[100:300] in (r["text"] or "") for r in seen["passages"].values()) == 1
    assert {i for i, r in seen["passages"].items() if r["text"] != texts[i]} == {8, 9}
    assert set(seen["passages"]) - set(seen["decontamination"]) == {11}
    mixed = seen["mixing"]
    assert set(mixed) <= set(seen["decontamination"]) and all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in mixed.values())
    run = {r["doc_id"]: r["copies"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert run == {i: r["copies"] for i, r in mixed.items()}


def test_repeated_and_missing_ids(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    other = prose(40, 90)
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (1, other, "en", "s", 5), (None, "x", "en", None, 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("size", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("id", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.count() == (4 if name == "near_dup" else 5) and out.columns == docs.columns, name
        assert out.where(F.col("text") == other).count() == 1
        assert stage(spark, docs.limit(0), folder).count() == 0
    mixed = corpus_pipeline.mixing_stage(spark, docs, folder).collect()
    # every source is at its stop of two copies but the one of null, which has a weight of its own
    assert {(r["doc_id"], r["text"]) for r in mixed} >= {(1, other), (None, "x")} and all(r["taken"] == r["copies"] * r["size"] for r in mixed)
    assert corpus_pipeline.mixing_stage(spark, docs.limit(0), folder).count() == 0


def test_empty_corpus(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert all(stage(spark, docs, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)
