"""The pipeline's stages against brute force on planted documents."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 120))) for _ in range(200)]
    toxic = {i for i in range(0, 200, 10)}
    for i in toxic:
        texts[i] += " you idiot stupid moron"
    exact = {200: 5, 201: 7}
    texts += [texts[j].replace(" ", "  ") + "\n" for j in exact.values()]
    near = {202: 11, 203: 13}
    texts += [texts[j] + " extra" for j in near.values()]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert name == "packing" or docs.columns == columns
    assert set(range(len(texts))) - set(seen["toxicity"]) == toxic
    assert set(seen["toxicity"]) - set(seen["exact dedup"]) == set(exact.values())  # the longer copy stays
    assert set(seen["exact dedup"]) - set(seen["near dedup"]) == set(near)
    assert set(seen["mixing"]) <= set(seen["near dedup"]) and sorted(seen["packing"]) == sorted(seen["mixing"])


def test_run_is_its_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and dict(rows.dtypes)["doc_id"] == "bigint"
    ids = rows.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.max("batch_rows").alias("r")).where("n <> r").count()
    assert ids == 0
