"""The pipeline over a small corpus, stage by stage."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from casewatch.llm import queries


def corpus(spark, folder):
    rng = np.random.default_rng(8)
    vocab = [f"{a}{b}{c}" for a in ("to", "re", "in", "an", "mu", "ka") for b in ("ning", "der", "lia", "ver", "s") for c in ("", "a", "o", "e")]
    docs, labels = [], []
    for i in range(200):
        words = list(rng.choice(vocab, 80))
        if i % 5 == 0:
            words = [w + "###" for w in words]
        if i % 7 == 0:
            words[3] = f"me{i}@mail.com"
        docs.append((i, " ".join(words), "en", f"src{i % 6}", 1))
        labels.append((i, int(i % 5 > 0), 0))
    docs += [(500 + i, docs[i][1], "en", "src1", 1) for i in range(20)] + [(600, None, None, None, None), (None, "no id at all here", None, None, None), (601, "", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        seen.append(docs)
        if k < 4:
            assert docs.columns == names
    good = {r.doc_id for r in seen[0].collect()}
    assert {i for i in range(200) if i % 5 > 0} <= good and not any(i % 5 == 0 for i in good if i is not None and i < 200)
    single = [r.doc_id for r in seen[1].collect()]
    assert len(single) == len(set(single)) and set(single) >= {i for i in range(200) if i % 5 > 0} and not set(single) & set(range(500, 520))
    assert seen[2].count() == len(single) and seen[2].where(F.col("text").contains("@mail.com")).count() == 0 and seen[2].where("text like '%[EMAIL]%' and n_chars <> length(text)").count() == 0
    chosen = Counter_of(seen[3])
    assert set(chosen) <= set(single) and max(chosen.values()) <= 2
    tokens = {r.doc_id: r.n for r in seen[2].selectExpr("doc_id", "size(split(text, ' ')) as n").collect()}
    packed = {r.doc_id: r.n for r in seen[4].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(packed) == set(chosen) and all(packed[i] == chosen[i] * (tokens[i] + 1) for i in packed)


def Counter_of(df):
    return {r.doc_id: r["count"] for r in df.groupBy("doc_id").count().collect()}


def test_registry():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and set(queries.oracle_sql()) <= names


def test_run_gives_the_last_stage(spark, tmp_path):
    corpus(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:2] == ["bin_id", "capacity"] and out.count() > 0
