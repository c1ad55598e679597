"""Each stage of the pipeline on its own input, and the chain."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

FILL = "abcdefghijklmnopqrstuvwxyz"


def sentence(i, n=40):
    return " ".join(f"{FILL[(i * 7 + j) % 26]}{FILL[(i + j * j) % 26]}{(i * 131 + j * 17) % 97}word" for j in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    item = " ".join(f"bench{j}" for j in range(14))
    rows = [(i, sentence(i), "en", f"s{i % 2}", 9) for i in range(30)]
    rows += [(30, sentence(3), "en", "s0", 9), (31, sentence(4) + " tail", "en", "s1", 9)]
    rows += [(32, f"{sentence(50)} {item} {sentence(51)}", "en", "s0", 9)]
    rows += [(40 + i, " ".join(f"WORD{i}{j}!!" for j in "ABCDEFGHIJ"), "en", "s1", 9) for i in range(4)]
    rows += [(None, sentence(60), None, None, None), (60, None, None, None, None), (61, "", "en", "s0", 9), (62, sentence(62), "en", "s0", 9), (62, sentence(62), "en", "s0", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(f"b{i}", item if i == 0 else sentence(100 + i, 12)) for i in range(3)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def stage(spark, name, docs, sf_dir):
    return dict(pipeline.STAGES)[name](spark, docs, sf_dir)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is not None, i or 0))


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    everyone = ids(docs)
    assert [n for n, _ in pipeline.STAGES] == ["quality", "neardup", "decontamination", "mixing", "sharding"]
    assert ids(stage(spark, "quality", docs, corpus)) == [i for i in everyone if i not in range(40, 44)]
    once = ids(stage(spark, "neardup", docs, corpus))
    assert once == sorted((set(everyone) - {30, 31}), key=lambda i: (i is not None, i or 0))
    assert ids(stage(spark, "decontamination", docs, corpus)) == [i for i in everyone if i != 32]
    mixed = stage(spark, "mixing", docs, corpus)
    assert set(ids(mixed)) <= set(everyone) and mixed.columns == docs.columns and {60, 61} <= set(ids(mixed))
    out = stage(spark, "sharding", docs, corpus).collect()
    assert len(out) == len(everyone)
    counts = [sum(r["shard"] == s for r in out) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))


def test_stages_without_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, run in pipeline.STAGES:
        assert run(spark, docs, corpus).count() == 0, name


def test_stages_carry_columns_of_any_name(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("accepted", F.lit(7)).withColumn("contaminated", F.lit(7)).withColumn("_share", F.lit(7)).withColumn("row", F.lit(7))
    for name, run in pipeline.STAGES[:-1]:
        out = run(spark, docs, corpus)
        assert out.columns == docs.columns and out.where("accepted = 7 AND contaminated = 7 AND _share = 7 AND row = 7").count() == out.count() > 0, name


def test_chain_is_its_stages_one_after_another(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, run in pipeline.STAGES:
        docs = spark.createDataFrame((d := run(spark, docs, corpus)).collect(), d.schema)
    columns = ["doc_id", "size", "text_crc32", "law"]
    got, want = pipeline.run(spark, corpus), docs
    assert got.columns == want.columns
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
