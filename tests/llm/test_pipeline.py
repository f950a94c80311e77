"""The pipeline on a small folder of tables: every stage's decision takes effect."""

import random

import pytest
from pyspark.sql.functions import lit as spark_lit

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def prose(rng, n):
    return " ".join(f"word{rng.randrange(300)}" for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    item = prose(rng, 30)
    docs = [(i, prose(rng, 60), "en", f"src{i % 3}", 0) for i in range(300)]
    docs += [(300 + i, docs[i][1] + " tail", "en", "src0", 0) for i in range(10)]
    docs += [(400 + i, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en", "src1", 0) for i in range(5)]
    docs += [(500 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "en", "src2", 0) for i in range(60)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d[0], int(d[0] < 500), 0) for d in docs if d[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, out = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder).cache()
        assert out.columns == docs.columns
        ids.append({r.doc_id for r in out.select("doc_id").collect()})
    good, single, clean, mixed = ids
    assert good == {d for d in range(300)} | set(range(300, 310)) | set(range(400, 405))
    assert single == good - set(range(300, 310))
    assert clean == single - set(range(400, 405))
    assert mixed <= clean
    last = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in last} == mixed and len(last) == out.count()
    assert sorted(r.start for r in last)[0] == 0


def test_null_and_repeated_ids(spark, folder):
    """Rows are judged one by one where ids do not tell them apart."""
    rng = random.Random(2)
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    copied, other = prose(rng, 60), prose(rng, 60)
    junk = " ".join(w.upper() + "!!" for w in prose(rng, 60).split())
    leak = f"{prose(rng, 20)} {item} {prose(rng, 20)}"
    rows = [(None, copied), (None, copied + " tail"), (None, junk), (None, leak), (None, None), (None, ""), (1, prose(rng, 50)), (7, prose(rng, 40)), (7, junk), (7, leak), (8, other), (8, other), (9, other + " end")]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], shape).withColumn("kept", spark_lit(1))
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert texts(stages["decontamination"](spark, docs, folder)) == sorted((r for r in rows if r[1] != leak), key=str)
    left = stages["near_duplicates"](spark, docs, folder)
    assert left.columns == docs.columns
    got = texts(left)
    assert len([t for _, t in got if t and t.startswith(copied)]) == 1 and [r for r in got if r[1] and r[1].startswith(other)] == [(9, other + " end")]
    assert {junk, leak, None, ""} <= {t for _, t in got} and (7, rows[7][1]) in got
    good = stages["quality"](spark, spark.read.parquet(f"{folder}/documents.parquet").unionByName(docs.drop("kept")), folder)
    got = {(r.doc_id, r.text) for r in good.collect()}
    assert not any(t == junk for _, t in got) and {(None, copied), (7, rows[7][1]), (8, other)} <= got
    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == docs.columns and mixed.where("doc_id is null").count() > 0
    assert stages["token_files"](spark, mixed, folder).count() == mixed.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
