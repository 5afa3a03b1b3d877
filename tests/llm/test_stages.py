"""Every stage on rows with odd ids, texts and names: what goes is decided row by row."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
rng = random.Random(5)
GOOD = ["the", "river", "runs", "along", "a", "quiet", "valley", "stone", "garden", "morning", "window", "letter"]
prose = lambda n=60: " ".join(rng.choice(GOOD) + rng.choice(["", "s", "ly"]) for _ in range(n))
junk = lambda: " ".join(rng.choice(["BUY", "NOW", "###", "$$$"]) for _ in range(60))
ITEM = prose(30)
NAMES = ("own", "row", "lines", "kept", "gone", "of_doc", "of_row", "__gone", "key", "rep", "label", "a", "a.b")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    known = [(i, prose() if i % 3 else junk()) for i in range(120)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(120)] + [(None, 1, 0), (5, None, 0), (800, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "just this")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, known


def run(spark, tables, name, docs):
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for i, extra in enumerate(NAMES):
        df = df.withColumn(extra, F.lit(i))
    out = STAGES[name](spark, df, tables[0])
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = out.collect()
    assert all(r[n] == i for r in rows for i, n in enumerate(NAMES))
    assert STAGES[name](spark, df.limit(0), tables[0]).count() == 0
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_quality_goes_by_row(spark, tables):
    clean, bad = prose(), junk()
    docs = [*tables[1], (500, clean), (500, bad), (None, clean), (None, bad), (501, bad), (501, bad)]
    got = run(spark, tables, "quality_classifier", docs)
    want = [(i, t) for i, t in tables[1] if i % 3] + [(500, clean), (None, clean)]
    assert got == sorted(want, key=str)


def test_leaks_go_by_row(spark, tables):
    clean, leak = prose(), f"{prose(20)} {ITEM} {prose(20)}"
    docs = [(1, clean), (1, leak), (None, clean), (None, leak), (2, None), (3, ""), (4, leak), (4, leak), (5, "Just, this!"), (6, "just this once")]
    got = run(spark, tables, "benchmark_decontamination", docs)
    assert got == sorted([(1, clean), (None, clean), (2, None), (3, ""), (6, "just this once")], key=str)


def test_one_row_of_each_group_stays(spark, tables):
    one, two, three = prose(80), prose(80), prose(80)
    near = " ".join([*two.split(" ")[:-1], "edited"])
    docs = [(1, one), (1, one), (2, two), (2, near), (3, near), (None, one), (None, one), (4, None), (4, None), (5, ""), (6, three), (7, three), (7, "other " + prose(70))]
    got = run(spark, tables, "minhash_near_dedup", docs)
    texts = sorted(got, key=str)
    assert texts.count((1, one)) == 1 and texts.count((None, one)) == 2 and texts.count((4, None)) == 2
    assert [d for d, _ in texts if d == 2] == [2] and (6, three) in texts and 3 not in {d for d, _ in texts}
    assert docs[-1] in texts and (7, three) not in texts and len(texts) == 1 + 1 + 2 + 2 + 1 + 1 + 1


def test_encoding_takes_every_row(spark, tables):
    docs = [(1, "a text"), (1, "a text"), (1, None), (None, "x"), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("unit", F.lit(1))
    assert sorted((r.doc_id for r in STAGES["sentencepiece"](spark, df, tables[0]).collect()), key=str) == sorted((d for d, _ in docs), key=str)
    assert STAGES["sentencepiece"](spark, df.limit(0), tables[0]).count() == 0
