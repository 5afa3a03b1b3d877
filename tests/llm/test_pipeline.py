"""The corpus pipeline end to end, on a small corpus whose right result is known."""

import random

import corpus_pipeline
from tessera.llm import sentencepiece_codec as sc

LINE = "This very line is shared by a good many pages of one site"


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(7)
    words = ["river", "valley", "stone", "quiet", "garden", "morning", "window", "letter", "evening", "market", "bridge", "harbour"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))
    junk = lambda: " ".join(rng.choice(["BUY", "NOW", "###", "$$$", "!!!", "CLICK"]) for _ in range(70))
    texts = {i: prose(80) if i % 3 else junk() for i in range(150)}
    for i in range(200, 208):
        texts[i] = prose(80) + "\n" + LINE
    texts[300] = " ".join([*texts[1].split(" ")[:-1], "edited"])
    item = prose(30)
    texts[301] = prose(60) + " " + item + " " + prose(20)
    texts[302], texts[303] = None, ""
    docs = [(i, t, "en", "a", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r.text for r in sc.decode(out, sc.MODEL).collect()}
    clean = {i for i in range(150) if i % 3} | set(range(200, 208))
    assert set(got) - {302, 303} == clean, (set(got) - clean, clean - set(got))
    assert all(got[i] == texts[i] for i in clean if i < 150)
    assert [i for i in range(200, 208) if LINE in got[i]] == [207]


def test_near_dedup_stage_takes_80_percent(spark, tmp_path):
    """Pairs from 0.80 up to 0.85 go, a pair below 0.80 stays."""
    docs = []
    for pair, changed in enumerate((1, 2, 3, 4)):
        base = [f"p{pair}w{i}" for i in range(104)]
        copy = list(base)
        for k in range(changed):
            copy[10 + 20 * k] = "edited"
        docs += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(copy))]
    # of 100 shingles 5 change with each word: similarity 95/105, 90/110 = 0.818, 85/115, 80/120
    near = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    out = near(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {0, 2, 4, 5, 6, 7}
