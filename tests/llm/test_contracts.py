"""The contracts' results against brute force, on small random corpora with every odd case."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

SPACES = [" ", "  ", "\n", "\t", " \r\n", "\x0b"]


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["ÀB", "🙂", "it's", "#*$", "|"]
    sentence = lambda k: "".join(rng.choice(vocabulary) + rng.choice(SPACES if rng.random() < 0.2 else [" "]) for _ in range(k))
    passages = [sentence(rng.randrange(55, 90)) for _ in range(4)]
    lines = ["  Shared Line number one that is long enough to count \t", "shared line number one that is long enough to count", "Another line shared by many, long enough é é é é é é é", "short"]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.15:
            text = rng.choice(docs)[1] or ""
        elif docs and kind < 0.35:
            words = (rng.choice(docs)[1] or "x").split(" ")
            words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        else:
            text = sentence(rng.randrange(0, 120))
        if rng.random() < 0.4:
            text += rng.choice(passages) + sentence(rng.randrange(0, 20))
        if rng.random() < 0.5:
            text += "\n" + "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 4))) + "\n" * rng.randrange(0, 3)
        docs.append((i, text))
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "a" * 900), (1004, "ab " * 400), (1005, " " * 500), (1006, "one two"), (1007, "one  TWO"), (1008, ("w" * 30 + " ") * 120)]
    rng.shuffle(docs)
    return docs


def frame(spark, rows, name="text", key="doc_id"):
    """With a column more, and names that operators use inside."""
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], f"{key} long, {name} string, key string, n int").repartition(3)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


CASES = {
    "op1": ("suffix_array_dedup", "suffix_array_dedup_query", ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
    "op4": ("substring_dedup", "substring_dedup_query", ("doc_id", "n_words", "n_removed", "kept_sha256")),
    "op7": ("quality_rules", "quality_rules_query", ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")),
    "op8": ("minhash_forest", "minhash_query", ("doc_id", "n_shingles", "component_id", "kept")),
    "op10": ("line_dedup", "line_dedup_query", ("doc_id", "n_lines", "n_dropped", "kept_sha256")),
}


def query(op):
    import importlib

    module, name, columns = CASES[op]
    return getattr(importlib.import_module(f"tessera.llm.{module}"), name), columns


@pytest.mark.parametrize("op", CASES)
def test_against_brute_force(spark, op):
    run, columns = query(op)
    docs = corpus(11)
    assert rows(run(frame(spark, docs)), *columns) == getattr(brute, op)(docs)


@pytest.mark.parametrize("op", ["op1", "op4"])
def test_hot_groups_split(spark, op, monkeypatch):
    from tessera.llm import _segments

    monkeypatch.setattr(_segments, "GROUP", 2)
    run, columns = query(op)
    docs = corpus(12, 60)
    assert rows(run(frame(spark, docs)), *columns) == getattr(brute, op)(docs)


def test_crowded_regions(spark, monkeypatch):
    """A star of near copies with regions of two: everything goes down to full depth."""
    from tessera.llm import minhash_forest

    monkeypatch.setattr(minhash_forest, "REGION", 2)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    docs = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        words[rng.randrange(200)] = f"e{i}"
        docs.append((i, " ".join(words)))
    run, columns = query("op8")
    assert rows(run(frame(spark, docs)), *columns) == brute.op8(docs)


def test_crowded_star_whose_centre_is_not_the_least_id(spark):
    """Leaves reach 85 % with the centre only, not with one another."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    docs = [(100, " ".join(base))]
    for i in [*range(100), *range(101, 200)]:
        words = list(base)
        for k in (20, 100, 180, 260):
            words[k + rng.randrange(-15, 16)] = f"e{i}.{k}"
        docs.append((i, " ".join(words)))
    want = brute.op8(docs)
    assert len({row[2] for row in want}) == 1
    run, columns = query("op8")
    assert rows(run(frame(spark, docs)), *columns) == want


@pytest.mark.parametrize("cross", [False, True])
def test_exact_rest_of_a_crowd(spark, monkeypatch, cross):
    """Random edits of one text: links, near misses and chains in one crowd, in blocks of three rows."""
    from tessera.llm import minhash_forest as mf

    monkeypatch.setattr(mf, "REGION", 2)
    monkeypatch.setattr(mf, "BLOCK", 3)
    if cross:  # without neighbours, hubs and the rest in blocks alone find the links
        monkeypatch.setattr(mf, "_neighbours", lambda batches: iter(()))
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(90):
        words = list(base)
        for k in range(rng.randrange(1, 5)):
            words[rng.randrange(150)] = f"e{rng.randrange(25)}"
        docs.append((i, " ".join(words)))
    run, columns = query("op8")
    assert rows(run(frame(spark, docs)), *columns) == brute.op8(docs)


@pytest.mark.parametrize("op", CASES)
def test_empty_table_and_null_ids(spark, op):
    run, columns = query(op)
    assert run(frame(spark, corpus(1, 3)).limit(0)).count() == 0
    odd = [(None, "w " * 60), (5, "w " * 60), (5, "w " * 60), (None, None), (7, None)]
    assert run(frame(spark, odd)).count() == len(odd)


def test_warc(spark):
    from tessera.llm import warc

    pages = [(i, t) for i, t in corpus(4)] + [(2000, "x" * 500_000), (2001, "")]
    df = spark.createDataFrame([(k, f"http://a/{k}\n", t) for k, t in pages], "page_id long, url string, html string")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in warc.warc_query(df).select(*columns).collect()), key=lambda r: r[0]) == brute.op6(pages)
    assert warc.warc_query(df.limit(0)).count() == 0


def test_warc_files_and_damage(spark, tmp_path):
    from tessera.llm import warc

    df = spark.createDataFrame([(i, None, f"page {i % 3} é") for i in range(9)], "page_id long, url string, html string")
    archives = warc.write_archives(warc.plan_records(df), roll_bytes=500)
    warc.export(archives, str(tmp_path))
    got = {r.page_id: (r.record_type, bytes(r.payload)) for r in warc.read_files(spark, str(tmp_path)).collect()}
    assert got == {i: (("response", f"page {i} é".encode()) if i < 3 else ("revisit", b"")) for i in range(9)}
    raw = warc.encode_record(1, "u", b"payload", warc.digest(b"payload"), None)
    both = raw + warc.encode_record(2, "u", b"other", warc.digest(b"other"), None)
    assert [p for _, _, p in warc.SequentialReader(both[i : i + 3] for i in range(0, len(both), 3))] == [b"payload", b"other"]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.SequentialReader([both[:-9]]))
    with pytest.raises(ValueError, match="digest"):
        list(warc.SequentialReader([warc.encode_record(1, "u", b"payload", warc.digest(b"other"), None)]))


def test_line_runs_levels(spark):
    from tessera.llm import line_dedup as ld

    store = ld.LineRuns(spark, fanout=2, min_chars=3)
    batches = [[(i * 10 + j, f"line {j % 3}\nown {i} {j}") for j in range(4)] for i in range(5)]
    for rows_ in batches:
        store.add(spark.createDataFrame(rows_, "doc_id long, text string"))
    assert {level: len(runs) for level, runs in store.levels.items() if runs} == {2: 1, 0: 1}
    runs = [r for level in store.levels.values() for n in level for r in spark.table(n).select("h1", "h2").collect()]
    assert len(runs) == len(set(runs)) == 23  # each key is in one run
    batch = spark.table(store.levels[0][0])
    plan = store.unseen(batch)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    entries = {(r.n_docs, r.keeper) for r in store.entries().where("n_docs > 1").collect()}
    assert entries == {(10, 43), (5, 41), (5, 42)}
    fresh = spark.createDataFrame([(99, "line 1\nnever seen before")], "doc_id long, text string")
    assert [r.pos for r in store.unseen(ld.doc_lines(fresh, 3)).collect()] == [1]
    store.close()


def test_lines_go_by_row_and_documents_count_by_id(spark):
    from tessera.llm import line_dedup as ld

    shared = "a line that five documents share, long enough to count"
    docs = [(i, f"{shared}\nown {i}") for i in range(5)]
    docs += [(3, "UNIQUE CONTENT of the second row\nB1"), (3, f"x\n{shared}"), (2, docs[2][1]), (None, shared), (9, None)]
    twice = "a line that one document holds five times over, in five rows"
    docs += [(50, f"{twice}\n{i}") for i in range(5)]
    got = ld.line_dedup_stage(frame(spark, docs).withColumn("lines", F.lit(7)).withColumn("__row", F.lit(8)))
    want = [(3, "UNIQUE CONTENT of the second row\nB1"), (3, "x"), (2, "own 2"), (None, shared), (9, None), (4, docs[4][1])]
    want += [(i, f"own {i}") for i in range(4)] + docs[-5:]
    assert sorted((tuple(r) for r in got.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)
    assert {(r.lines, r["__row"]) for r in got.collect()} == {(7, 8)}


def test_rule_ledger(spark):
    from tessera.llm import quality_rules as qr

    entries = qr.ledger(frame(spark, corpus(3))).cache()
    names = [n for n, _ in qr.rules()]
    counted = {r.rule: (r.n_failed, r.n_only) for r in qr.ablation(entries, "v3").collect()}
    flags = [r.failed for r in entries.collect()]
    assert counted == {n: (sum(f >> i & 1 for f in flags), sum(f == 1 << i for f in flags)) for i, n in enumerate(names) if any(flags)}
    assert qr.apply_policy(entries, "v1").where("kept").count() >= qr.apply_policy(entries, "v3").where("kept").count()
    total = qr.rule_totals(entries).first()
    assert total.n == len(flags)


def test_warc_keeps_each_payload_of_a_repeated_page(spark):
    from tessera.llm import warc

    pages = spark.createDataFrame([(3, "u", "A"), (7, "u", "A"), (7, "u", "B"), (None, "u", "A")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(warc.plan_records(pages))).collect()
    want = [(3, "response", None, b"A"), (7, "response", None, b"B"), (7, "revisit", 3, b""), (None, "response", None, b"A")]
    assert sorted(((r.page_id, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
