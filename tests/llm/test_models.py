"""Decontamination and the quality classifier on small corpora with known answers."""

import random
import tracemalloc

import numpy as np

from tessera.llm import decontamination as dc
from tessera.llm import quality_classifier as qc


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(8)] + [(98, None), (99, "too short"), (None, text(30))]
    docs = [(i, text(200)) for i in range(40)]
    exact = items[2][1].upper().replace(" ", ", ")
    edited = items[5][1].split(" ")
    edited[10] = edited[20] = "changed"
    docs += [(100, text(80) + " " + exact + " " + text(50)), (101, text(20) + " " + " ".join(edited)), (102, None), (103, ""), (102, "")]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100, 2), (101, 5)}
    assert {r.doc_id: (r.score, r.word_from, r.word_to) for r in got}[100] == (1.0, 80, 110)
    accents = [(0, "été à l'école où garçons ñandú œuvre öffnen straße naïf")]
    shouted = spark.createDataFrame([(1, "x y " + accents[0][1].replace("ß", "ss").upper() + " z")], "doc_id long, text string")
    (hit,) = dc.leaks(shouted, spark.createDataFrame(accents, "item_id long, text string")).collect()
    assert hit.score > 0.7
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_every_copy_that_scores_enough_is_found(spark):
    """Copies without six, or even three, unedited words in a row."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([5, 8, 12, 20, 20, 40, 60] * 2)]
    docs, want = [], set()
    for item, text in items:
        own = text.split(" ")
        for k in (2, 3, 4, 5, 6):
            for edit in ("replace", "insert"):
                copy = []
                for i, w in enumerate(own):
                    last = i % k == k - 1
                    copy += [w] if not last else ["edited"] if edit == "replace" else [w, "edited"]
                text = [rng.choice(words) for _ in range(40)] + copy + [rng.choice(words) for _ in range(30)]
                docs.append((len(docs), " ".join(text)))
    names = {w: i for i, w in enumerate([*words, "edited"])}
    number = lambda t: np.array([names[w] for w in t.split(" ")])
    for doc, text in docs:
        for item, other in items:
            if dc.align(number(other), number(text))[0] >= dc.needed(len(other.split(" ")), dc.LEAST):
                want.add((doc, item))
    assert len(want) > 90
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_classifier_learns_and_scores_everything(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "along", "a", "quiet", "valley"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["buy", "###", "now", "!!", "river"]) for _ in range(60))
    docs = [(i, good() if i % 3 else bad()) for i in range(300)]
    odd = [(1000, None), (1001, ""), (None, "text"), (5, docs[5][1])]
    labels = [(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7, None)]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string")
    out = qc.quality_query(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == 304 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    alone = qc.quality_query(frame, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(alone) == 304


def test_needed_score_falls_with_length():
    share = [dc.needed(n, 0.5) / (dc.MATCH * n) for n in (6, 14, 20, 22, 25, 60)]
    assert share[:3] == [0.5] * 3 and share[3] == 10 / 22 and share[4:] == [0.4] * 2


def test_alignment_is_smith_waterman():
    """Scores against the plain recurrence; the place given holds an alignment of that score."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        item, text = (rng.integers(0, 4, n).astype(np.uint64) for n in rng.integers(1, 15, 2))
        best = np.zeros((len(item) + 1, len(text) + 1), int)
        for i, x in enumerate(item.tolist(), 1):
            for j, y in enumerate(text.tolist(), 1):
                step = dc.MATCH if x == y else dc.MISS
                best[i, j] = max(0, best[i - 1, j - 1] + step, best[i - 1, j] + dc.MISS, best[i, j - 1] + dc.MISS)
        score, start, end = dc.align(item, text)
        assert score == best.max()
        assert dc.align(item, text[start:end])[0] == score
        first = np.flatnonzero((best == score).any(axis=0))
        assert not score or (best[:, end] == score).any() and end in first


def test_dual_coordinate_descent_reaches_the_optimum():
    """The hinge-loss objective against a long projected subgradient descent on dense vectors."""
    rng = np.random.default_rng(5)
    n, width = 60, 40
    dense = (rng.random((n, width)) < 0.3) * rng.normal(size=(n, width))
    dense[:, 0] = 1
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    y = np.where(dense @ rng.normal(size=width) + 0.3 * rng.normal(size=n) > 0, 1.0, -1.0)
    cost = rng.uniform(0.3, 3, n)
    rows = [np.flatnonzero(x) for x in dense]
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    value = np.concatenate([dense[i][r] for i, r in enumerate(rows)])
    w = qc.coordinate_descent(np.concatenate(rows), at, value, y, cost, epochs=2000)[:width]
    goal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (dense @ v))).sum()
    v, least = np.zeros(width), np.inf
    for step in range(1, 40_000):
        v = v - (v - (cost * y * (y * (dense @ v) < 1)) @ dense) / step
        least = min(least, goal(v))
    assert goal(w) <= least * 1.0001 and goal(w) >= least * 0.99


def test_fit_holds_little_beside_the_features(monkeypatch):
    """Less than the features' own memory once more, and the same model however they are cut."""
    rng = np.random.default_rng(6)
    n, width = 2000, 4000
    numbers = np.concatenate([np.unique(rng.integers(0, 1 << qc.BITS, width)) for _ in range(n)]).astype(np.int32)
    at = np.append(0, np.flatnonzero(np.diff(numbers) < 0) + 1)
    at = np.append(at, len(numbers))
    assert len(at) == n + 1
    label, fold = rng.integers(0, 2, n), rng.integers(0, 5, n)
    tracemalloc.start()
    try:
        model = qc.fit(numbers, at, label, fold)
        assert tracemalloc.get_traced_memory()[1] < numbers.nbytes
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(qc, "PART", 1000)  # less than a document
    few = at[:201]
    small = qc.fit(numbers[: few[-1]], few, label[:200], fold[:200])
    monkeypatch.setattr(qc, "PART", 1 << 40)
    whole = qc.fit(numbers[: few[-1]], few, label[:200], fold[:200])
    assert all(np.array_equal(x, y) for x, y in zip(small, whole, strict=True))
    assert np.isfinite(model[0]).all() and model[1].any()
