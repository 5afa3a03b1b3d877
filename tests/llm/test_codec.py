"""SentencePiece codec and token counts against the library and brute force."""

import random

import pytest

from tessera.llm import sentencepiece_codec as sc
from tessera.llm import token_counts as tc

TEXTS = ["Hello  world", "a\nb\t c ", " lead", "éèê ﬁx ① ｆ", "", "  ", "　x", "x" * 300, "internationalisation " * 9, "🙂🙃 a\u0000b", "<s> <0x41> </s>", "-" * 40 + " " * 30 + "end", "naïve Ünïcödé_" * 20, None]


@pytest.fixture(scope="module")
def pieces():
    return sc.load_model()


def test_units_encode_as_the_library(pieces):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sc.MODEL)
    rng = random.Random(5)
    words = [lib.id_to_piece(rng.randrange(259, 32000)).replace("▁", " ") for _ in range(3000)]
    texts = [t for t in TEXTS if t] + ["".join(words[i : i + rng.randrange(1, 9)]) for i in range(0, 3000, 5)]
    for text in texts:
        ids = [i for u in sc.units(text) for i in sc.encode_unit(u, pieces)]
        assert ids == lib.encode(text), text


def test_codec_round_trip(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sc.MODEL)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (3, "twice", 2), (3, "twice", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for size in (3, 1000):  # with a small table most units take the other way
        out = sc.decode(sc.encode(docs, table_units=size)).collect()
        assert sorted((r.doc_id is None, r.doc_id, r.ids, r.text) for r in out) == sorted((d is None, d, lib.encode(t or ""), t or "") for d, t, _ in rows)
    assert sc.encode(docs.limit(0)).count() == 0


def test_lattice_encodes_each_unit(spark, pieces):
    words = ["▁Hello", "▁", "▁▁▁▁▁▁▁", "a" * 30, "▁intern", "①é", "▁ﬁx"]
    got = {r.unit: r.ids for r in sc.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), pieces).collect()}
    assert got == {w: sc.encode_unit(w, pieces) for w in words}


def test_every_unit_goes_through_the_lattice(spark, monkeypatch):
    """No unit is encoded beside it: rare ones, whole long ones, ones without a piece."""
    import sentencepiece

    lattice, seen = sc.encode_units, set()

    def watched(distinct, *rest):
        seen.update(r.unit for r in distinct.collect())
        return lattice(distinct, *rest)

    monkeypatch.setattr(sc, "encode_units", watched)
    lib = sentencepiece.SentencePieceProcessor(model_file=sc.MODEL)
    rng = random.Random(11)
    texts = ["the cat the cat the cat rarely", "internationalisation" * 500, "".join(rng.choice("abcdeinrst") for _ in range(5000)), "①①", "▁▁ x", " " * 200, "zq" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in sc.encode(docs).collect()} == {i: lib.encode(t) for i, t in enumerate(texts)}
    pairs = sc.load_model().pairs
    assert {x for t in texts for u in sc.units(t) for x in sc.cut(u, pairs)} <= seen | {x for u in seen for x in sc.cut(u, pairs)}


def _shuffled(spark):
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_not_shuffled(spark):
    """The shuffles of an encoding take less than its input: frequent words, rare ones and words that occur once."""
    rng = random.Random(8)
    words = ["".join(rng.choice(("the", "an", "re", "tion", "ou", "ver", "Sch", "ei")) for _ in range(rng.randrange(1, 6))) for _ in range(30_000)]
    texts = [" ".join(words[min(int(rng.paretovariate(0.6)), len(words)) - 1] for _ in range(200)) for _ in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2).cache()
    docs.count()
    before = _shuffled(spark)
    assert sc.encode(docs).count() == len(texts)
    assert _shuffled(spark) - before < 0.5 * sum(map(len, texts))


def test_many_blocks_of_documents(spark, monkeypatch):
    """Blocks of a few documents, some of them equal, and one of a document that is longer than a block."""
    import sentencepiece

    monkeypatch.setattr(sc, "BLOCK_BYTES", 60)
    lib = sentencepiece.SentencePieceProcessor(model_file=sc.MODEL)
    texts = [t or "" for t in TEXTS] + ["rarely zqzq unparted"] * 40
    rows = [(7, t) for t in texts] + [(None, "rarely " * 3)] * 9
    got = sc.decode(sc.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), table_units=3)).collect()
    assert sorted((r.doc_id is None, r.ids, r.text) for r in got) == sorted((d is None, lib.encode(t), t) for d, t in rows)


def test_parts_of_many_units(pieces):
    words = ["", "①②", "▁Hello①", "zq" * 40, "a", "🙂ab🙃"]
    parts, n = sc._Cutter(pieces.pairs)(words)
    cut = [sc.cut(sc.MARK + w, pieces.pairs) for w in words]
    assert [*parts] == sum(cut, []) and n.tolist() == [*map(len, cut)]


def test_long_units_of_a_unigram_model(spark):
    table = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -5.0, "c": -2.0, "bc": -2.4, "aa": -1.9}
    p = sc.Pieces("unigram", ["<unk>", *table], [0.0, *table.values()])
    p.usable = {t: i + 1 for i, t in enumerate(table)}
    rng = random.Random(4)
    words = ["".join(rng.choice("abcx") for _ in range(n)) for n in (61, 130, 4200)]
    got = {r.unit: r.ids for r in sc.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), p).collect()}
    assert got == {w: sc.encode_unit(w, p) for w in words}


def test_viterbi_lattice(spark):
    table = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -5.0, "c": -2.0, "bc": -2.4, "aa": -1.9}
    p = sc.Pieces("unigram", ["<unk>", *table], [0.0, *table.values()])
    p.usable = {t: i + 1 for i, t in enumerate(table)}
    words = ["abc", "aabc", "abab", "xab", "aaa", "cab", "x"]
    best = {}
    for w in words:  # every segmentation
        options = []

        def go(at, score, ids, w=w, options=options):
            if at == len(w):
                options.append((round(score, 6), ids))
            for end in range(at + 1, len(w) + 1):
                if w[at:end] in table:
                    go(end, score + table[w[at:end]], [*ids, p.usable[w[at:end]]])
                elif end == at + 1:
                    go(end, score - 15.0, [*ids, 0])

        go(0, 0.0, [])
        best[w] = max(options)[0]
    score = lambda ids: round(sum(p.score[i] if i else -15.0 for i in ids), 6)
    got = {r.unit: r.ids for r in sc.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), p).collect()}
    assert {w: score(ids) for w, ids in got.items()} == best
    assert {w: score(sc.encode_unit(w, p)) for w in words} == best


def greedy(word, initial, inner):
    at, n, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n, pieces = end, n + 1, inner
    return n


def test_longest_match_counts():
    rng = random.Random(3)
    for _ in range(60):
        make = lambda: {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))}
        initial, inner = make(), make()
        automaton = tc.LongestMatch(initial, inner)
        for _ in range(60):
            word = "".join(rng.choice("abc" if rng.random() < 0.1 else "ab") for _ in range(rng.randrange(1, 12)))
            assert automaton.count(word) == greedy(word, initial, inner), (word, initial, inner)


def test_token_counts_of_texts(spark):
    initial, inner = map(set, tc.load_vocabulary())
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tc.token_counts(docs).collect()}
    for i, t in enumerate(TEXTS):
        words = [w.decode() for w in (t or "").encode().split()]
        assert got[i] == (len(words), sum(greedy(w, initial, inner) for w in words))
