"""The induced sorter against sorting suffixes outright."""

import numpy as np
import pytest

from tessera.llm._induced import SpillingQueue, sort_segments, suffix_sort


def direct(segments, cap):
    text = [x for i, seg in enumerate(segments) for x in [*(b + len(segments) for b in seg), i]]
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    return text, order, common


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("options", [{}, {"budget": 64, "base": 2}])
def test_order_and_prefixes(seed, options):
    rng = np.random.default_rng(seed)
    letters = rng.integers(1, 5)
    segments = [bytes(rng.integers(97, 97 + letters, rng.integers(1, 40)).tolist()) for _ in range(rng.integers(1, 8))]
    if seed % 3 == 0:
        segments += segments[:2] + [b"a" * 50, bytes([255, 0, 255, 0])]
    cap = 1000 if seed % 2 else 7
    sa, lcp, _ = sort_segments(segments, cap, **options)
    text, order, common = direct(segments, cap)
    assert sorted(sa.tolist()) == list(range(len(text)))
    if cap == 1000:
        assert sa.tolist() == order
    assert [text[i : i + cap] for i in sa] == [text[i : i + cap] for i in order]
    assert lcp.tolist() == common


def test_larger_alphabet_recursion():
    rng = np.random.default_rng(1)
    s = np.append(rng.integers(1, 400, 3000), 0)
    s[1000:1500] = s[:500]
    sa, lcp = suffix_sort(s, 1, 5000, base=10)
    text = s.tolist()
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert lcp.max() >= 499


def test_queue_spills_and_keeps_order(tmp_path):
    q = SpillingQueue(100, f"file://{tmp_path}")
    for i in range(50):
        q.push(i % 3, np.arange(i, i + 5, dtype=np.int32), np.full(5, i, np.int16))
    assert q.spilled > 0
    got = np.concatenate([q.pop(c)[0] for c in range(3)])
    assert got.tolist() == [x for c in range(3) for i in range(c, 50, 3) for x in range(i, i + 5)]
    assert q.pop(0) is None
    assert [f for f in tmp_path.rglob("*") if f.is_file()] == []  # a file goes with its last run
    q.close()
    assert list(tmp_path.iterdir()) == []


def test_shard_of_many_times_the_budget_spills_and_recurses(tmp_path, monkeypatch):
    """A megabyte of text with 64 KiB of queue, and names sorted by recursion: as with everything in memory."""
    from tessera.llm import _induced

    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 60_000, dtype=np.uint8).tobytes()
    segments = [text[a : a + n] for a, n in zip(rng.integers(0, 50_000, 120).tolist(), rng.integers(50, 9000, 120).tolist(), strict=True)]
    spilled, depth, queue, sort = [], [], _induced.SpillingQueue, _induced.suffix_sort
    close = queue.close
    monkeypatch.setattr(queue, "close", lambda self: (spilled.append(self.spilled), close(self))[1])
    monkeypatch.setattr(_induced, "suffix_sort", lambda *a, **k: (depth.append(len(a[0])), sort(*a, **k))[1])
    order, common, starts = sort_segments(segments, 200, budget=64 << 10, base=20_000, folder=str(tmp_path))
    assert sum(spilled) > 1 << 20 and len(depth) > 1
    monkeypatch.undo()
    _, lcp, _ = sort_segments(segments, 200)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(common < 200)
    assert (common == lcp).all()  # the order of suffixes that agree on 200 symbols is free
    data = b"\0".join([*segments, b""])
    for i in np.flatnonzero(common >= 200)[:2000].tolist():
        assert data[order[i] : order[i] + 200] == data[order[i - 1] : order[i - 1] + 200]


@pytest.mark.parametrize("seed", range(6))
def test_suffix_tree_nodes(seed):
    """Nodes against all word sequences that repeat and can go on in more than one way."""
    from collections import defaultdict

    from tessera.llm.substring_dedup import SuffixTree

    rng = np.random.default_rng(seed)
    sequences = [rng.integers(1, 3 + seed % 2, rng.integers(0, 40)).astype(np.uint64) for _ in range(6)]
    tree = SuffixTree(sequences, 3)
    joined = np.concatenate([np.append(x.astype(np.int64), -i) for i, x in enumerate(sequences, 1)])
    end = np.flatnonzero(joined < 0)
    places, follow = defaultdict(set), defaultdict(set)
    for i in range(len(joined)):
        for j in range(i + 3, end[np.searchsorted(end, i)] + 1):
            places[tuple(joined[i:j].tolist())].add(i)
            follow[tuple(joined[i:j].tolist())].add(int(joined[j]))
    want = {(len(k), frozenset(v)) for k, v in places.items() if len(v) > 1 and len(follow[k]) > 1}
    leaves = [frozenset(tree.order[a:b].tolist()) for a, b in zip(tree.lo, tree.hi, strict=True)]
    assert set(zip(tree.depth.tolist(), leaves, strict=True)) == want and len(leaves) == len(want)
    for k, up in enumerate(tree.parent.tolist()):
        above = [m for m, leaf in enumerate(leaves) if leaves[k] < leaf]
        assert up == (max(above, key=lambda m: tree.depth[m]) if above else -1)
    node = tree.repeats()
    for i in range(len(joined)):
        key = tuple(joined[i : i + 3].tolist())
        assert (node[i] >= 0) == (len(places.get(key, ())) > 1)
        assert node[i] < 0 or set(np.flatnonzero(node == node[i]).tolist()) == places[key]


def test_hashes_part_words_that_a_modulus_of_two_joins():
    """The two Thue-Morse words of 4096 letters, which collide modulo 2**64 for every odd base."""
    from tessera.llm import _text as tx

    word = b"a"
    for _ in range(12):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(word + b" " + other + b" " + word, np.uint8)
    one, two, three = tx.Words(data, np.array([0, len(data)])).hashes()
    assert one == three != two
    prime, base, want = tx._PRIME, tx._BASE % tx._PRIME, 0
    values = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    for i, x in enumerate(tx.prefix_sums(values).tolist()):
        assert x == want
        want = (want + int(values[min(i, 49)]) * pow(base, i, prime)) % prime


def test_words_of_long_texts_are_hashed_in_pieces(monkeypatch):
    from tessera.llm import _text as tx

    data = np.frombuffer(b"ab  cde f " * 50 + b"x" * 300 + b" y", np.uint8)
    whole = tx.Words(data, np.array([0, len(data)])).hashes()
    monkeypatch.setattr(tx, "SLICE_BYTES", 16)
    assert (tx.Words(data, np.array([0, len(data)])).hashes() == whole).all()
