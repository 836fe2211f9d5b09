"""Packing's reduction keeps the optimum; languages without spaces are learned."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from taleweave.llm import langid
from taleweave.llm.packing import best_fit, plan, reduce_dominated
from tests.llm.test_corpus_ops import texts


def fewest(items, capacity):
    """The fewest bins, by trying each item in each open bin."""
    best = len(items)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            put(i + 1, [r - items[i] if j == k else r for j, r in enumerate(rooms)])
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best


def test_reduction_keeps_the_fewest_bins():
    rng = random.Random(9)
    kinds = Counter()
    for trial in range(400):
        capacity = rng.choice([10, 20, 30])
        low = rng.choice([1, 2, capacity // 4])
        items = sorted((rng.randrange(low, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        fixed, left = reduce_dominated(Counter(items), capacity)
        used = Counter({k: n for k, n in left.items()})
        for bin_, times in fixed:
            assert sum(bin_) <= capacity and times > 0
            for k in bin_:
                used[k] += times
            kinds[len(bin_)] += times
        assert used == Counter(items)
        rest = [k for k, n in left.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + (fewest(sorted(rest, reverse=True), capacity) if rest else 0) == fewest(items, capacity), (items, capacity, fixed)
    assert kinds[1] and kinds[2] and kinds[3] > 10


def test_passes_go_on_until_nothing_is_fixed():
    for seed in range(20):
        rng = random.Random(seed)
        histogram = Counter(rng.randrange(200, 2049) for _ in range(3000))
        fixed, left = reduce_dominated(histogram, 2048)
        assert reduce_dominated(left, 2048) == ([], left)
        assert sum(len(b) * t for b, t in fixed) > 300
    slots = plan(Counter({2048: 3, 1: 5, 1024: 2}), 2048)
    assert sorted(slots["length"].tolist()) == sorted(slots["length"]) and best_fit({}, 10) == []


def brute_counts(word, pieces, p):
    """Expected counts of pieces over all segmentations of one word."""
    total, counts = 0.0, Counter()
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(x in p for x in parts):
            weight = float(np.prod([p[x] for x in parts]))
            total += weight
            for x in parts:
                counts[x] += weight
    return {x: c / total for x, c in counts.items()}


def test_long_words_are_weighed_over_all_segmentations(monkeypatch):
    monkeypatch.setattr(langid, "MOST_BYTES", 2)
    pieces = [b" ", b"a", b"b", b"ab", b"ba", b" a", b"aba"]
    trie = langid.Pieces(pieces)
    p = np.zeros(len(trie.step))
    values = dict(zip(pieces, [0.2, 0.1, 0.05, 0.2, 0.15, 0.1, 0.2]))
    p[trie.ends] = [values[x] for x in pieces]
    words = [b"abab", b"babababa", b"aaa"]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    out = langid._expected_long(trie, p, raw, ends - [len(w) for w in words], ends, np.array([1.0, 2.0, 3.0]), False)
    want = Counter()
    for w, often in zip(words, (1, 2, 3)):
        for x, c in brute_counts(b" " + w, pieces, values).items():
            want[x] += often * c
    assert np.allclose(out[trie.ends], [want[x] for x in pieces])


def test_very_long_words_stay_in_range():
    trie = langid.Pieces([bytes([c]) for c in range(256)] + [b"ab"])
    p = np.zeros(len(trie.step))
    p[trie.ends] = 1e-4
    raw = np.frombuffer(b"ab" * 20_000, np.uint8)
    out = langid._expected_long(trie, p, raw, np.array([0]), np.array([len(raw)]), np.array([1.0]), False)
    assert np.isfinite(out).all() and abs((out * trie.lengths).sum() - len(raw) - 1) < 1e-3


@pytest.mark.parametrize("cut", [langid.MOST_BYTES])
def test_a_language_without_spaces_is_learned(spark, cut):
    import public_tokenizers

    rng = random.Random(4)
    han, latin = [chr(c) for c in range(0x4E00, 0x4E00 + 80)], ["the", "house", "river", "stone", "walks", "over", "and", "old"]
    make = {"zh": lambda: "".join(rng.choice(han) for _ in range(rng.randrange(30, 200))), "en": lambda: " ".join(rng.choice(latin) for _ in range(rng.randrange(10, 40)))}
    langs = [rng.choice(["zh", "en"]) for _ in range(120)]
    docs = texts(spark, [make[x]() for x in langs]).drop("lang").join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id")
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}
    model = langid.learn_from(docs.where(~docs.doc_id.isin(*held)), langid.load_pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    assert model["languages"] == ["en", "zh"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert all(got[i] == langs[i] for i in held) and len(held) > 10
