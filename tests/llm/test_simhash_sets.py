"""SimHash near copies against brute force on the sets of their shingles."""

import random

import numpy as np
import pytest

from bandwright.llm import simhash
from tests.llm.test_operators import documents, sentence


def jaccard(a, b):
    x, y = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("words, times", [(200, 5), (500, 10), (2000, 20)])
def test_repeated_lines_stay_within_the_budget(words, times):
    draw = random.Random(words)
    for _ in range(20):
        prose, line = sentence(draw, words), sentence(draw, 10)
        pair = [prose + "\n" + line, prose + "\n" + "\n".join([line] * times)]
        assert jaccard(*pair) >= 0.9
        x, y = (np.frombuffer(simhash.wide_fingerprint(t.encode(), 5, 10, 2)[0][: simhash.WIDE * 8], np.uint64) for t in pair)
        assert np.bitwise_count(x ^ y).sum() <= simhash.bit_budget(0.8)


def test_a_shingle_repeated_across_blocks_counts_once():
    draw = random.Random(3)
    prose = sentence(draw, 50)
    once, often = (" ".join([prose] * n).encode() for n in (2, 3000))
    assert simhash.wide_fingerprint(once, 5, 10, 2) == simhash.wide_fingerprint(often, 5, 10, 2)


def test_near_copies_with_repeated_lines_leave_one(spark):
    draw, texts = random.Random(9), []
    for words, times in [(200, 5), (500, 10), (2000, 20), (300, 1)]:
        prose, line = sentence(draw, words), sentence(draw, 10)
        texts += [prose + "\n" + line, prose + "\n" + "\n".join([line] * times)]
    texts += [sentence(draw, 10) + "\n" + "\n".join([texts[0].split("\n")[1]] * 30)]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j]) >= 0.8}
    expected = {j for j in range(len(texts)) if not any(b == j for _, b in alike)}
    assert len(expected) == 5
    assert {r["doc_id"] for r in simhash.keep_one_of_each(documents(spark, list(enumerate(texts)))).collect()} == expected


@pytest.mark.parametrize("n", [40, 60, 300])
def test_a_group_with_equal_fingerprints_links_as_brute_force(n):
    draw = np.random.default_rng(n)
    for _ in range(10):
        base = draw.integers(0, 2**64, (n // 5, simhash.WIDE), np.uint64)
        value = base[draw.integers(0, len(base), n)]
        flip = np.flatnonzero(draw.random(n) < 0.3)
        value[flip, 0] ^= np.uint64(1) << draw.integers(0, 64, len(flip)).astype(np.uint64)
        sketch = draw.integers(1, 1 << 16, (3, simhash.BINS)).astype(np.uint16)[draw.integers(0, 3, n)]
        ids = draw.permutation(n).astype(np.int64) * 3
        i, j = np.triu_indices(n, 1)
        linked = (np.bitwise_count(value[i] ^ value[j]).sum(1) <= 50) & ((sketch[i] == sketch[j]).mean(1) >= 0.9)
        rank = ids // 3
        expected = simhash.least_labels(n, rank[i[linked]], rank[j[linked]])
        u, v, asked = simhash._group_forest(value, sketch, ids, 50, 0.8)
        assert not len(asked)
        assert (simhash.least_labels(n, u // 3, v // 3) == expected).all()


def test_variant_pairs_come_once_in_any_step():
    count = np.array([3, 1, 2])
    for step in (1, 2, 5, 100):
        got = [(int(a), int(b)) for u, v in simhash._variant_pairs(np.array([0, 2]), np.array([1, 0]), count, step) for a, b in zip(u, v)]
        assert sorted(map(sorted, got)) == [[0, 1], [0, 2], [0, 3], [0, 4], [0, 5], [1, 2], [1, 3], [1, 4], [1, 5], [2, 3], [2, 4], [2, 5], [4, 5]]


def variants(draw, similarity, n):
    """Texts near `similarity` of a base text of about n words, by changed words far apart."""
    words = sentence(draw, n).split()
    out = [" ".join(words)]
    for s in similarity:
        shared = 2 * s / (1 + s)  # of each text's shingles
        changed = list(words)
        for k in range(round((1 - shared) * n / 5)):
            changed[min(n - 1, round((k + 0.5) * n / max(1, round((1 - shared) * n / 5))))] = f"x{draw.random()}"
        out.append(" ".join(changed))
    return out


def test_copies_near_the_threshold_are_all_found_and_no_others(spark):
    draw, texts = random.Random(11), []
    for n in (40, 90, 200, 400, 700):
        for _ in range(4):
            texts += variants(draw, (0.70, 0.76, 0.785, 0.81, 0.83, 0.9), n)
    i, j = np.triu_indices(len(texts), 1)
    near = np.array([jaccard(texts[a], texts[b]) >= 0.8 if a // 7 == b // 7 else False for a, b in zip(i, j)])
    label = simhash.least_labels(len(texts), i[near], j[near])
    want = {k for k in range(len(texts)) if label[k] == k}
    got = {r["doc_id"] for r in simhash.keep_one_of_each(documents(spark, list(enumerate(texts)))).collect()}
    assert not want - got  # nothing below the similarity is dropped
    assert len(got - want) <= 0.1 * (len(texts) - len(want))


def test_rows_of_one_id_are_texts_of_their_own(spark):
    draw = random.Random(12)
    a, b = sentence(draw, 60), sentence(draw, 60)
    rows = lambda given, kind: sorted(map(tuple, simhash.keep_one_of_each(spark.createDataFrame(given, f"doc_id {kind}, text string, __row long")).collect()), key=repr)
    assert rows([(0, a, 7), (1, a, 8), (1, b, 9)], "long") == [(0, a, 7), (1, b, 9)]
    assert rows([("y", a, 1), ("x", a, 2), (None, a, 3), (None, b, 4)], "string") == [("x", a, 2), (None, b, 4)]
    assert rows([(3, None, 1), (2, "", 2), (5, " ", 3)], "int") == [(2, "", 2)]


def test_full_subtrees_are_taken_down_further(spark):
    draw = np.random.default_rng(3)
    low = draw.integers(0, 1 << 30, 3000, dtype=np.uint64) | np.uint64(0xABCD << 48)  # one long prefix for all
    value = np.unique(np.concatenate([low, low[:900] ^ np.uint64(1 << 5), low[:300] ^ np.uint64((1 << 50) | 2), draw.integers(0, 2**63, 200, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(v), int(v)) for v in value.view(np.int64)], "fp long, id long")
    u, v = np.array([tuple(r) for r in simhash.fingerprint_links(df, 2, per_bucket=16, levels=4).collect()]).T
    rank = {int(x): k for k, x in enumerate(value.view(np.int64))}
    at = lambda x: np.array([rank[int(k)] for k in x])
    i, j = simhash.trie_pairs(value[:, None], None, 0, 2)
    assert (simhash.least_labels(len(value), at(u), at(v)) == simhash.least_labels(len(value), i, j)).all()


def test_ids_of_any_type_and_texts_over_a_block(spark):
    draw = random.Random(13)
    long = " ".join([sentence(draw, 500)] * 150)  # more shingles than a block holds
    got = simhash.simhash_components(spark.createDataFrame([("b", long), ("a", long), ("c", "other words here")], "doc_id string, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
