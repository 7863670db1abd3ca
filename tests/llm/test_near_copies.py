"""Near copies of the pipeline against brute force over all pairs, and which rows stay."""

import random
from collections import Counter

import numpy as np

from sparkcurate.llm import near_copies


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(texts):
    sets = [grams(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def copies(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(50):
        words = random.choices(vocabulary, k=random.randint(1, 250))
        texts.append(" ".join(words))
        for _ in range(random.randint(0, 5)):
            # Every change touches five shingles: similarities from 0.95 down to 0.7.
            for _ in range(random.randint(0, max(1, len(words) // 45))):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            texts.append(" ".join(words))
    return texts


def test_similarity_equals_sets():
    texts = [*copies(3), None, "", "  ", "one two", "One TWO"]
    sets = [near_copies.shingles(t) for t in texts]
    for i in range(0, len(texts), 3):
        for j in range(max(0, i - 6), len(texts), 7):
            assert near_copies.similarity(sets[i], sets[j]) == jaccard(grams(texts[i]), grams(texts[j]))


def test_pairs_far_apart_in_simhash_leave_one_document(spark):
    words = [f"w{i}" for i in range(200)]
    edited = [f"x{i}" if i % 25 == 12 else w for i, w in enumerate(words)]
    assert 0.8 <= jaccard(grams(" ".join(words)), grams(" ".join(edited[:110] + words[110:]))) < 0.9
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, " ".join(edited[:110] + words[110:])), (3, " ".join(edited))],
        "doc_id long, text string")
    assert jaccard(grams(" ".join(words)), grams(" ".join(edited))) < 0.8
    # 3 is a copy of 2, not of 1, and falls by that link.
    assert jaccard(grams(" ".join(edited[:110] + words[110:])), grams(" ".join(edited))) >= 0.8
    assert [r.doc_id for r in near_copies.one_per_group(docs).collect()] == [1]


def test_groups_equal_brute_force(spark):
    texts = copies(5)
    groups = brute_groups(texts)
    least = {}
    for i, g in enumerate(groups):
        least.setdefault(g, i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = near_copies.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert len(least) > 50


def test_leaders_unlike_the_rest_lose_no_pair(spark, monkeypatch):
    """With one key for all, every pair is a candidate; pairs of any leader's leftovers are still compared."""
    monkeypatch.setattr(near_copies, "golay_keys", lambda prints, wide, pairs: [np.array([7])] * len(prints))
    monkeypatch.setattr(near_copies, "RADIUS", 256)
    monkeypatch.setattr(near_copies, "WHOLE_RADIUS", 512)
    texts = copies(8)[:90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_copies.one_per_group(docs).count() == len(set(brute_groups(texts)))


def test_near_copies_at_the_edges(edge_docs, no_docs):
    kept = near_copies.one_per_group(edge_docs)
    assert kept.columns == edge_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 5, None, 8, 9])
    assert near_copies.one_per_group(no_docs).count() == 0


def met(a, b):
    """Whether two texts are candidates, and their similarity."""
    one, two = near_copies.shingles(a), near_copies.shingles(b)
    prints = np.array([near_copies.fingerprints(one), near_copies.fingerprints(two)])
    every = tuple(range(near_copies.SEGMENTS // 2))
    narrow, wide = (near_copies.golay_keys(prints, w, every) for w in (False, True))
    far = np.bitwise_count((prints[0] ^ prints[1]).view(np.uint64))
    near = far[-near_copies.COMPARED :].sum() <= near_copies.RADIUS and far.sum() <= near_copies.WHOLE_RADIUS
    shared = np.isin(narrow[0], wide[1]).any() or np.isin(narrow[1], wide[0]).any()
    return shared and near, near_copies.similarity(one, two)


def test_recall_of_pairs_at_every_similarity():
    rng, found = random.Random(1), {}
    for _ in range(2500):
        n = rng.choice([12, 30, 60, 120, 300, 800])
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        other, kind = list(words), rng.random()
        if kind < 0.6:
            for _ in range(rng.randrange(1, max(2, n // 40) + 1)):
                other[rng.randrange(n)] = f"x{rng.randrange(3000)}"
        elif kind < 0.8:
            other = other[: int(n * rng.uniform(0.8, 1))]
        else:
            other += [f"y{rng.randrange(999)}" for _ in range(int(n * rng.uniform(0, 0.25)))]
        hit, alike = met(" ".join(words), " ".join(other))
        if 0.8 <= alike < 1:
            found.setdefault(int(alike * 20) / 20, []).append(hit)
    assert len(found) == 4 and min(map(len, found.values())) > 100
    assert all(sum(hits) / len(hits) >= 0.97 for hits in found.values()), {k: sum(h) / len(h) for k, h in found.items()}


def test_unlike_texts_seldom_meet():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 200))) for _ in range(300)]
    assert sum(met(a, b)[0] for a, b in zip(texts, texts[1:])) == 0


def test_words_one_bit_apart_share_a_codeword():
    rng = np.random.default_rng(3)
    prints = rng.integers(-(1 << 63), (1 << 63) - 1, (200, near_copies.LANES), dtype=np.int64)
    changed = prints.copy()
    for row in changed:  # one bit in each of two segments of one key
        for place in rng.integers(0, 23, 2) + np.array([0, 23]):
            row[place // 64] ^= np.int64(1 << int(place % 64))
    narrow, wide = near_copies.golay_keys(prints, False, (0,)), near_copies.golay_keys(changed, True, (0,))
    assert all(len(n) == 1 and n[0] in w for n, w in zip(narrow, wide))
    assert max(map(len, wide)) == 36


def test_families_that_share_a_passage_stay_apart(spark):
    """Texts alike at 0.5 to 0.79 keep all but the near copies among them, whatever the number of candidates."""
    rng = random.Random(6)
    passage, texts = [f"p{i}" for i in range(120)], []
    for k in range(120):
        own = [f"o{k}_{i}" for i in range(rng.choice([12, 16, 30, 60]))]
        texts.append(" ".join(own + passage))
    texts += [t + " end" for t in texts[::10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_copies.one_per_group(docs).count() == len(set(brute_groups(texts)))


def test_shared_shingles_count_what_others_have(spark):
    rows = [(1, "a b c d e f g"), (2, "x a b c d e"), (3, "q r s t u"), (4, ""), (5, "A B C D E f"), (6, None)]
    got = {r.node: r.shared for r in near_copies.shared_shingles(spark.createDataFrame(rows, "node long, text string")).collect()}
    assert got == {1: 2, 2: 1, 3: 0, 4: 0, 5: 2, 6: 0}


def test_wide_keys_that_no_text_has_are_not_sent(spark):
    """What meets is the same; a wide key is sent if and only if some text has it as its nearest."""
    texts = copies(3)
    made = [(i, len(s), [int(x) for x in near_copies.fingerprints(s)], i) for i, s in enumerate(map(near_copies.shingles, texts))]
    nodes = spark.createDataFrame(made, "node long, size int, prints array<bigint>, root long")
    every = tuple(range(near_copies.SEGMENTS // 2))
    narrow = near_copies.entries(nodes, False, every)
    whole = {(r.key, r.node) for r in near_copies.entries(nodes, True, every).select("key", "node").collect()}
    sent = near_copies.entries(nodes, True, every, near_copies.used_keys(narrow.select("key"))).select("key", "node").collect()
    has = {r.key for r in narrow.select("key").collect()}
    assert {(r.key, r.node) for r in sent} == {(k, n) for k, n in whole if k in has}
    assert len(sent) < len(whole) / 10


def test_bitmap_has_the_first_and_the_last_key(spark):
    last = near_copies.BITMAP * 8 - 1
    bits = near_copies.whole_bitmap(near_copies.used_keys(spark.createDataFrame([(0,), (9,), (40000,), (last,), (9,)], "key long")))
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == [0, 9, 40000, last]
