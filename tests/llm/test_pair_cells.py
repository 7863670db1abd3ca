"""Pairs of a family are compared in cells; a text is sent once a cell."""

import random

import pytest

from sparkcurate.llm import near_copies


@pytest.mark.parametrize("side", [4, 128])
def test_verified_equals_all_pairs(spark, monkeypatch, side):
    monkeypatch.setattr(near_copies, "SIDE", side)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for n in range(30):
        words = list(base)
        for at in rng.sample(range(80), n % 5):
            words[at] = f"x{rng.randrange(10)}"
        texts[n - 9] = " ".join(words)
    pairs = [(a, b) for a in texts for b in texts if a < b and rng.random() < 0.8]
    pairs += [(-100, 100), (-100, 101)]
    texts |= {-100: None, 100: "", 101: "one text"}
    sets = {n: near_copies.shingles(t) for n, t in texts.items()}
    want = {(a, b) for a, b in pairs if near_copies.similarity(sets[a], sets[b]) >= near_copies.LEAST}
    got = near_copies.verified(spark.createDataFrame(pairs, "a long, b long"),
                               spark.createDataFrame(list(texts.items()), "node long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < len(want) < len(pairs)
