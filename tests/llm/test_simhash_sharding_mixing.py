"""Near-duplicates, shards and mixes against brute force, and their defined results at the edges."""

import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkcurate.llm import mixing, near_copies, sharding, simhash
from sparkcurate.llm.common import stored


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(known, doc)
    return Counter((doc, f"{prints[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(rows))


def test_words_one_bit_apart_share_a_codeword():
    for width in (12, 13, 16):
        nearest, answers = simhash.segment_keys(width)
        for value in range(0, 1 << width, 37):
            for bit in range(width):
                assert nearest[value] in answers[value ^ 1 << bit]


def test_keys_find_every_pair_within_four_bits():
    random.seed(3)
    for segments in (4, 5):
        for _ in range(200):
            value = random.getrandbits(64)
            other = value
            for bit in random.sample(range(64), random.randint(0, 4)):
                other ^= 1 << bit
            assert set(simhash.fuzzy_keys(value, segments, 4, False)) & set(
                simhash.fuzzy_keys(other, segments, 4, True))


def test_groups_equal_brute_force(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = random.choices(vocabulary, k=random.randint(0, 120))
        rows.append((3 * i, " ".join(words)))
        for k in range(random.randint(0, 4)):
            if words:
                words[random.randrange(len(words))] = random.choice(vocabulary)
            rows.append((1000 + 10 * i + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert found == brute_groups(rows)


def test_keys_of_small_tables_are_not_broadcast(spark):
    """190 keys a node at most: a table of nodes below the broadcast threshold says nothing of their size."""
    nodes = stored(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    plan = simhash.fingerprint_links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_stars_are_components_without_a_round(spark, monkeypatch):
    """Edges that hang on roots already are written once: the driver plans no round that changes nothing."""
    written = []
    monkeypatch.setattr(simhash, "stored", lambda df: written.append(1) or stored(df))
    edges = spark.createDataFrame([(1, 5), (7, 1), (2, 3), (3, 2), (4, 4)], "a long, b long")
    assert sorted(simhash.components(edges).collect()) == [(3, 2), (5, 1), (7, 1)] and len(written) == 1


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(path + star + [(7, 7), (1, 0)], "a long, b long")
    found = dict(simhash.components(edges).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 50)}}


def test_near_duplicates_at_the_edges(edge_docs, edge_rows, no_docs):
    rows = [(i, t) for i, t, _ in edge_rows]
    found = Counter(tuple(r) for r in simhash.near_duplicates(edge_docs).collect())
    assert found == brute_groups(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_document_of_each_group_stays(edge_docs, edge_rows, no_docs):
    kept = simhash.one_per_group(edge_docs)
    assert kept.columns == edge_docs.columns
    want = Counter(c for *_, c in brute_groups([(i, t) for i, t, _ in edge_rows]))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(dict.fromkeys(want, 1))
    assert simhash.one_per_group(no_docs).count() == 0


def test_groups_without_an_id_or_with_a_repeated_one_stay_apart(spark):
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]),
            (None, texts[4]), (9, texts[4]), (3, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (3, texts[5])])
    for keep in (simhash.one_per_group, near_copies.one_per_group):
        assert Counter(tuple(r) for r in keep(docs).collect()) == want


def greedy(sizes, capacity):
    shards, used = [], 0
    for size in sizes:
        if used + size > capacity and used:
            shards.append(used)
            used = 0
        used += size
    return shards + [used]


def test_shards_are_the_smallest_greedy_partition(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    random.seed(1)
    rows = [(i, "x" * random.choice([1, 5, 50, 400])) for i in range(150)]
    rows += [(500 + i, f"text {random.randint(0, 60)}") for i in range(300)] + [(900 + i, "hot " * 40) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_by_bytes(docs).toPandas()
    groups = docs.groupBy(F.xxhash64("text").alias("k")).agg(
        F.sum(F.octet_length("text") + 1).alias("s")).orderBy("k").collect()
    sizes = [r.s for r in groups]
    low = max(sizes)
    while len(greedy(sizes, low)) > 16:
        low += 1
    assert found.groupby("shard")["size"].sum().tolist() == greedy(sizes, low)
    by_text = found.merge(docs.toPandas(), on="doc_id").groupby("text")["shard"].nunique()
    assert by_text.max() == 1
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_at_the_edges(edge_docs, edge_rows, no_docs):
    found = sharding.shard_by_bytes(edge_docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _, _ in edge_rows)
    assert {r["size"] for r in found if r.doc_id in (2, 3)} == {1}
    assert len({r.shard for r in found if r.doc_id in (2, 3)}) == 1
    assert all(r.law == "bytes" and r.grown_shard is None for r in found)
    assert sharding.shard_by_bytes(no_docs).count() == 0


def brute_targets(sizes, weights):
    total, capped, level = 1.5 * sum(sizes), set(), 0.0
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        if not open_:
            break
        level = (total - sum(2 * sizes[i] for i in capped)) / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * level >= 2 * sizes[i]}
        if not over:
            break
        capped |= over
    return [min(2 * s, w * level) for s, w in zip(sizes, weights, strict=True)]


def test_mix_follows_keys_and_targets(spark):
    random.seed(8)
    rows = [(i, " ".join(["w"] * random.randint(0, 30)), random.choice(["a", "b", "b", "c", None, "ä"]))
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    order = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == o) for o in order]
    targets = brute_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))])
    keyed = mixing.exponential_key(F.col("doc_id"), mixing.text_quality(F.col("text")), 42)
    keys = dict(docs.select("doc_id", keyed).collect())
    for source, size, target in zip(order, sizes, targets, strict=True):
        members = sorted((i for i, _, s in rows if s == source), key=lambda i: keys[i])
        epochs = int(target // size)
        budget = math.floor(round(target, 6)) - epochs * size
        for i in members:
            r = found[i]
            drawn = max(0, min(r["size"], budget))
            budget -= drawn
            assert (r.source_size, r.taken) == (size, epochs * r["size"] + drawn)
            assert abs(r.target - target) < 1e-5


def test_mix_at_the_edges(edge_docs, edge_rows, no_docs):
    found = mixing.mix_sources(edge_docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _, _ in edge_rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in found)
    assert all(r["size"] == 0 for r in found if r.doc_id in (2, 3, 4))
    mixed = mixing.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert {2, 3, 4} <= {r.doc_id for r in mixed.collect()}
    assert mixing.mix_sources(no_docs).count() == 0 == mixing.mixed_documents(no_docs).count()


def test_keys_prefer_quality(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    mix = mixing.mix_sources(docs, F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), share=0.3, most=2.0)
    taken = mix.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("taken").alias("t")).collect()
    words = {r.odd: r.t for r in taken}
    assert sum(words.values()) == int(0.3 * 16000)
    assert words[0] > 2 * words[1]
    assert np.isclose(words[0] + words[1], 4800)
