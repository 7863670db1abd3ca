"""The field, the language model, the benchmark search and the pipeline: brute force, held-out rows, edges."""

import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from sparkcurate.llm import decontamination, lm_scoring, toxicity
from sparkcurate.llm.registry import ORACLES, QUERIES
from tests.conftest import SMALL


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_chain_equals_all_taggings():
    rng = np.random.default_rng(1)
    for _ in range(40):
        chain, length = rng.normal(size=4), int(rng.integers(1, 9))
        at = np.sort(rng.choice(length, int(rng.integers(0, length + 1)), replace=False))
        scores = rng.normal(size=len(at))
        move, emit = np.array([[0, chain[1]], [chain[2], chain[3]]]), np.full(length, chain[0])
        emit[at] += scores
        total, mass = 0.0, np.zeros(length)
        for tags in itertools.product((0, 1), repeat=length):
            value = sum(move[a, b] for a, b in zip((0, *tags), tags, strict=False)) + float(emit @ np.array(tags))
            total += math.exp(value)
            mass += math.exp(value) * np.array(tags)
        found, logs = toxicity.Chain(chain).marginals([at, at[:0]], [scores, scores[:0]], np.array([length, 0]))
        assert logs[0] == pytest.approx(math.log(total)) and logs[1] == pytest.approx(0)
        assert np.allclose(found[0], (mass / total)[at])


def toxic_corpus():
    random.seed(2)
    clean = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "ero", "imi", "olo", "ust")]
    bad = ["zorkel", "zorkman", "vilgarto", "snarfle"]
    rows, labels = [], []
    for i in range(900):
        words = random.choices(clean, k=random.randint(20, 60))
        toxic = i % 5 == 2
        for _ in range(random.randint(2, 5) if toxic else 0):
            words.insert(random.randrange(len(words)), random.choice(bad))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents_and_spans(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    truth = spark.createDataFrame([*labels, (None, 1), (5, None), (3, labels[3][1])], "doc_id long, toxic int")
    found = toxicity.score_documents(docs, toxicity.train(docs, truth)).collect()
    wanted, texts = dict(labels), {i: t for i, t, _ in rows}
    held = [r for r in found if remainder(r.doc_id) == 0]
    assert sum(r.predicted == wanted[r.doc_id] for r in held) >= 0.97 * len(held)
    marked = Counter(texts[r.doc_id][int(a):int(b)] for r in found for a, b in
                     (s.split(":") for s in r.spans.split(",") if s))
    assert marked.most_common(4) and {w for w, _ in marked.most_common(4)} == {"zorkel", "zorkman", "vilgarto", "snarfle"}
    kept = toxicity.without_toxic(docs, truth)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.predicted == 0}


def test_toxicity_at_the_edges(spark, edge_docs, edge_rows, no_docs):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    one_kind = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    for truth in (nothing, one_kind):
        found = toxicity.score_documents(edge_docs, toxicity.train(edge_docs, truth)).collect()
        assert Counter(r.doc_id for r in found) == Counter(i for i, _, _ in edge_rows)
        assert len({r.score for r in found}) == 1 and all(r.predicted == 0 for r in found)
        assert toxicity.without_toxic(no_docs, truth).count() == 0


def test_code_is_a_complete_prefix_code():
    rng = np.random.default_rng(4)
    symbol = lm_scoring.symbols_of(rng.integers(0, 1000, 256))
    pairs = np.zeros((lm_scoring.CODES**2, lm_scoring.CODES), dtype=np.int64)
    pairs[:50] = rng.integers(0, 50, (50, lm_scoring.CODES))
    code = lm_scoring.Code(symbol, pairs)
    for pair in (0, 7, 4000):
        lengths = code.length[pair * 64 : pair * 64 + 64]
        assert sum(2.0 ** -int(n) for n in lengths) == pytest.approx(1.0)
    key = np.array([5, 64 * 7 + 3, 5])
    of, at = code.bits(key)
    for k in range(3):
        want = code.steps[code.start[key[k]] : code.start[key[k]] + code.length[key[k]]]
        assert (code.steps[at[of == k]] == want).all()


def test_bit_probabilities_sum_to_one():
    """Over all codes, the mixed probabilities of a byte add up to one: the score is a probability."""
    rng = np.random.default_rng(6)
    symbol = lm_scoring.symbols_of(np.bincount(np.frombuffer(b"abcdef ghi\n" * 30, np.uint8), minlength=256))
    pairs = rng.integers(0, 9, (lm_scoring.CODES**2, lm_scoring.CODES))
    code = lm_scoring.Code(symbol, pairs)
    words = {0: rng.integers(-90, 90, lm_scoring.PAGE // 2).astype(np.int8)}
    model = lm_scoring.Model(code, {}, words, 16)
    common = [bytes([b]) for b in range(256) if symbol[b] < lm_scoring.CODES - 1 and b not in b" \t\n\v\f\r"]
    end = model.cost([b"abc"], rate=0.0)
    total = sum(2.0 ** -(model.cost([b"abc" + x], rate=0.0)) for x in common[:5])
    assert 0 < total < 1 and end > 0
    shares = []
    for x in common:
        data = [b"ab" + x]
        shares.append(2.0 ** -model.cost(data, rate=0.0))
    assert sum(shares) < 1.0


def test_tables_learn_from_every_training_document(spark):
    docs = spark.createDataFrame([(n, f"word{n} said") for n in range(12)], "id long, text string")
    model = lm_scoring.train(docs, lm_scoring.token_counts(docs), slots_log2=16)
    assert model.words.any() and model.three.any()


def test_first_weights_are_learnt_from_every_training_document(spark):
    rng = random.Random(9)
    rows = [(n, " ".join(rng.choices(["said", "the", "word", "of", f"word{n}"], k=rng.randint(1, 30)))) for n in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = [lm_scoring.train(d, lm_scoring.token_counts(d), slots_log2=16) for d in (docs.coalesce(1), docs.repartition(5))]
    start = lm_scoring.Model(found[0].code, {}, {}, 16).weights
    assert (found[0].weights != start).any() and found[0].weights == pytest.approx(found[1].weights, abs=1e-6)
    half = {r.id: r.half for r in docs.select("id", lm_scoring.half_of(docs["id"]).alias("half")).collect()}
    assert set(half.values()) == {0, 1}
    # Every bit of every text chose a gate, and a text that is left out is missed.
    some = docs.where("id <> 7")
    bits = [int(lm_scoring.end_weights(d, found[0])[-1].sum()) for d in (docs, some)]
    alone = np.zeros((5, lm_scoring.GATES), dtype=np.int64)
    found[0].costs([lm_scoring.tokens_of(rows[7][1])], alone)
    assert bits[0] - bits[1] == alone[-1].sum() > 0


def test_a_half_has_the_counts_of_its_own_texts(spark):
    rows = [(n, f"a common part{n % 3} of word{n}") for n in range(30)]
    docs = spark.createDataFrame(rows, "id long, text string")
    half = {r.id: r.half for r in docs.select("id", lm_scoring.half_of(docs["id"]).alias("half")).collect()}
    want = {h: Counter(w for n, t in rows if half[n] == h for w in [*t.split(), ""]) for h in (0, 1)}
    for r in lm_scoring.token_counts(docs).collect():
        token = bytes(r.token).decode()
        assert (r.n - r.n1, r.n1) == (want[0][token], want[1][token])
        assert (r.ends, r.ends1) == tuple(sum(t.endswith(" " + token) for n, t in rows if token and half[n] in some) for some in ((0, 1), (1,)))


def test_bytes_without_a_code_are_told_by_their_counts(spark):
    """More bytes than there are codes: those left over cost what the corpus says of them, not eight bits each."""
    rng = np.random.default_rng(2)
    symbol = lm_scoring.symbols_of(rng.integers(1, 1000, 256))
    counts = np.where(symbol == lm_scoring.CODES - 1, rng.integers(0, 3, (256, 256)), 0)
    shares = 2.0 ** -lm_scoring.escape_bits(symbol, counts).reshape(256, 256)
    assert shares.sum(axis=1) == pytest.approx(np.ones(256))
    letters = "".join(chr(c) for c in range(0x21, 0x5F)) + "abcdefghijklmnopqrstuvwxyz{|}~"
    rows = [(n, f"{letters} \u4e2d\u6587") for n in range(12)]
    docs = spark.createDataFrame(rows, "id long, text string")
    model = lm_scoring.train(docs, lm_scoring.token_counts(docs), slots_log2=16)
    data = np.frombuffer(lm_scoring.coded(lm_scoring.tokens_of(rows[0][1])), dtype=np.uint8)
    at, keys = lm_scoring.escaped(data, model.code.symbol[data], np.zeros(1, dtype=np.int64))
    assert len(at) and model.escapes[keys].mean() < 3


def small_model():
    rng = np.random.default_rng(5)
    symbol = lm_scoring.symbols_of(np.bincount(np.frombuffer(b"abcdef ghi   \n" * 30, np.uint8), minlength=256))
    code = lm_scoring.Code(symbol, rng.integers(0, 9, (lm_scoring.CODES**2, lm_scoring.CODES)))
    words = {p: rng.integers(-90, 90, lm_scoring.PAGE // 2).astype(np.int8) for p in range(4)}
    return lm_scoring.Model(code, {}, words, 16)


def test_texts_scored_together_cost_what_they_cost_alone():
    model, rng = small_model(), random.Random(3)
    texts = [[bytes(rng.choices(b"abcdefghiz\xc3", k=rng.randint(1, 9))) for _ in range(n)]
             for n in (0, 1, 3, 700, 40, 2500, 5, 900, 0, 333, 4000, 12)]
    assert model.costs(texts) == pytest.approx([model.cost(t) for t in texts], rel=1e-6)


def test_pages_are_sent_small_and_whole():
    """A table in use takes two bytes a slot at most on its way, and comes back as it was."""
    page = np.random.default_rng(8).geometric(0.5, lm_scoring.PAGE).astype(np.uint32) - 1
    page[:3] = 255, 254, 1 << 31
    packed = lm_scoring.packed_counts(page)
    assert (lm_scoring.unpacked_counts(packed) == page).all() and len(packed) < lm_scoring.PAGE


def test_word_bits_from_token_counts_are_those_of_the_texts():
    code, rng = small_model().code, random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdz", k=rng.randint(1, 5))) for _ in range(n)) for n in (0, 1, 200, 2, 90)]
    counts, ends, pairs = Counter(), Counter(), np.zeros((lm_scoring.CODES**2, lm_scoring.CODES), dtype=np.int64)
    want = lm_scoring.Tally(2 << 16)
    for text in texts:
        words = lm_scoring.tokens_of(text)
        counts.update([*words, b""])
        ends.update(words[-1:])
        data = np.frombuffer(lm_scoring.coded(words), dtype=np.uint8)
        keys = (lm_scoring.last_codes(code.symbol[data], code.blank) & 0xFFF) << 6 | code.symbol[data]
        np.add.at(pairs.reshape(-1), keys, 1)
        of, at = code.bits(keys)
        rows = lm_scoring.word_rows(lm_scoring.word_hashes(data)[0], 16)
        want.add(lm_scoring.count_slots(rows[of], code.steps[at].astype(np.int64)))
    got = lm_scoring.Tally(2 << 16)
    batch = pd.DataFrame([(t, n, ends[t]) for t, n in counts.items()], columns=["token", "n", "ends"])
    lm_scoring.count_word_bits(got, batch, code, 16, pairs)
    assert (got.tables[0] == want.tables[0]).all()


def test_weights_learn_from_every_bit():
    """The step of the weights over one block equals the gradient summed bit by bit."""
    rng = np.random.default_rng(11)
    text = b"abcdef ghi feed bad cafe " * 4
    symbol = lm_scoring.symbols_of(np.bincount(np.frombuffer(text + b"\n", np.uint8), minlength=256))
    pairs = rng.integers(0, 9, (lm_scoring.CODES**2, lm_scoring.CODES))
    code = lm_scoring.Code(symbol, pairs)
    words = {p: rng.integers(-60, 60, lm_scoring.PAGE // 2).astype(np.int8) for p in range(4)}
    model = lm_scoring.Model(code, {}, words, 16)
    moved = model.weights.copy()
    model.cost(text.split(), moved, 0.06)
    data = np.frombuffer(lm_scoring.coded(text.split()), dtype=np.uint8)
    three, hashes = lm_scoring.last_codes(symbol[data]), lm_scoring.word_hashes(data)
    of, at = code.bits((three & 0xFFF) << 6 | symbol[data])
    sums, seen = np.zeros((4, lm_scoring.GATES)), np.zeros(lm_scoring.GATES)
    for i, (byte, place) in enumerate(zip(of.tolist(), at.tolist(), strict=True)):
        node, bit, depth = int(code.steps[place]) & 63, int(code.steps[place]) >> 6 & 1, int(code.steps[place]) >> 7
        odds = [int(model.words[k][lm_scoring.word_slots(lm_scoring.word_rows(h[byte:byte + 1], 16), node)[0]])
                for k, h in enumerate(hashes)]
        gate = depth + sum(int(model.level[k][o & 255]) for k, o in enumerate(odds))
        x = np.array([code.odds[place], model.three[(int(three[byte]) << 6) + node], *odds], dtype=float)
        mixed = float(model.weights[:, gate] @ x)
        sums[:, gate] += (bit - 1 / (1 + math.exp(-mixed))) * x
        seen[gate] += 1
    want = model.weights + 0.06 / lm_scoring.SCALE**2 * sums / np.sqrt(1 + seen)
    want = np.clip(want, -0.5 / lm_scoring.SCALE, 1.5 / lm_scoring.SCALE)
    assert len(data) <= lm_scoring.BLOCK and np.abs(want - model.weights).max() > 1e-4
    assert np.allclose(moved, want, atol=1e-6)


def test_language_model_scores(spark, edge_docs, edge_rows, no_docs):
    random.seed(9)
    syllables = ["ka", "mo", "ri", "tes", "un", "lo", "pri", "ant"]
    vocabulary = ["".join(random.choices(syllables, k=3)) for _ in range(400)]
    rows = [(i, " ".join(random.choices(vocabulary, weights=range(1, 401), k=80))) for i in range(300)]
    rows += [(i, t) for i, t, _ in edge_rows]
    found = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), slots_log2=18).collect()
    counts = Counter()
    for i, t in rows:
        if i is not None and remainder(i) != 1:
            counts.update((t or "").encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        tokens = (t or "").encode().lower().split() + [b""]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[i, i is None or remainder(i) == 1, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == want
    held = [r for r in found if r.held_out and r.doc_id is not None and 10 <= r.doc_id]
    assert all(r.score < 0 for r in found)
    # Far better than one plain byte after another, and no worse than the counts of known words.
    assert sum(r.bits_per_byte * r.n_bytes for r in held) < 3 * sum(r.n_bytes for r in held)
    assert lm_scoring.score_texts(no_docs, slots_log2=18).count() == 0


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    found = lm_scoring.score_texts(docs, slots_log2=18).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and r.held_out and r.score < 0 for r in found)


def benchmark_rows():
    random.seed(12)
    vocabulary = ["the", "of", "and", "to"] * 20 + [f"term{i}" for i in range(400)]
    return [(i, " ".join(random.choices(vocabulary, k=random.randint(15, 70))) + "?\n" +
             " ".join(random.choices(vocabulary, k=8)) + ".") for i in range(60)], vocabulary


def test_search_equals_scoring_every_chunk(spark):
    rows, vocabulary = benchmark_rows()
    index = decontamination.build_indexes(spark.createDataFrame(rows, "item_id long, text string"))[0]
    random.seed(13)
    for share in (0.6, 0.25):
        index.thresholds *= share / 0.6
        index.left = index.thresholds - np.array([sum(c.values()) for c in index.common])
        index.rare_floor = float(index.left.min())
        for number in range(200):
            words = random.choices(vocabulary, k=150) + decontamination.terms_of(rows[number % 60][1])[: number % 40]
            query = {index.terms[w] for w in (x if isinstance(x, bytes) else x.encode() for x in words) if w in index.terms}
            scores = np.zeros(len(index.ids))
            for t in query:
                for chunk, impact in index.postings[t]:
                    scores[chunk] += impact
            want = {int(c): scores[c] for c in np.flatnonzero(scores >= index.thresholds + 1e-9)}
            found = dict(index.search(query))
            assert want.keys() <= found.keys()
            assert all(found[c] == pytest.approx(scores[c]) for c in found)


def test_leaks_are_found_and_clean_documents_stay(spark):
    rows, vocabulary = benchmark_rows()
    random.seed(14)
    docs, want = [], set()
    for i in range(120):
        words = random.choices(vocabulary, k=random.randint(5, 900))
        if i % 3 == 0:
            item = rows[i % 60]
            cut = random.randrange(len(words))
            words[cut:cut] = item[1].upper().split() if i % 2 else [item[1].replace(" ", " ## ")]
            want.add((i, item[0]))
        docs.append((i, " ".join(words), i))
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([*rows, (900, None), (901, ""), rows[0]], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, bench).collect()} == want
    split = decontamination.find_leaks(frame, bench, block_chars=4000)
    assert {(r.doc_id, r.item_id) for r in split.collect()} == want
    kept = decontamination.without_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in docs} - {i for i, _ in want}


def test_decontamination_at_the_edges(spark, edge_docs, edge_rows, no_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six"), (2, "ü")], "item_id long, text string")
    assert decontamination.find_leaks(edge_docs, nothing).count() == 0
    assert decontamination.without_leaks(edge_docs, nothing).count() == len(edge_rows)
    found = Counter((r.doc_id, r.item_id) for r in decontamination.find_leaks(edge_docs, some).collect())
    assert found == Counter({(1, 1): 2, (6, 1): 1})
    assert decontamination.find_leaks(no_docs, some).count() == 0


def test_pipeline_stages(spark, edge_docs, no_docs):
    folder = SMALL
    if not os.path.isdir(folder):
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames, current = [docs], docs
    for _, stage in corpus_pipeline.STAGES:
        current = corpus_pipeline.stored(stage(spark, current, folder))
        frames.append(current)
    counts = [f.count() for f in frames]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5] > 0
    assert all(f.columns == docs.columns for f in frames[:5])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in frames[1].select("doc_id").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge_docs, folder).count() > 0
        assert stage(spark, no_docs, folder).count() == 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    from checks.compare import compare, duck

    if not os.path.isdir(SMALL):
        pytest.skip("driver tables are not here")
    assert compare(spark, duck(SMALL), SMALL, name, QUERIES[name], ORACLES.get(name)) == ""


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
