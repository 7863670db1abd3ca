import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkcurate.llm import packing
from sparkcurate.llm.packing import Encoder, best_fit, lower_bound, op11_packing, pack_documents, pack_pieces, sequences_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.sampled_from([
    "Don't they'll I'M 'tis", "a<|endoftext|>b", "<|startoftext|>", "É é ́x", "x y z", "12,5 km/h\x0b\x0cq",
    "ΣΊΣΥΦΟΣ İ", "'s's'S 'Re", "\x00 a\x1fb", "中文 한글 하", "__a--b", "<| |>", "Größe Ÿ ß ẞ ŉ ſ × ÷ ÀÉÎ œuvre Žižek i̇ ª µ º ﬁ"])), max_size=6))
def test_cached_ids_are_the_tokenizers(plain, encoder, parts):
    text = " ".join(parts)
    want = np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert encoder.encode([text]) == [want]


def test_split_parts_meet_the_model_alone(plain, encoder, monkeypatch):
    """Parts of any letters take the short way: the whole tokenizer is not asked for them."""
    monkeypatch.setattr(Encoder, "_one_by_one", None)
    words = ["naïve", "größe", "žižek", "n\u0142\u0105ka", "\u00ad".join("ab"), "x", "--", "''", "4", "'s"]
    parts = [w for w in words if packing.PARTS.fullmatch(w)]
    assert len(parts) > 6
    want = [np.array(plain.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes() for p in parts]
    monkeypatch.setattr(encoder, "tokenizer", None)
    assert encoder._of_parts(parts) == want


def test_a_full_cache_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 5)
    small, rng = Encoder(PATH), random.Random(1)
    texts = [" ".join(rng.choice(["one", "Two,", "three's", "naïve", "x" * 90, "4"]) + str(rng.randrange(4))
                      for _ in range(20)) for _ in range(30)] + [None, ""]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert [small.encode([t])[0] for t in texts] == want
    assert small.encode(texts) == want
    assert len(small.parts.young) + len(small.parts.old) < 50


def fewest(lengths, size):
    """Fewest sequences by trying every packing."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best


def test_bound_never_exceeds_the_best_packing():
    rng = random.Random(2)
    met = 0
    for _ in range(400):
        size = rng.choice([10, 12, 20, 31])
        lengths = sorted((rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1))
        best = fewest(lengths, size)
        assert bound <= best, (size, lengths)
        met += bound == best
    assert met > 350
    assert lower_bound(np.bincount([11] * 8, minlength=21)) == 8
    assert lower_bound(np.bincount([7] * 9, minlength=21)) == 5  # k = 2: two of them fill a sequence
    assert lower_bound(np.zeros(11, dtype=np.int64)) == 0


def test_best_fit_against_a_plain_one():
    rng = random.Random(3)
    for _ in range(200):
        lengths = np.array([rng.randrange(1, 21) for _ in range(rng.randrange(1, 60))])
        rooms = []
        for length in sorted(lengths.tolist(), reverse=True):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((fit if fit is not None else 20) - length)
        sequence, offset = best_fit(lengths, 20)
        assert sequence.max() + 1 == len(rooms)
        for number in range(len(rooms)):
            at = np.argsort(offset[sequence == number])
            placed = lengths[sequence == number][at]
            assert offset[sequence == number][at].tolist() == [0, *np.cumsum(placed)[:-1].tolist()]
            assert placed.sum() <= 20


def gapless(rows, size):
    """Checks that each sequence is filled without gaps; returns the number of sequences."""
    rows = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    sequences = 0
    for _, parts in itertools.groupby(rows, key=lambda r: r["sequence_id"]):
        sequences, at = sequences + 1, 0
        for part in parts:
            assert part["offset"] == at
            at += part["length"]
        assert at <= size
    return sequences


@pytest.mark.parametrize("draw", ["uniform", "halves", "small", "thirds", "one"])
def test_exchange_reaches_what_one_packing_needs(spark, monkeypatch, draw):
    monkeypatch.setattr(packing, "PIECES", 512)
    rng = random.Random(4)
    lengths = [{"uniform": rng.randrange(1, 101), "halves": rng.choice([51, 50, 49, 26]), "small": rng.randrange(1, 9),
                "thirds": rng.choice([34, 33, 67]), "one": 60}[draw] for _ in range(5000)]
    frame = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "row long, piece int, length long, part string")
    packed, used, bound = pack_pieces(frame, 100)
    rows = packed.collect()
    assert sorted(r["row"] for r in rows) == list(range(5000))
    assert gapless(rows, 100) == used
    whole = int(best_fit(np.array(lengths), 100)[0].max()) + 1
    assert bound <= used <= 1.005 * whole + 2
    if draw in ("small", "one"):
        assert used == bound


def test_round_trip(spark, tmp_path, plain):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["red", "Blue", "naïve", "3.5", "x"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["word, " * 900, "word, " * 900, None, "", "y" * 5000]
    frame = spark.createDataFrame([(i // 2 if i % 9 else None, t, "clash") for i, t in enumerate(texts)],
                                  "doc_id long, text string, piece string")
    packed, used, bound = pack_documents(frame, PATH, size=64, with_ids=True)
    rows = packed.collect()
    assert gapless(rows, 64) == used >= bound
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    pieces = sorted((i // 2 if i % 9 else -1, k, 64 * k, len(ids[64 * k : 64 * k + 64]),
                     zlib.crc32(np.array(ids[64 * k : 64 * k + 64], dtype="<u4").tobytes()))
                    for i, ids in enumerate(want) for k in range(-(-len(ids) // 64)))
    assert pieces == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                            for r in rows)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in sequences_of(packed).collect()}
    assert len(whole) == used
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def test_query_and_edge_rows(spark, edge_docs, no_docs, tmp_path):
    assert pack_documents(no_docs, PATH)[0].count() == 0
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = op11_packing(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.collect()
    gapless(rows, 2048)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in edge_docs.select("doc_id").collect()}
    assert [(r["piece"], r["length"]) for r in rows if r["doc_id"] == 2] == [(0, 1)]
    assert out.where(F.col("doc_id") == 1).count() == 2
