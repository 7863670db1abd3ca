import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcurate.llm.periodic import described, op12_periodic_runs, runs_of, surviving_segments, with_repeated_tail, with_runs


def brute_runs(codes):
    """Every maximal stretch at every period, kept if no smaller period has the same stretch."""
    n, seen, out = len(codes), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and codes[j] == codes[j + q]:
                j += 1
            if j > i:
                stretch = (i, j + q - i)
                if stretch[1] >= max(6, 4 * q) and stretch not in seen:
                    seen.add(stretch)
                    out.append((*stretch, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def material(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(80))]
    if kind == 1:
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 8))]
        return [5, 6] * rng.randrange(6) + unit * rng.randrange(1, 9) + [rng.randrange(9) for _ in range(5)]
    if kind == 2:
        words = [rng.randrange(4) for _ in range(6)] * 7
        words[rng.randrange(len(words))] = 9
        return words + words[: rng.randrange(len(words))]
    return [1] * rng.randrange(40) + [2] * rng.randrange(10) + [1, 2] * rng.randrange(10) + [1] * rng.randrange(9)


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        codes = material(rng)
        assert runs_of(np.array(codes, dtype=np.int64)) == brute_runs(codes), codes


def test_unlike_words_of_equal_sums_are_compared_in_full(monkeypatch):
    import sparkcurate.llm.periodic as periodic
    monkeypatch.setattr(periodic, "PRIME", 3)
    monkeypatch.setattr(periodic, "BASE", 2)
    rng = random.Random(4)
    for _ in range(300):
        codes = material(rng)
        assert runs_of(np.array(codes, dtype=np.int64)) == brute_runs(codes), codes


def test_segments_have_no_rare_word_and_hold_every_run():
    rng = random.Random(5)
    for _ in range(300):
        codes = np.array(material(rng), dtype=np.int64)
        segments = surviving_segments(codes)
        for a, b in segments:
            assert np.unique(codes[a:b], return_counts=True)[1].min() >= 4
        for start, length, _ in brute_runs(codes.tolist()):
            assert any(a <= start and start + length <= b for a, b in segments)


@pytest.mark.parametrize("words", [["w"] * 200_000, [f"w{i % 40_000}" for i in range(200_000)],
                                   ["a", "b"] * 30_000 + ["c"] + ["a"] * 30_000])
def test_very_long_texts(words):
    runs, collapsed = described(" ".join(words))
    assert runs
    assert len(collapsed.split()) < len(words)


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    codes = {}
    runs = brute_runs([codes.setdefault(w, len(codes)) for w in words])
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def rows_of(tmp_path, spark, rows):
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{c}" for c in material(rng)), "clash") for i in range(120)]
    rows += [(7, None, None), (8, "", None), (None, "a b " * 5, None), (9, " \t\n", "x"), (10, "é 😀 " * 9, "x"),
             (0, "a b " * 5, None), (0, "a b " * 5, None), (11, "x" * 9000, None)]
    got = rows_of(tmp_path, spark, rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[6], r[7])
    assert sorted(got, key=order) == sorted((expected(i, t) for i, t, _ in rows), key=order)


def test_empty_table_and_edge_rows(spark, edge_docs, no_docs):
    assert with_runs(no_docs, F.col("text")).count() == 0
    rows = with_runs(edge_docs, F.col("text")).select("doc_id", "text", "runs", "collapsed").collect()
    assert len(rows) == edge_docs.count()
    long = next(r for r in rows if r["doc_id"] == 5)
    assert [tuple(r) for r in long["runs"]] == [(0, 32_000, 8)]
    assert long["collapsed"] == "alpha beta gamma delta epsilon zeta eta theta"
    assert next(r for r in rows if r["doc_id"] == 2)["collapsed"] == ""


def test_tail_leaves_other_documents_alone(spark):
    frame = spark.range(200).selectExpr("id AS doc_id", "'a b  c' AS text")
    kept = frame.withColumn("t", with_repeated_tail(F.col("text"), F.col("doc_id"))).where("t = text").count()
    assert kept == sum(zlib.crc32(str(i).encode()) % 10 != 0 for i in range(200))
