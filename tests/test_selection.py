"""Values at ranks and hold-out cuts by rounds; quantile sketches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcurate.operators import order, sketches
from sparkcurate.operators.split import stratified_holdout

SHAPES = {
    "uniform": lambda rng: rng.random(),
    "skewed": lambda rng: math.exp(30 * rng.random() ** 3),
    "constant": lambda rng: 7.0,
    "heavy": lambda rng: 3.0 if rng.random() < 0.7 else rng.random() * 10,
    "few": lambda rng: float(rng.randrange(3)),
    "signed": lambda rng: rng.choice([-0.0, 0.0, -1e300, 1e300, 1e-300, rng.gauss(0, 1)]),
}


@pytest.mark.parametrize("bound", [3, 40, 100_000])
def test_percentiles_by_rounds_are_exact(spark, bound):
    rng = random.Random(1)
    data = {name: [draw(rng) for _ in range(700)] for name, draw in SHAPES.items()} | {None: [1.0, 2.0], "one": [5.0]}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("one", None), ("no value", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5).cache()
    fractions = (0.0, 0.01, 0.5, 0.95, 0.999, 1.0)
    got = {r.g: r for r in order.exact_percentiles(frame, "v", fractions, ("g",), bound=bound).collect()}
    assert set(got) == set(data)
    for name, values in data.items():
        want = np.percentile(values, [100 * f for f in fractions])
        assert got[name].n == len(values)
        assert [got[name][f"p{i}"] for i in range(6)] == pytest.approx(list(want), rel=1e-9), name
    whole = order.exact_percentiles(frame, "v", fractions, bound=bound).first()
    every = [v for vs in data.values() for v in vs]
    assert [whole[f"p{i}"] for i in range(6)] == pytest.approx(list(np.percentile(every, [100 * f for f in fractions])), rel=1e-9)


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert order.exact_percentiles(none, "v", (0.5,), ("g",)).count() == 0
    assert order.exact_percentiles(none, "v", (0.5,)).count() == 0


def test_no_task_sorts_more_than_the_bound(spark, monkeypatch):
    seen = []
    plain = order._values_by_sort

    def watched(rows, ranks, group):
        most = rows.groupBy(*group, "v").count().groupBy(*group).count().agg(F.max("count")).first()[0]
        seen.append(most or 0)
        return plain(rows, ranks, group)

    monkeypatch.setattr(order, "_values_by_sort", watched)
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_013).cast("double").alias("v"))
    found = order.exact_percentiles(rows, "v", (0.5, 0.9), bound=50).first()
    want = sorted(i * 7919 % 60_013 for i in range(60_000))
    assert found.p0 == np.percentile(want, 50) and found.p1 == pytest.approx(np.percentile(want, 90))
    assert max(seen) <= 50 and len(seen) > 1


@pytest.mark.parametrize("bound", [1, 20, 100_000])
def test_cuts_by_digit_levels_equal_the_sort(spark, bound):
    rng = random.Random(2)
    ids = {s: [rng.randrange(10**9) for _ in range(300)] for s in "ab"} | {"copies": [5] * 400 + [6, 7, 8], "one": [1]}
    rows = [(s, f"{hash((s, i)) & 0xFFFFF:05x}{i:011x}", i) for s, some in ids.items() for i in some]
    takes = {"a": 120, "b": 1, "copies": 200, "one": 1}
    keys = spark.createDataFrame(rows, "stratum string, h string, id long")
    quotas = spark.createDataFrame(list(takes.items()), "stratum string, take long")
    got = {r.stratum: (r.cut_h, r.cut_id) for r in order.smallest_key_cut(keys, quotas, bound).collect()}
    assert got == {s: sorted((h, i) for t, h, i in rows if t == s)[n - 1] for s, n in takes.items()}
    assert order.smallest_key_cut(keys, quotas.withColumn("take", F.lit(0)), bound).count() == 0


def test_holdout_is_the_same_at_any_bound(spark, monkeypatch):
    frame = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END AS s")
    one = {r.id for r in stratified_holdout(frame, "s", "id", 0.2, 10, 1).where("split = 'val'").collect()}
    plain = order.smallest_key_cut
    monkeypatch.setattr("sparkcurate.operators.split.smallest_key_cut", lambda k, q: plain(k, q, 2))
    assert {r.id for r in stratified_holdout(frame, "s", "id", 0.2, 10, 1).where("split = 'val'").collect()} == one


def test_merged_sketches_keep_the_error_bound(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{i % 2}", f"d{i % 5}", math.exp(rng.gauss(0, 2))) for i in range(40_000)] + [("r0", "d0", None), ("r9", "d0", float("nan"))]
    frame = spark.createDataFrame(rows, "run string, day string, v double")
    k, fractions = 200, (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)
    path = str(tmp_path / "sketches")
    made = sketches.quantile_sketches(frame, "v", ("run", "day"), k)
    sketches.store_sketches(made.where("day < 'd3'"), path, ("run", "day"))
    for _ in range(2):  # the second time is a replay
        sketches.store_sketches(made.where("day >= 'd3'"), path, ("run", "day"))
    merged = sketches.merged_sketches(spark.read.parquet(path), ("run",), k)
    for r in sketches.sketched_percentiles(merged, fractions, ("run",)).collect():
        values = np.sort([v for run, _, v in rows if run == r.run and v is not None and not math.isnan(v)])
        assert r.n == len(values) and r["mean"] == pytest.approx(values.mean())
        assert (r.p0, r.p5) == (values[0], values[-1]) == (r.low, r.high)
        for i, f in enumerate(fractions[1:5], 1):
            assert r[f"p{i}"] in values
            assert abs(np.searchsorted(values, r[f"p{i}"]) / len(values) - f) <= 1.5 * sketches.rank_error(k) + 1e-4
    assert merged.count() == 2


def test_small_sketches_are_exact(spark):
    frame = spark.range(100).selectExpr("id % 2 AS g", "CAST(id * id AS double) AS v")
    made = sketches.quantile_sketches(frame, "v", ("g",))
    got = {r.g: r.p0 for r in sketches.sketched_percentiles(made, (0.5,), ("g",)).collect()}
    assert got == {g: sorted(i * i for i in range(100) if i % 2 == g)[24] for g in (0, 1)}
