"""Stateful arrivals over several runs from one checkpoint."""

import random
from datetime import datetime, timedelta

import pytest

from sparkcurate.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "u long, ts timestamp, v string"


@pytest.fixture
def runs(spark, tmp_path):
    before = {name: spark.conf.get(name, None) for name in jobs.ROCKSDB}
    for name, setting in jobs.ROCKSDB.items():
        spark.conf.set(name, setting)

    def run(*batches, hours=5):
        for rows in batches:
            made = [(u, START + timedelta(hours=h), v) for u, h, v in rows]
            if made:
                spark.createDataFrame(made, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            kept = jobs.kept_arrivals(stream, ["u"], "ts", timedelta(hours=hours))
            jobs.to_table(kept, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        out = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()
        return sorted((r.u, (r.ts - START).total_seconds() / 3600, r.v) for r in out)

    yield run
    for name, setting in before.items():
        if setting is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, setting)


def test_replays_restarts_and_late_rows(runs):
    assert runs(
        [(1, 0, "a"), (1, 1, "b"), (1, 6, "c"), (2, 3, "d"), (2, 3, "dd")],
        [(1, 6, "replay"), (1, 12, "e"), (2, 3, "replay"), (1, 11, "within")],
        [],
        [(1, 40, "f"), (3, 40, "g")],
        [(3, 50, "h"), (1, 0, "late")],
        [(3, 52, "within"), (1, 20, "late"), (2, 55, "i")],
    ) == [(1, 0, "a"), (1, 6, "c"), (1, 12, "e"), (1, 40, "f"), (2, 3, "d"), (2, 55, "i"), (3, 40, "g"), (3, 50, "h")]


def test_batches_do_not_matter(runs, tmp_path):
    rng = random.Random(5)
    rows = sorted(((rng.randrange(6), rng.randrange(400) / 4, f"v{i}") for i in range(250)), key=lambda r: r[1])
    want = []
    for u in range(6):
        last = None
        for _, h, v in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2])):
            if last is None or h > last + 5:
                want.append((u, h, v))
                last = h
    cuts = [0, 60, 61, 200, 250]
    batches = [rows[a:b] + rng.sample(rows[max(0, a - 8) : a], min(4, a)) for a, b in zip(cuts, cuts[1:])]
    got = runs(*batches)
    assert [r[:2] for r in got] == sorted(r[:2] for r in want)


def test_ids_of_one_bucket_do_not_mix(runs, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    assert runs(
        [(1, 0, "a"), (2, 1, "b"), (1, 2, "c"), (2, 7, "d"), (3, 4, "e")],
        [(3, 8, "within"), (1, 6, "f"), (2, 11, "within")],
    ) == [(1, 0, "a"), (1, 6, "f"), (2, 1, "b"), (2, 7, "d"), (3, 4, "e")]
