"""Rejection sampling by rounds; facts stored in batches."""

import pytest
from pyspark.sql import functions as F

from sparkcurate.functions import draw as D
from sparkcurate.operators import generate as G
from sparkcurate.operators import kpi
from sparkcurate.operators.rules import RuleBook, judge_answers
from sparkcurate.plans import evaluate
from sparkcurate.plans.example_domain import BOOK, KIT

SHARES = {"easy": 1.0, "hard": 0.4, "rare": 0.03, "none wanted": 0.5}


def judge(parts=None, seen=None):
    def judged(rows):
        if seen is not None:
            seen.append({r.group: r.n for r in rows.groupBy("group").agg(F.count("*").alias("n")).collect()})
        rows = rows.repartition(parts) if parts else rows
        share = F.try_element_at(F.create_map(*[F.lit(x) for item in SHARES.items() for x in item]), F.col("group"))
        return rows.withColumn("verdict", F.struct((D.uniform(3, F.col("attempt"), "ok") < share).alias("ok")))
    return judged


def test_quotas_are_filled_by_rounds(spark):
    wanted, seen = {"easy": 50, "hard": 200, "rare": 40, "none wanted": 0}, []
    rows = [(r.group, r.attempt, r.seq) for r in G.fill_quotas(spark, wanted, judge(seen=seen)).collect()]
    every = spark.range(40_000).select(F.col("id").alias("attempt"), F.floor(F.col("id") / 4).alias("index"), F.get(
        F.array(*[F.lit(n) for n in wanted]), (F.col("id") % 4).cast("int")).alias("group"))
    accepted = {}
    for r in judge()(every).where("verdict.ok").orderBy("attempt").collect():
        accepted.setdefault(r.group, []).append(r.attempt)
    assert sorted(rows) == sorted((g, a, i) for g, n in wanted.items() for i, a in enumerate(accepted[g][:n]))
    assert len(seen) > 2 and "easy" not in seen[1] and "none wanted" not in seen[0]
    assert sum(r.get("hard", 0) for r in seen) < 900


def test_quotas_do_not_depend_on_partitions(spark):
    wanted = {"hard": 60, "rare": 5}
    one, two = (sorted((r.group, r.attempt, r.seq) for r in G.fill_quotas(spark, wanted, judge(p)).collect()) for p in (1, 7))
    assert one == two


def test_a_kit_that_spoils_six_in_ten_fills_all_quotas(spark):
    def judged(rows):
        cases = G.build_cases(rows.withColumn("label", G.cycled_label(BOOK.labels, F.col("index"))), KIT, 42)
        spoilt = F.when(D.uniform(42, F.col("attempt"), "spoil") < 0.6, "no package").otherwise(F.col("answer"))
        return judge_answers(cases.select("attempt", "group", "complaint", spoilt.alias("answer")), BOOK)

    got = G.fill_quotas(spark, {"a": 70, "b": 30}, judged).groupBy("group").agg(F.count("*").alias("n"), F.max("seq").alias("m"))
    assert {r.group: (r.n, r.m) for r in got.collect()} == {"a": (70, 69), "b": (30, 29)}


def test_groups_that_accept_nothing_are_an_error(spark):
    with pytest.raises(ValueError, match="unknown: 0 of"):
        G.fill_quotas(spark, {"easy": 3, "unknown": 2}, judge(), most=5)
    assert G.fill_quotas(spark, {"easy": 0}, judge()).count() == 0


LABELS, UNSURE = ("good", "bad"), "unsure"
RULES = RuleBook(LABELS, UNSURE, {}, {})


def facts(spark, ids, shift=0):
    rows = [(f"r{i % 3}", str(i), f"s{i % 2}", ["good", "bad", "unsure"][i % 3], ["good", "bad", "unsure", "PARSE_FAIL"][(i + shift) % 4],
             (i + shift) % 4 == i % 3, None if i % 7 == 0 else (i % 10) / 10, (i % 5) / 4, i % 4 > 0, i % 3 > 0, None if i % 6 else True,
             i % 2 == 0, True, ["x"] * (i % 2)) for i in ids]
    return spark.createDataFrame(rows, "run string, id string, slice string, gold_rc string, pred_rc string, correct boolean, "
                                 "confidence double, cue_grounded_frac double, no_fabricated_telemetry boolean, runbook_complete boolean, "
                                 "runbook_fidelity boolean, artifacts_valid boolean, self_service_ok boolean, telemetry_hits array<string>")


def reports(frame):
    return {(r.run, r.slice): [r.n, *[pytest.approx(r[m], abs=1e-12) for m in kpi.METRICS]] for r in frame.collect()}


def test_partials_add_up_to_the_report(spark):
    whole = facts(spark, range(200))
    parts = kpi.kpi_partials(whole.where("id < '3'"), LABELS, UNSURE, ("run", "slice")).unionByName(
        kpi.kpi_partials(whole.where("id >= '3'"), LABELS, UNSURE, ("run", "slice")))
    want = reports(kpi.kpi_report(whole, LABELS, UNSURE, ("run", "slice")))
    assert {k: [r.n, *[r[m] for m in kpi.METRICS]] for r in kpi.report_of_partials(parts, ("run", "slice")).collect()
            for k in [(r.run, r.slice)]} == want


def test_batches_are_stored_once(spark, tmp_path):
    root = str(tmp_path / "facts")
    with pytest.raises(ValueError, match="no batch"):
        evaluate.stored_reports(spark, root)
    one, two, changed = facts(spark, range(100)), facts(spark, range(100, 150)), facts(spark, range(100, 160), 1)
    assert evaluate.add_batch(one, RULES, root, "2024-01-01")
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "facts").rglob("*.parquet")}
    assert not evaluate.add_batch(one.repartition(5), RULES, root, "2024-01-01")
    assert {str(p): p.stat().st_mtime_ns for p in (tmp_path / "facts").rglob("*.parquet")} == before
    assert evaluate.add_batch(two, RULES, root, "2024-01-02")
    assert {str(p): p.stat().st_mtime_ns for p in (tmp_path / "facts").rglob("*.parquet")}.items() >= before.items()

    def stored():
        return {(r.run, r.slice): [r.n, *[r[m] for m in kpi.METRICS]] for r in evaluate.stored_reports(spark, root, ("run", "slice")).collect()}

    assert stored() == reports(kpi.kpi_report(one.unionByName(two), LABELS, UNSURE, ("run", "slice")))
    assert evaluate.add_batch(changed, RULES, root, "2024-01-02")
    assert stored() == reports(kpi.kpi_report(one.unionByName(changed), LABELS, UNSURE, ("run", "slice")))
    # A batch whose manifest was not written, as after a crash, does not count.
    kpi.kpi_partials(two, LABELS, UNSURE, ("run", "slice")).withColumn("digest", F.lit("0")).write.parquet(f"{root}/partials/batch=2024-01-03")
    assert stored() == reports(kpi.kpi_report(one.unionByName(changed), LABELS, UNSURE, ("run", "slice")))
    with pytest.raises(ValueError, match="batch name"):
        evaluate.add_batch(one, RULES, root, "a/b")
    assert {r.run: r.n for r in evaluate.stored_reports(spark, root).collect()} == {
        r.run: r.n for r in kpi.kpi_report(one.unionByName(changed), LABELS, UNSURE, ("run",)).collect()}
