"""Line numbers of split files; reports of two shapes in one tree."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkcurate.operators import reports as rep
from sparkcurate.sources import readers as R


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_of_split_files(spark, tmp_path, small_splits):
    rng, want = random.Random(3), {}
    for k, end in enumerate(["\n", "", "\n\n\n", "\r\n"]):
        lines = [rng.choice(["", "   ", "\t", '{"id": "é %d"}' % i, "x" * rng.randrange(200), '{"id": 1']) for i in range(300)]
        (tmp_path / f"f{k}.jsonl").write_bytes((("\r\n" if k == 3 else "\n").join(lines) + end).encode())
        want.update({(f"f{k}.jsonl", i): line for i, line in enumerate(lines, 1) if line.strip()})
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "one.jsonl").write_text("a")
    want["one.jsonl", 1] = "a"
    rows = R.read_numbered(spark, str(tmp_path / "*.jsonl"))
    assert spark.read.text(str(tmp_path / "f0.jsonl")).rdd.getNumPartitions() > 20
    got = {(r.file.rsplit("/", 1)[1], r.lineno): r.value for r in rows.collect()}
    assert got == want
    assert R.read_numbered(spark, str(tmp_path / "no" / "*.jsonl"), empty_ok=True).count() == 0


def test_invalid_lines_are_named_by_number(spark, tmp_path, small_splits):
    from tests.test_records import reasoning, sft

    lines = [json.dumps(sft()), "", "{oops", json.dumps(sft(mode="no such mode")), "  ", json.dumps(reasoning()), '{"a":1}{']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    rows = R.invalid_lines(spark, str(tmp_path / "r.jsonl")).orderBy("lineno").collect()
    assert [r.lineno for r in rows] == [3, 4, 7]
    assert all(r.error for r in rows)
    with pytest.raises(Exception, match=r"r\.jsonl:3"):
        R.read_jsonl(spark, str(tmp_path / "r.jsonl"), "id STRING", "fail", numbered=True).collect()
    assert R.read_jsonl(spark, str(tmp_path / "r.jsonl"), "id STRING", "drop", numbered=True).count() == 3


KPI = {"n": 5, "rc_accuracy_clear": 0.75, "no_fabrication_rate": 1.0, "extras": {"model": "m1"}}
RUBRIC = {"overall": {"n": 7, "weighted_avg_10": 8.25}, "per_mode": {"a": {"n": 3, "weighted_avg_10": 9.5}, "b": {}},
          "extras": {"pairwise_vs_reference": {"win": 0.5}}}


def test_both_shapes_in_one_leaderboard(spark, tmp_path):
    bodies = {"kpi1": KPI, "rub1": RUBRIC, "kpi2": {"rc_accuracy_clear": 0.75, "no_fabrication_rate": "none", "n": "x"},
              "tie": {"rc_accuracy_clear": 0.75}, "odd": {"other": 1}, "bare": {"overall": {}}}
    for run, body in bodies.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "report.json").write_text(json.dumps(body, indent=2))
    for run, text in {"list": "[1]", "cut": "{", "none": "null", "empty": ""}.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "report.json").write_text(text)
    (tmp_path / "run=part one%3A1+2").mkdir()  # as a partitioned write names the run ``part one:1+2``
    (tmp_path / "run=part one%3A1+2" / "part-0.json").write_text(json.dumps(RUBRIC) + "\n")
    reports = R.read_report_variants(spark, str(tmp_path))
    assert {r.run for r in reports.select("run").collect()} == {*bodies, "part one:1+2"}
    board = [(r.run, r.kind, r.model, r.n, r.score_10, r.win) for r in rep.joint_leaderboard(reports).orderBy("rank").collect()]
    assert board == [
        ("part one:1+2", "rubric", "?", 7, 8.25, 0.5), ("rub1", "rubric", "?", 7, 8.25, 0.5), ("kpi1", "kpi", "m1", 5, 7.5, None),
        ("kpi2", "kpi", "?", 0, 7.5, None), ("tie", "kpi", "?", 0, 7.5, None), ("bare", "rubric", "?", 0, 0.0, None)]
    modes = sorted((r.run, r["mode"], r.n, r.score_10) for r in rep.mode_scores(reports).collect())
    assert modes == [(run, m, n, s) for run in ("part one:1+2", "rub1") for m, n, s in (("a", 3, 9.5), ("b", 0, 0.0))]
    assert {r.run for r in rep.report_rows(reports).where(F.col("kind").isNull()).collect()} == {"odd"}


def test_no_reports(spark, tmp_path):
    assert rep.joint_leaderboard(R.read_report_variants(spark, str(tmp_path / "nowhere"))).count() == 0


def test_written_rubric_reports_come_back(spark, tmp_path):
    from sparkcurate.sources.writers import write_reports

    rows = [("r 1:+", "overall", 4, 3.5, 6.25, 3.0), ("r 1:+", "x", 4, 3.5, 6.25, 3.0), ("r2", "overall", 0, 0.0, -2.5, 0.0)]
    summary = spark.createDataFrame(rows, "run string, mode string, n long, score_5 double, score_10 double, tone double")
    write_reports(rep.rubric_payload(summary), str(tmp_path / "out"))
    reports = R.read_report_variants(spark, str(tmp_path / "out"))
    assert [(r.run, r.score_10) for r in rep.joint_leaderboard(reports).orderBy("rank").collect()] == [("r 1:+", 6.25), ("r2", -2.5)]
    assert [tuple(r) for r in rep.mode_scores(reports).collect()] == [("r 1:+", "x", 4, 6.25)]
