"""KPI reports, confusion, calibration, ranking, mistakes, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import (
    KPI_SQL,
    LABELS,
    SAMPLES,
    UNSURE,
    ece_cte,
    query,
    round6,
    samples,
)
from sparkcurate.operators import kpi

TARGET_VALUES = ", ".join(f"('{m}', '{o}', {t}::DOUBLE)" for m, o, t in kpi.TARGETS)
METRIC_LIST = ", ".join(kpi.METRICS)

RUN_REPORT = f"""
{SAMPLES}, {ece_cte("run")},
report AS (
  SELECT run, ece.ece, r.* EXCLUDE (run) FROM (
    SELECT run, {KPI_SQL} FROM samples GROUP BY run) r LEFT JOIN ece USING (run))
"""


@query(f"WITH {RUN_REPORT} SELECT run, n, {METRIC_LIST} FROM report")
def kpi_report(spark: SparkSession, sf: str) -> DataFrame:
    """AG4, AG7, FI3, FI4, JO1: the KPI row of every run from one aggregation."""
    return round6(kpi.kpi_report(samples(spark, sf), LABELS, UNSURE, ("run",)))


@query(f"""
WITH {RUN_REPORT},
long AS (UNPIVOT (SELECT run, {METRIC_LIST} FROM report) ON {METRIC_LIST}
         INTO NAME metric VALUE value),
targets(metric, op, target) AS (VALUES {TARGET_VALUES})
SELECT l.run, l.metric, l.value, t.op, t.target,
       CASE WHEN t.target IS NULL THEN NULL
            WHEN (t.op = '>=' AND l.value >= t.target) OR (t.op = '<' AND l.value < t.target)
            THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM long l LEFT JOIN targets t USING (metric)""")
def kpi_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """PR16: metric rows against their targets."""
    report = round6(kpi.kpi_report(samples(spark, sf), LABELS, UNSURE, ("run",)))
    return kpi.verdicts(kpi.long_metrics(report, ("run",)))


@query(f"""
WITH {SAMPLES},
golds(gold) AS (VALUES ('good'), ('bad'), ('unsure')),
preds(pred) AS (VALUES ('good'), ('bad'), ('unsure'), ('PARSE_FAIL')),
counted AS (SELECT gold_rc AS gold, pred_rc AS pred, count(*) AS n FROM samples GROUP BY ALL)
SELECT gold, pred, coalesce(n, 0) AS n FROM (SELECT * FROM golds CROSS JOIN preds) g
FULL JOIN counted c USING (gold, pred)""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """AG5, SO5: every gold/prediction pair, known ones zero-filled."""
    return kpi.confusion_matrix(samples(spark, sf), LABELS, UNSURE)


@query(f"""
WITH {SAMPLES}
SELECT gold_rc AS gold, count(*) FILTER (WHERE pred_rc = 'good') AS good,
       count(*) FILTER (WHERE pred_rc = 'bad') AS bad,
       count(*) FILTER (WHERE pred_rc = 'other') AS other
FROM samples GROUP BY gold_rc""")
def confusion_wide(spark: SparkSession, sf: str) -> DataFrame:
    """AG5: the display form."""
    matrix = kpi.confusion_matrix(samples(spark, sf), LABELS, UNSURE)
    return kpi.confusion_wide(matrix, ("good", "bad", "other"))


ACCURACY = "round(avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END), 6)"


@query(f"WITH {SAMPLES} SELECT slice, count(*) AS n, {ACCURACY} AS accuracy FROM samples GROUP BY slice")
def slice_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """AG6: accuracy per slice."""
    return round6(kpi.slice_accuracy(samples(spark, sf)))


@query(f"""
WITH {SAMPLES}, s AS (SELECT slice, count(*) AS n, {ACCURACY} AS accuracy FROM samples GROUP BY slice)
SELECT * FROM s ORDER BY accuracy, slice LIMIT 3""")
def weakest_slices(spark: SparkSession, sf: str) -> DataFrame:
    """TK2: the lowest-scoring slices."""
    return kpi.weakest(round6(kpi.slice_accuracy(samples(spark, sf))), "slice", "accuracy", 3)


@query(f"""
WITH {SAMPLES}, {ece_cte("slice")} SELECT slice, ece FROM ece""")
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    """AG7: expected calibration error per slice."""
    return samples(spark, sf).groupBy("slice").agg(
        F.round(kpi.calibration_error(), 6).alias("ece"))


@query(f"""
WITH {RUN_REPORT}
SELECT run, rc_accuracy_clear, no_fabrication_rate, row_number() OVER (
         ORDER BY rc_accuracy_clear DESC, no_fabrication_rate DESC, run) AS rank
FROM report""")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """WI5: runs by position."""
    report = round6(kpi.kpi_report(samples(spark, sf), LABELS, UNSURE, ("run",)))
    return kpi.leaderboard(report.select("run", "rc_accuracy_clear", "no_fabrication_rate"))


@query(f"""
WITH {SAMPLES},
s AS (SELECT run, slice, {ACCURACY} AS accuracy FROM samples GROUP BY ALL),
cur AS (SELECT max(run) AS r FROM s), prev AS (SELECT max(run) AS r FROM s, cur WHERE run < cur.r)
SELECT a.slice, a.run, a.accuracy, b.accuracy AS previous, b.run AS previous_run,
       round(a.accuracy - b.accuracy, 6) AS delta
FROM s a JOIN cur ON a.run = cur.r
LEFT JOIN (SELECT s.* FROM s JOIN prev ON s.run = prev.r) b ON a.slice = b.slice""")
def baseline_delta(spark: SparkSession, sf: str) -> DataFrame:
    """JO12, WI8: the last run against the latest earlier one, per slice."""
    scores = round6(kpi.slice_accuracy(samples(spark, sf), ("run", "slice"))).drop("n")
    current = scores.agg(F.max("run")).first()[0]
    return round6(kpi.previous_delta(scores, "run", "slice", "accuracy", current))


@query(f"""
WITH {SAMPLES},
wrong AS (SELECT s.id, gold_rc, pred_rc, substring(d.text, 1, 120) AS excerpt
          FROM samples s JOIN documents d ON d.doc_id = s.id WHERE NOT correct
          ORDER BY s.id LIMIT 8)
SELECT row_number() OVER (ORDER BY id) AS pos, id, gold_rc, pred_rc, excerpt FROM wrong""")
def first_mistakes(spark: SparkSession, sf: str) -> DataFrame:
    """WI7: the first eight mistakes with an excerpt."""
    from checks.base import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return kpi.first_mistakes(samples(spark, sf), "text", texts=docs)


@query(f"""
WITH {SAMPLES}
SELECT run, count(*) AS n, {ACCURACY.replace("correct", "gold_rc = pred_rc")} AS accuracy
FROM samples GROUP BY run""")
def label_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """AG23: plain accuracy of predictions."""
    return round6(kpi.label_accuracy(samples(spark, sf), ("run",)))
