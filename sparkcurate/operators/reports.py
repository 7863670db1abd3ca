"""Reports of two shapes, KPI and rubric, as VARIANT values: one table, one leaderboard, one mode matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.operators.kpi import METRICS


def _number(path: str) -> Column:
    return F.coalesce(F.try_variant_get("report", path, "double"), F.lit(0.0))


def report_kind(report: str = "report") -> Column:
    """``rubric`` for a report with an overall summary, ``kpi`` for one with a KPI metric, else NULL."""
    metric = F.lit(False)
    for name in METRICS:
        metric = metric | F.try_variant_get(report, f"$.{name}", "variant").isNotNull()
    return F.when(F.try_variant_get(report, "$.overall", "variant").isNotNull(), "rubric").when(metric, "kpi")


def report_rows(reports: DataFrame) -> DataFrame:
    """(run, kind, model, n, score_10, no_fabrication, win) of reports (run, report) of either shape.

    The score is the overall rubric average, or the clear accuracy on the same ten scale. Numbers that
    are missing or of a wrong type are 0, ``model`` is then ``?``, and ``win`` is NULL without a pairwise part.
    """
    rows = reports.withColumn("kind", report_kind())
    rubric = F.col("kind") == "rubric"
    return rows.select(
        "run", "kind", F.coalesce(F.try_variant_get("report", "$.extras.model", "string"), F.lit("?")).alias("model"),
        F.when(rubric, _number("$.overall.n")).otherwise(_number("$.n")).cast("long").alias("n"),
        F.when(rubric, _number("$.overall.weighted_avg_10")).otherwise(_number("$.rc_accuracy_clear") * 10).alias("score_10"),
        F.when(~rubric, _number("$.no_fabrication_rate")).alias("no_fabrication"),
        F.try_variant_get("report", "$.extras.pairwise_vs_reference.win", "double").alias("win"),
    )


def joint_leaderboard(reports: DataFrame) -> DataFrame:
    """Runs of both kinds by score, then no-fabrication rate, ties by name; reports of no known kind are left out.

    One row per finished run comes in, so the global order is over a handful of rows.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(
        F.col("score_10").desc(), F.coalesce("no_fabrication", F.lit(0.0)).desc(), F.col("run"))
    return report_rows(reports).where(F.col("kind").isNotNull()).withColumn("rank", F.row_number().over(order))


def mode_scores(reports: DataFrame) -> DataFrame:
    """(run, mode, n, score_10): the modes of every rubric report."""
    modes = F.try_variant_get("report", "$.per_mode", "map<string, variant>")
    rows = reports.select("run", F.explode(modes).alias("mode", "summary"))
    return rows.select("run", "mode", F.coalesce(F.try_variant_get("summary", "$.n", "long"), F.lit(0)).alias("n"),
                       F.coalesce(F.try_variant_get("summary", "$.weighted_avg_10", "double"), F.lit(0.0)).alias("score_10"))


def rubric_payload(summary: DataFrame, by: str = "run") -> DataFrame:
    """(run, overall, per_mode): report rows from rounded summaries per run and mode (``overall`` among them)."""
    criteria = [c for c in summary.columns if c not in (by, "mode", "n", "score_5", "score_10")]
    body = F.struct("n", F.col("score_5").alias("weighted_avg_5"), F.col("score_10").alias("weighted_avg_10"),
                    F.struct(*criteria).alias("per_criterion_mean"))
    total = F.col("mode") == "overall"
    return summary.groupBy(by).agg(
        F.max(F.when(total, body)).alias("overall"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~total, F.struct("mode", body.alias("s")))))).alias("per_mode"))
