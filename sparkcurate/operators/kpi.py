"""Evaluation aggregates over the per-answer fact table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions.numbers import rate, rate_within
from sparkcurate.schemas import PARSE_FAIL

# Fixed values. Targets of the report: metric, comparison, target.
TARGETS = (
    ("rc_accuracy_clear", ">=", 0.85),
    ("cue_faithfulness", ">=", 0.95),
    ("no_fabrication_rate", ">=", 0.98),
    ("runbook_completeness", ">=", 0.95),
    ("abstention_hallucination", "<", 0.10),
    ("artifact_valid_at_1", ">=", 0.90),
)

# Fixed values. The metrics of a KPI report in report order.
METRICS = (
    "rc_accuracy", "rc_accuracy_clear", "cue_faithfulness", "no_fabrication_rate",
    "runbook_completeness", "runbook_fidelity", "artifact_valid_at_1",
    "self_service_present_rate", "abstention_hallucination", "ece", "overconfident_wrong_rate",
    "parse_fail_rate",
)


def calibration_error(bins: int = 10) -> Column:
    """Expected calibration error as one aggregate expression.

    A bin contributes ``|sum(confidence - correct)| / N``, so the bins are plain conditional sums
    and the metric needs neither a second pass nor a second shuffle.
    """
    conf = F.col("confidence")
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(conf * bins)))
    gap = conf - F.col("correct").cast("double")
    total = F.lit(0.0)
    for i in range(bins):
        total = total + F.abs(F.coalesce(F.sum(F.when(slot == i, gap)), F.lit(0.0)))
    return F.coalesce(F.try_divide(total, F.count(conf)), F.lit(0.0))


def kpi_columns(labels: Sequence[str], abstain: str) -> list[Column]:
    """The aggregate expressions of the report; denominators differ per metric.

    Concrete labels only for the clear accuracy (by gold) and the runbook rates (by prediction),
    gold abstentions for hallucination, all rows for the rest. An empty subset gives 0.
    """
    clear = F.col("gold_rc").isin(*labels)
    predicted = F.col("pred_rc").isin(*labels)
    wrong = ~F.col("correct")
    return [
        F.count(F.lit(1)).alias("n"),
        rate(F.col("correct")).alias("rc_accuracy"),
        rate_within(F.col("correct"), clear).alias("rc_accuracy_clear"),
        F.coalesce(F.avg("cue_grounded_frac"), F.lit(0.0)).alias("cue_faithfulness"),
        rate(F.col("no_fabricated_telemetry")).alias("no_fabrication_rate"),
        rate_within(F.col("runbook_complete"), predicted).alias("runbook_completeness"),
        rate_within(F.col("runbook_fidelity"), predicted).alias("runbook_fidelity"),
        rate(F.col("artifacts_valid")).alias("artifact_valid_at_1"),
        rate(F.col("self_service_ok")).alias("self_service_present_rate"),
        rate_within(F.col("pred_rc") != abstain, F.col("gold_rc") == abstain)
        .alias("abstention_hallucination"),
        calibration_error().alias("ece"),
        rate((F.col("confidence") > 0.85) & wrong).alias("overconfident_wrong_rate"),
        rate(F.col("pred_rc") == PARSE_FAIL).alias("parse_fail_rate"),
    ]


def kpi_report(samples: DataFrame, labels: Sequence[str], abstain: str,
               by: Sequence[str] = ()) -> DataFrame:
    """The report row, or one per group; always a single partial aggregation."""
    return samples.groupBy(*by).agg(*kpi_columns(labels, abstain))


def _rates(labels: Sequence[str], abstain: str) -> dict[str, tuple[Column, Column]]:
    """Value and subset of every mean of the report."""
    every = F.lit(True)
    clear, predicted, unsure = F.col("gold_rc").isin(*labels), F.col("pred_rc").isin(*labels), F.col("gold_rc") == abstain
    grounded = F.col("cue_grounded_frac")

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    return {
        "rc_accuracy": (flag(F.col("correct")), every), "rc_accuracy_clear": (flag(F.col("correct")), clear),
        "cue_faithfulness": (grounded, grounded.isNotNull()),
        "no_fabrication_rate": (flag(F.col("no_fabricated_telemetry")), every),
        "runbook_completeness": (flag(F.col("runbook_complete")), predicted),
        "runbook_fidelity": (flag(F.col("runbook_fidelity")), predicted),
        "artifact_valid_at_1": (flag(F.col("artifacts_valid")), every),
        "self_service_present_rate": (flag(F.col("self_service_ok")), every),
        "abstention_hallucination": (flag(F.col("pred_rc") != abstain), unsure),
        "overconfident_wrong_rate": (flag((F.col("confidence") > 0.85) & ~F.col("correct")), every),
        "parse_fail_rate": (flag(F.col("pred_rc") == PARSE_FAIL), every),
    }


def kpi_partials(samples: DataFrame, labels: Sequence[str], abstain: str, by: Sequence[str],
                 bins: int = 10) -> DataFrame:
    """(by, n, sums, counts, gaps, confident): what the report's means are made of; partials of
    disjoint rows add up."""
    rates = _rates(labels, abstain)
    conf = F.col("confidence")
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(conf * bins)))
    gap = conf - F.col("correct").cast("double")
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.coalesce(F.sum(F.when(subset, value)), F.lit(0.0)) for value, subset in rates.values()]).alias("sums"),
        F.array(*[F.count_if(subset) for _, subset in rates.values()]).alias("counts"),
        F.array(*[F.coalesce(F.sum(F.when(slot == i, gap)), F.lit(0.0)) for i in range(bins)]).alias("gaps"),
        F.count(conf).alias("confident"))


def report_of_partials(partials: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """The report of :func:`kpi_report` from partials."""
    names = list(_rates((), ""))
    added = partials.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("confident").alias("confident"),
        *[F.sum(F.get("sums", F.lit(i))).alias(f"_s{i}") for i in range(len(names))],
        *[F.sum(F.get("counts", F.lit(i))).alias(f"_c{i}") for i in range(len(names))],
        *[F.abs(F.sum(F.get("gaps", F.lit(i)))).alias(f"_g{i}") for i in range(bins)])
    means = {name: F.coalesce(F.try_divide(F.col(f"_s{i}"), F.col(f"_c{i}")), F.lit(0.0)) for i, name in enumerate(names)}
    total = F.lit(0.0)
    for i in range(bins):
        total = total + F.col(f"_g{i}")
    means["ece"] = F.coalesce(F.try_divide(total, F.col("confident")), F.lit(0.0))
    return added.select(*by, "n", *[means[name].alias(name) for name in METRICS])


def long_metrics(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(…, metric, value) rows of a report."""
    return report.unpivot(list(by), list(METRICS), "metric", "value")


def verdicts(metrics: DataFrame,
             targets: Sequence[tuple[str, str, float]] = TARGETS) -> DataFrame:
    """Add ``op``, ``target`` and PASS/FAIL (NULL without a target) to long metrics."""
    spark = metrics.sparkSession
    table = spark.createDataFrame(list(targets), "metric STRING, op STRING, target DOUBLE")
    passed = F.when(F.col("op") == ">=", F.col("value") >= F.col("target")).otherwise(
        F.col("value") < F.col("target")
    )
    verdict = F.when(F.col("target").isNotNull(), F.when(passed, "PASS").otherwise("FAIL"))
    return metrics.join(table, "metric", "left").withColumn("verdict", verdict)


def confusion_matrix(samples: DataFrame, labels: Sequence[str], abstain: str,
                     by: Sequence[str] = ()) -> DataFrame:
    """(gold, pred, n) for known golds; known predictions are zero-filled, others kept as they are.

    The grid of known pairs is a literal unioned as zero counts, so filling costs no join.
    """
    known = [*labels, abstain]
    counted = samples.where(F.col("gold_rc").isin(*known)).groupBy(
        *by, F.col("gold_rc").alias("gold"), F.col("pred_rc").alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"))
    pairs = [(g, p) for g in known for p in (*known, PARSE_FAIL)]
    if by:
        grid = F.explode(F.array(*[
            F.struct(F.lit(g).alias("gold"), F.lit(p).alias("pred")) for g, p in pairs
        ]))
        zeros = counted.select(*by).distinct().select(*by, grid.alias("c")).select(
            *by, "c.gold", "c.pred", F.lit(0).cast("long").alias("n")
        )
    else:
        zeros = samples.sparkSession.createDataFrame(
            [(g, p, 0) for g, p in pairs], "gold STRING, pred STRING, n BIGINT"
        )
    return (
        counted.unionByName(zeros).groupBy(*by, "gold", "pred").agg(F.sum("n").alias("n"))
    )


def confusion_wide(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Display form: one row per gold, the given predictions as columns."""
    wide = matrix.groupBy("gold").pivot("pred", list(columns)).agg(F.sum("n"))
    return wide.na.fill(0, list(columns))


def slice_accuracy(samples: DataFrame, by: Sequence[str] = ("slice",)) -> DataFrame:
    """Rows and accuracy per slice."""
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("correct")).alias("accuracy")
    )


def weakest(scores: DataFrame, key: str, score: str, k: int = 3) -> DataFrame:
    """The k lowest-scoring groups, ties by name."""
    return scores.orderBy(F.col(score), F.col(key)).limit(k)


def leaderboard(reports: DataFrame) -> DataFrame:
    """Runs ranked by clear accuracy, then no-fabrication rate; NULL counts as 0, ties by name.

    One row per run comes in, so the global order is over the handful of finished runs.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(
        F.coalesce(F.col("rc_accuracy_clear"), F.lit(0.0)).desc(),
        F.coalesce(F.col("no_fabrication_rate"), F.lit(0.0)).desc(),
        F.col("run"),
    )
    return reports.withColumn("rank", F.row_number().over(order))


def first_mistakes(samples: DataFrame, text: str, order: str = "id", k: int = 8,
                   texts: DataFrame | None = None) -> DataFrame:
    """The first k wrong predictions in a stated order, with a 120-character excerpt.

    ``texts`` (``order`` and ``text``) are joined after the k rows are chosen, so no other text moves.
    """
    top = samples.where(~F.col("correct")).orderBy(order).limit(k)
    if texts is not None:  # k rows
        top = texts.join(F.broadcast(top), order)
    position = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order, "gold_rc", "pred_rc", text))
    return top.select(
        position.alias("pos"), order, F.col("gold_rc"), F.col("pred_rc"),
        F.substring(F.col(text), 1, 120).alias("excerpt"),
    ).where(F.col("pos") <= k)  # repeated ids match more texts


def previous_delta(scores: DataFrame, run: str, mode: str, score: str, current: str) -> DataFrame:
    """Scores of the current run with the difference to the latest earlier run that exists.

    The earlier run is found with one aggregate over run names; modes it lacks get NULL.
    """
    before = scores.where(F.col(run) < current).agg(F.max(run).alias("_prev"))
    old = scores.join(before, F.col(run) == F.col("_prev")).select(
        mode, F.col(score).alias("previous"), F.col(run).alias("previous_run")
    )
    return (
        scores.where(F.col(run) == current).join(old, mode, "left")
        .withColumn("delta", F.col(score) - F.col("previous"))
    )


def label_accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals the gold label."""
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("pred_rc") == F.col("gold_rc")).alias("accuracy")
    )


def literal_map(values: Mapping[str, str]) -> Column:
    """A constant map column from a small parameter dictionary."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
