"""Training logs, run facts and latency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.numbers import report_round
from sparkcurate.operators.order import exact_percentiles

# Fixed values. Keys logged once at the end of a run, not part of the curves.
SUMMARY_KEYS = (
    "train_runtime", "train_samples_per_second", "train_steps_per_second", "train_loss",
    "train_tokens_per_second", "total_flos", "eval_runtime", "eval_samples_per_second",
    "eval_steps_per_second",
)
# Fixed values. Leading columns of the curve table.
CURVE_COLUMNS = (
    "step", "epoch", "loss", "eval_loss", "learning_rate", "grad_norm", "eval_rubric_avg",
)


def merge_log(entries: DataFrame, by: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """(step, key, value) with the last value of each key per step.

    ``entries``: step, key, value (double, NULL for anything that is not a number), pos.
    ``max_by`` combines before the shuffle, so repeated keys cost nothing.
    """
    numeric = entries.where(
        F.col("step").isNotNull() & F.col("value").isNotNull()
        & ~F.col("key").isin("step", *SUMMARY_KEYS)
    )
    return numeric.groupBy(*by, "step", "key").agg(F.max_by("value", pos).alias("value"))


def curve_table(merged: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per step, the given keys as columns: known ones first, the rest by name."""
    ordered = [c for c in CURVE_COLUMNS if c in keys]
    ordered += sorted(k for k in keys if k not in CURVE_COLUMNS)
    return merged.groupBy(*by, "step").pivot("key", ordered).agg(F.first("value"))


def training_summary(merged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Steps, first and last loss, best and last evaluation loss, best rubric value."""
    def of(key: str):
        return F.when(F.col("key") == key, F.col("value"))

    def at(key: str):
        return F.when(F.col("key") == key, F.col("step"))

    per_step = merged.groupBy(*by, "step").agg(
        F.max(of("loss")).alias("loss"), F.max(of("eval_loss")).alias("eval_loss"),
        F.max(of("eval_rubric_avg")).alias("rubric"),
    )
    loss_at = F.when(F.col("loss").isNotNull(), F.col("step"))
    eval_at = F.when(F.col("eval_loss").isNotNull(), F.col("step"))
    return per_step.groupBy(*by).agg(
        F.count(F.lit(1)).alias("steps"), F.max("step").alias("max_step"),
        F.min_by("loss", loss_at).alias("first_loss"), F.max_by("loss", loss_at).alias("last_loss"),
        F.min("eval_loss").alias("best_eval_loss"),
        F.max_by("eval_loss", eval_at).alias("last_eval_loss"),
        F.max("rubric").alias("best_rubric"),
    )


def run_facts(row: DataFrame) -> DataFrame:
    """(fact, value) rows of a one-row-per-run frame."""
    names = row.columns
    return row.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot(
        [], names, "fact", "value"
    )


def latency_summary(durations: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, p50, p95 and mean, rounded to four decimals; zeros without any row."""
    table = exact_percentiles(durations, value, (0.5, 0.95), by)
    out = table.select(
        *by, "n", report_round(F.col("p0")).alias("p50"), report_round(F.col("p1")).alias("p95"),
        report_round(F.col("mean")).alias("mean"),
    )
    if by:
        return out
    zero = out.sparkSession.createDataFrame([(0, 0.0, 0.0, 0.0)], "n LONG, p50 DOUBLE, p95 DOUBLE, mean DOUBLE")
    return out.unionByName(zero).agg(*[F.max(c).alias(c) for c in ("n", "p50", "p95", "mean")])


def median_floor(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median of whole numbers, the mean of the two middle ones rounded down."""
    table = exact_percentiles(df, value, (0.5,), by)
    return table.select(*by, "n", F.floor("p0").cast("long").alias("median"))


def best_log(files: DataFrame) -> DataFrame:
    """One log file per run: the run's own file if there is one, else that of the highest step.

    ``files``: run, path, step (NULL for the run's own file).
    """
    rank = F.struct(F.col("step").isNull().alias("own"), F.coalesce("step", F.lit(-1)), F.col("path"))
    return files.groupBy("run").agg(F.max_by(F.struct("path", "step"), rank).alias("f")).select(
        "run", "f.path", "f.step"
    )
