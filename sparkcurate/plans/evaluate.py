"""Score answer tables against gold cases and compare runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.operators import kpi, rubric
from sparkcurate.operators.rules import RuleBook, judge_answers, score_samples
from sparkcurate.session import cut_lineage
from sparkcurate.sources import writers


def fact_table(gold: DataFrame, answers: DataFrame, book: RuleBook) -> DataFrame:
    """Per-answer rows of every run. ``gold``: id, slice, complaint, gold_rc; ``answers``: run, id,
    answer. Joined on the id, never by position."""
    cases = answers.select("run", "id", "answer").join(gold, "id")
    judged = judge_answers(cases, book)
    scored = score_samples(judged.withColumn("id", F.struct("run", "id")), book)
    return scored.select(F.col("id.run").alias("run"), F.col("id.id").alias("id"),
                         *[c for c in scored.columns if c != "id"])


def run_reports(facts: DataFrame, book: RuleBook) -> DataFrame:
    """One KPI row per run."""
    return kpi.kpi_report(facts, book.labels, book.abstain, ("run",))


def compare_runs(facts: DataFrame, book: RuleBook) -> DataFrame:
    """The leaderboard over all runs of a fact table; no report file is read again."""
    return kpi.leaderboard(run_reports(facts, book))


def write_run(facts: DataFrame, book: RuleBook, out_dir: str) -> None:
    """Metric, slice, confusion and per-answer tables plus one JSON report line per run; answers are judged once."""
    root, facts = out_dir.rstrip("/"), cut_lineage(facts)
    reports = run_reports(facts, book)
    slices = kpi.slice_accuracy(facts, ("run", "slice"))
    matrix = kpi.confusion_matrix(facts, book.labels, book.abstain, ("run",))
    metrics = kpi.verdicts(kpi.long_metrics(reports, ("run",)))
    writers.write_csv(metrics, f"{root}/metrics")
    writers.write_csv(slices, f"{root}/slices")
    writers.write_csv(matrix, f"{root}/confusion")
    writers.write_fact_csv(facts, f"{root}/per_sample")
    writers.write_csv(kpi.leaderboard(reports), f"{root}/leaderboard")
    writers.write_jsonl(writers.report_payload(reports, slices, matrix), f"{root}/report")
    writers.append_traces(facts, f"{root}/traces")


def add_batch(facts: DataFrame, book: RuleBook, root: str, batch: str) -> bool:
    """Store a batch of facts and what its reports need; False if it was stored before with the same rows.

    Judges the batch once and reads no other. Folders named by the batch are replaced, the manifest last, and
    its digest ties the parts together: a replay, also after a crash, leaves one copy.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    facts = cut_lineage(facts)
    spark, top = facts.sparkSession, root.rstrip("/")
    rows = F.xxhash64(*facts.columns).cast("decimal(38,0)")
    now = facts.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(rows), F.lit(0)).cast("string").alias("digest")).first()
    known = _manifest(spark, top)
    if known is not None and not known.where(
            (F.col("batch") == batch) & (F.col("digest") == now["digest"]) & (F.col("rows") == now["rows"])).isEmpty():
        return False
    stamp = F.lit(now["digest"]).alias("digest")
    facts.write.mode("overwrite").parquet(f"{top}/traces/batch={batch}")
    partials = kpi.kpi_partials(facts, book.labels, book.abstain, ("run", "slice"))
    partials.select("*", stamp).write.mode("overwrite").parquet(f"{top}/partials/batch={batch}")
    spark.range(1).select(F.lit(batch).alias("name"), F.lit(now["rows"]).alias("rows"), stamp).write.mode(
        "overwrite").parquet(f"{top}/manifest/batch={batch}")
    return True


def _manifest(spark: SparkSession, top: str) -> DataFrame | None:
    """(batch, rows, digest) of the stored batches."""
    try:
        return spark.read.parquet(f"{top}/manifest").select(F.col("name").alias("batch"), "rows", "digest")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def stored_reports(spark: SparkSession, root: str, by: Sequence[str] = ("run",)) -> DataFrame:
    """KPI reports of all stored batches, per run or per run and slice, from their partials; no fact is read."""
    top = root.rstrip("/")
    known = _manifest(spark, top)
    if known is None:
        raise ValueError(f"no batch is stored under {root}")
    partials = spark.read.parquet(f"{top}/partials").withColumn("batch", F.col("batch").cast("string"))
    whole = partials.join(known.select(F.col("batch").alias("b"), F.col("digest").alias("d")),
                          (F.col("batch") == F.col("b")) & (F.col("digest") == F.col("d")), "left_semi")
    return kpi.report_of_partials(whole, by)


def rubric_run(scores: DataFrame, votes: DataFrame) -> dict[str, DataFrame]:
    """Tables of a rubric evaluation: summary per mode, criteria, disagreement, win rates.

    ``scores``: sample_id, mode, judge, criterion, score; ``votes``: id, mode, judge, vote.
    """
    criteria = list(rubric.WEIGHTS)
    summary = rubric.summarise_by_mode(rubric.case_scores(scores, criteria))
    return {
        "per_mode": rubric.rounded(summary),
        "criteria": rubric.criterion_means(summary),
        "disagreement": rubric.mean_spread(rubric.judge_spread(scores)),
        "win_rates": rubric.percent_table(
            rubric.win_rates(rubric.majority(votes, ("id", "mode")))),
    }
