"""Registration of queries and shared table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is one."""
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the driver tables. Named columns announce heavy work per row: they are spread."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows.select(*columns)) if columns else rows


LABELS, UNSURE = ("good", "bad"), "unsure"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-answer fact table derived from labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    i, n = F.col("doc_id"), F.col("n_chars").cast("double")
    gold = F.when(F.col("toxic") == 1, UNSURE).when(F.col("quality") == 1, "good").otherwise("bad")
    conf = F.least(F.lit(0.99), n / (n + 2000.0))
    pred = (
        F.when(i % 17 == 0, "other").when(conf < 0.05, "PARSE_FAIL").when(conf >= 0.5, "good")
        .when(conf >= 0.2, "bad").otherwise(UNSURE)
    )
    rows = docs.join(labels, "doc_id").select(
        i.alias("id"), F.col("lang").alias("slice"), F.col("source").alias("run"),
        gold.alias("gold_rc"), pred.alias("pred_rc"), conf.alias("c"), n.alias("chars"), "toxic",
    )
    return rows.select(
        "id", "slice", "run", "gold_rc", "pred_rc", (F.col("gold_rc") == F.col("pred_rc"))
        .alias("correct"), F.when(F.col("pred_rc") != "PARSE_FAIL", F.col("c"))
        .alias("confidence"), F.least(F.lit(1.0), F.col("chars") / 1000.0)
        .alias("cue_grounded_frac"), (F.col("toxic") == 0).alias("no_fabricated_telemetry"),
        (F.col("chars") > 300).alias("runbook_complete"),
        (F.col("id") % 3 != 0).alias("runbook_fidelity"),
        (F.col("chars") > 100).alias("artifacts_valid"), (F.col("id") % 2 == 0)
        .alias("self_service_ok"),
    )


SAMPLES = """
base AS (
  SELECT d.doc_id AS id, d.lang AS slice, d.source AS run, l.toxic, d.n_chars,
         CASE WHEN l.toxic = 1 THEN 'unsure' WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS gold_rc,
         least(0.99::DOUBLE, d.n_chars::DOUBLE / (d.n_chars::DOUBLE + 2000::DOUBLE)) AS c
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
guessed AS (
  SELECT *, CASE WHEN id % 17 = 0 THEN 'other' WHEN c < 0.05 THEN 'PARSE_FAIL'
                 WHEN c >= 0.5 THEN 'good' WHEN c >= 0.2 THEN 'bad' ELSE 'unsure' END AS pred_rc
  FROM base),
samples AS (
  SELECT id, slice, run, gold_rc, pred_rc, gold_rc = pred_rc AS correct,
         CASE WHEN pred_rc <> 'PARSE_FAIL' THEN c END AS confidence,
         least(1.0::DOUBLE, n_chars::DOUBLE / 1000::DOUBLE) AS cue_grounded_frac,
         toxic = 0 AS no_fabricated_telemetry, n_chars > 300 AS runbook_complete,
         id % 3 <> 0 AS runbook_fidelity, n_chars > 100 AS artifacts_valid,
         id % 2 = 0 AS self_service_ok
  FROM guessed)
"""


def share(condition: str, subset: str = "TRUE") -> str:
    """SQL of a rate over a subset, 0 when it is empty."""
    return (
        f"round(coalesce(avg(CASE WHEN coalesce({condition}, FALSE) THEN 1.0::DOUBLE ELSE 0 END) "
        f"FILTER (WHERE {subset}), 0), 6)"
    )


CLEAR, PREDICTED = "gold_rc IN ('good', 'bad')", "pred_rc IN ('good', 'bad')"

KPI_SQL = ",\n  ".join([
    "count(*) AS n",
    share("correct") + " AS rc_accuracy",
    share("correct", CLEAR) + " AS rc_accuracy_clear",
    "round(coalesce(avg(cue_grounded_frac), 0), 6) AS cue_faithfulness",
    share("no_fabricated_telemetry") + " AS no_fabrication_rate",
    share("runbook_complete", PREDICTED) + " AS runbook_completeness",
    share("runbook_fidelity", PREDICTED) + " AS runbook_fidelity",
    share("artifacts_valid") + " AS artifact_valid_at_1",
    share("self_service_ok") + " AS self_service_present_rate",
    share("pred_rc <> 'unsure'", "gold_rc = 'unsure'") + " AS abstention_hallucination",
    share("confidence > 0.85 AND NOT correct") + " AS overconfident_wrong_rate",
    share("pred_rc = 'PARSE_FAIL'") + " AS parse_fail_rate",
])


def ece_cte(by: str) -> str:
    """SQL (CTEs ``bins`` and ``ece``) of the calibration error per ``by``."""
    return f"""
bins AS (
  SELECT {by}, greatest(0, least(9, floor(confidence * 10)::INT)) AS slot, count(*) AS m,
         avg(confidence) AS ac, avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) AS acc
  FROM samples WHERE confidence IS NOT NULL GROUP BY ALL),
ece AS (
  SELECT {by}, round(sum(m * abs(ac - acc)) / sum(m), 6) AS ece FROM bins GROUP BY {by})
"""


def round6(df: DataFrame, *keep: str) -> DataFrame:
    """Round all double columns to six digits, so that float noise cannot differ."""
    return df.select(*[
        F.round(F.col(c), 6).alias(c) if t == "double" and c not in keep else F.col(c)
        for c, t in df.dtypes
    ])
