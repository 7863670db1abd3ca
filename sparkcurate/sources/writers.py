"""Writers. Every sink is a distributed write; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions.draw import digest
from sparkcurate.schemas import SAMPLE


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, empty fields left out."""
    df.write.mode(mode).json(path)


def write_raw_lines(df: DataFrame, path: str, value: str = "value",
                    mode: str = "errorifexists", compression: str = "none") -> None:
    """The original lines, unchanged (for splits that must keep unknown fields). ``compression``: as of Spark's text writer."""
    df.select(value).write.mode(mode).text(path, compression=compression)


def shuffled_order(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """A reproducible file order: a range sort by digest. Only needed when line order matters."""
    return df.orderBy(digest(seed, F.col(id_col)), F.col(id_col))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> None:
    """Parquet, partitioned by low-cardinality tags such as ``data_type`` and ``split``."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                  partition_by: Sequence[str] = ("split",)) -> DataFrame:
    """A materialised split: read if it is there, else computed once and stored."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    write_table(build(), path, partition_by)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, doubled quotes."""
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def write_fact_csv(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Per-answer rows, hits joined by ``; ``."""
    names = [part.split()[0] for part in SAMPLE.split(", ")]
    rows = samples
    if dict(samples.dtypes)["telemetry_hits"].startswith("array"):
        rows = samples.withColumn("telemetry_hits", F.array_join("telemetry_hits", "; "))
    write_csv(rows.select(*names), path, mode)


def ordered(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first, the rest by name."""
    lead = [c for c in preferred if c in df.columns]
    return df.select(*lead, *sorted(c for c in df.columns if c not in lead))


def report_payload(report: DataFrame, slices: DataFrame, confusion: DataFrame) -> DataFrame:
    """One JSON line per run: metrics, slice accuracies and the nested confusion counts.

    ``slices`` and ``confusion`` are finished aggregates keyed by run: a few rows per run.
    """
    per_slice = slices.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("slice", "accuracy")))).alias("per_slice_accuracy"))
    rows = confusion.groupBy("run", "gold").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("pred", "n")))).alias("preds"))
    nested = rows.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("gold", F.to_json("preds").alias("preds"))))).alias("confusion"))
    return report.join(per_slice, "run").join(nested, "run")


def write_reports(report: DataFrame, root: str) -> None:
    """Report rows of any number of runs in one write: a folder ``run=<run>`` per run under ``root``."""
    report.write.partitionBy("run").json(root)


def append_runs(row: DataFrame, path: str) -> None:
    """Append run metadata (config, commit, data version, seed, metrics) to a runs table."""
    row.write.mode("append").parquet(path)


def append_traces(samples: DataFrame, path: str) -> None:
    """Append evaluated answers to a trace table partitioned by run."""
    samples.write.mode("append").partitionBy("run").parquet(path)
