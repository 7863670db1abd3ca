"""Validate, split and materialise record folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.operators.split import stratified_holdout
from sparkcurate.operators.validate import missing_values
from sparkcurate.schemas import KEEP_AUDIT, MODES
from sparkcurate.sources.readers import load_split
from sparkcurate.sources.writers import read_or_build, write_raw_lines

#: Record types split together: chat and reasoning records form one pool.
POOLS = {"sft": ("sft", "reasoning"), "preference": ("preference",)}


def split_pool(spark: SparkSession, data_dir: str, pool: str, out_dir: str, fraction: float,
               min_total: int, seed: int, modes: Sequence[str] = MODES,
               keep: Sequence[str] | None = KEEP_AUDIT) -> DataFrame:
    """The pool's records with a ``split`` column, stored once under ``out_dir`` and then reused."""
    def build() -> DataFrame:
        kept, _ = load_split(spark, data_dir, POOLS[pool], keep, "fail", modes)
        return stratified_holdout(kept, "mode", "id", fraction, min_total, seed)

    return read_or_build(spark, f"{out_dir.rstrip('/')}/{pool}", build)


def export_lines(split: DataFrame, out_dir: str) -> None:
    """The original lines of both sides as JSON-lines folders."""
    for side in ("train", "val"):
        write_raw_lines(split.where(F.col("split") == side), f"{out_dir.rstrip('/')}/{side}")


def uncovered_modes(split: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """Modes that never occur on the validation side."""
    return missing_values(split.where(F.col("split") == "val"), "mode", modes)
