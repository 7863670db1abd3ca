"""Mergeable quantile sketches: stored per partition of the data, merged later without reading rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch: a rank is off by about 2.3 / SKETCH_K of all rows at most (99% confidence), and not at
#: all while a sketch holds fewer values than that.
SKETCH_K = 4000


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """(by, n, total, low, high, sketch): one sketch of ``value`` per group; null values are left out.

    A sketch is a few tens of kilobytes whatever the group; groups without a value have no row.
    """
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, k).alias("sketch"))


def store_sketches(sketches: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write sketches in folders of ``partition_by`` (such as run and day); a folder written again is replaced.

    So a batch that is replayed changes nothing, and a new day reads only itself.
    """
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def merged_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Sketches merged to coarser groups; the same columns. No row of data is read."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, low, high, p0, p1, ...): approximate percentiles, each a value that occurs in the data."""
    def at(fraction: float) -> Column:
        if fraction in (0.0, 1.0):
            return F.col("low") if fraction == 0.0 else F.col("high")
        return F.kll_sketch_get_quantile_double("sketch", F.lit(float(fraction)))

    return sketches.select(*by, "n", (F.col("total") / F.col("n")).alias("mean"), "low", "high",
                           *[at(f).alias(f"p{i}") for i, f in enumerate(fractions)])


def rank_error(k: int = SKETCH_K) -> float:
    """Share of all rows by which the rank of a percentile is off at most, in 99 of 100 cases."""
    return 2.296 / k ** 0.9723
