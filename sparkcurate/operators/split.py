"""Deterministic hold-out splits.

The data itself is never shuffled: a split only needs one cut key per stratum, and a row is in the
validation side when its own key is not above the cut. The cut comes from column-pruned scans of
(stratum, id).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions.draw import digest
from sparkcurate.operators.order import smallest_key_cut
from sparkcurate.session import small_side


def stratum_quotas(keys: DataFrame, fraction: float, min_total: int) -> DataFrame:
    """Validation rows per stratum: an even share of the target, the remainder to the first strata.

    A stratum keeps at least one training row, unless it has only one row: that one is validated.
    """
    sizes = keys.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    # one row per stratum: a tag list, not data
    everything = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumns({
        "total": F.sum("size").over(everything),
        "strata": F.count(F.lit(1)).over(everything),
        "pos": F.row_number().over(everything.orderBy("stratum")) - 1,
    })
    target = F.greatest(F.lit(min_total), F.ceil(F.lit(float(fraction)) * F.col("total")))
    checked = F.when(
        F.col("target") >= F.col("total"),
        F.raise_error(F.lit("validation target reaches the dataset size")).cast("long"),
    ).otherwise(F.col("target"))
    want = F.greatest(
        F.lit(1),
        F.floor(F.col("target") / F.col("strata"))
        + (F.col("pos") < F.col("target") % F.col("strata")).cast("int"),
    )
    most = F.when(F.col("size") > 1, F.col("size") - 1).otherwise(F.col("size"))
    return (
        ranked.withColumn("target", target).withColumn("target", checked)
        .select("stratum", F.least(want, most).alias("take"))
    )


def _mark(df: DataFrame, stratum, id_col: str, cuts: DataFrame, seed: int) -> DataFrame:
    marked = df.withColumns({"_stratum": stratum, "_h": digest(seed, F.col(id_col))})
    cuts = small_side(cuts.withColumnRenamed("stratum", "_stratum"))
    key = F.struct(F.col("_h"), F.col(id_col).alias("k"))
    cut = F.struct(F.col("cut_h"), F.col("cut_id").alias("k"))
    side = F.when(F.coalesce(key <= cut, F.lit(False)), "val").otherwise("train")
    return (
        marked.join(cuts, "_stratum", "left").withColumn("split", side)
        .drop("_stratum", "_h", "cut_h", "cut_id")
    )


def stratified_holdout(df: DataFrame, stratum: str, id_col: str, fraction: float,
                       min_total: int, seed: int) -> DataFrame:
    """Add ``split`` (``train``/``val``) with every stratum represented in ``val``.

    Empty input and a target that reaches the dataset size are errors.
    """
    if df.isEmpty():
        raise ValueError("cannot split an empty record set")
    tag = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    keys = df.select(tag.alias("stratum"), digest(seed, F.col(id_col)).alias("h"),
                     F.col(id_col).alias("id"))
    quotas = stratum_quotas(keys, fraction, min_total)
    return _mark(df, tag, id_col, smallest_key_cut(keys, quotas), seed)


def flat_holdout(df: DataFrame, id_col: str, fraction: float, seed: int,
                 min_rows: int = 2) -> DataFrame:
    """Hold out ``round(n * fraction)`` rows; all rows train when that is none, all, or n is small."""
    if fraction <= 0.0:
        return df.withColumn("split", F.lit("train"))
    one = F.lit("all")
    keys = df.select(one.alias("stratum"), digest(seed, F.col(id_col)).alias("h"),
                     F.col(id_col).alias("id"))
    n = F.count(F.lit(1))
    take = F.bround(n * F.lit(float(fraction))).cast("long")
    usable = (n >= min_rows) & (take >= 1) & (take < n)
    quotas = keys.groupBy("stratum").agg(F.when(usable, take).otherwise(F.lit(0)).alias("take"))
    cut = smallest_key_cut(keys, quotas).first()  # one row at most: constants instead of a join
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    key = F.struct(digest(seed, F.col(id_col)).alias("h"), F.col(id_col).alias("k"))
    last = F.struct(F.lit(cut["cut_h"]).alias("h"), F.lit(cut["cut_id"]).alias("k"))
    return df.withColumn("split", F.when(key <= last, "val").otherwise("train"))


def preference_holdout(df: DataFrame, id_col: str, seed: int, fraction: float = 0.1) -> DataFrame:
    """Fallback split of preference pairs: nine to one from 20 pairs on, else all train."""
    return flat_holdout(df, id_col, fraction, seed, min_rows=20)


def split_overlap(split: DataFrame, id_col: str) -> DataFrame:
    """Ids on both sides; empty for a sound split."""
    return (
        split.groupBy(id_col)
        .agg(F.count_if(F.col("split") == "val").alias("val"),
             F.count_if(F.col("split") == "train").alias("train"))
        .where("val > 0 AND train > 0").select(id_col)
    )


def scaled_sizes(counts: DataFrame, limit: int | None, size: str = "n", name: str = "size") -> DataFrame:
    """As :func:`scaled_mix` for a table of group sizes of any length: one total, then a projection."""
    if limit is None:
        return counts.withColumn(name, F.col(size))
    total = counts.agg(F.sum(size)).first()[0] or 1
    scaled = F.bround(F.col(size) * F.lit(limit / total)).cast("long")
    return counts.withColumn(name, F.greatest(F.lit(1).cast("long"), scaled))


def scaled_mix(mix: Mapping[str, int], limit: int | None) -> dict[str, int]:
    """Group sizes scaled to about ``limit`` rows in total, at least one each."""
    if limit is None:
        return dict(mix)
    scale = limit / sum(mix.values())
    return {name: max(1, round(size * scale)) for name, size in mix.items()}
