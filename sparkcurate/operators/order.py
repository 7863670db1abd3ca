"""Selections and numberings that would otherwise sort a whole (possibly hot) group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.session import cut_lineage, small_side

#: Leading hex digits of the hash that form the histogram: 4,096 buckets per stratum. Few enough to be
#: combined before the shuffle, many enough that one bucket of a hot stratum is a normal task.
BUCKET_DIGITS = 3

#: Rows that one task may sort.
TASK_ROWS = 100_000

#: Shares of a cell at which it is cut again, and the most edges of any cell.
INNER = [i / 32 for i in range(1, 32)]
MOST_EDGES = 32


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL, as in a grouping; keys once, from the left."""
    renamed = right.select(*[F.col(c).alias(f"_same_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(renamed[f"_same_{key}"])
    return left.join(renamed, same).drop(*[f"_same_{key}" for key in keys])


def smallest_key_cut(keys: DataFrame, quotas: DataFrame, bound: int = TASK_ROWS) -> DataFrame:
    """Per stratum, the key of the last row among its ``take`` smallest.

    ``keys``: stratum, h (hex digest), id. ``quotas``: stratum, take. Returns stratum, cut_h, cut_id.

    A histogram over the leading digits finds the bucket with the boundary; that bucket is cut by further digits
    until it has at most ``bound`` rows or one digest, and only then sorted. Each level reads a 4,096th of the one
    before. Equal keys are counted before the window, so copies of one id do not pile up, and
    they always end on the same side.
    """
    open_, wanted, digits, found = keys.select("stratum", "h", "id"), quotas.select("stratum", "take"), 0, None
    running = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        digits += BUCKET_DIGITS
        bucketed = open_.withColumn("bucket", F.substring("h", 1, digits))
        histogram = bucketed.groupBy("stratum", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        boundary = cut_lineage(
            histogram.withColumn("upto", F.sum("n").over(running)).join(wanted, "stratum")
            .where((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("n") < F.col("take")))
            .select("stratum", "bucket", (F.col("take") - F.col("upto") + F.col("n")).alias("need"),
                    ((F.col("n") <= bound) | (F.col("low") == F.col("high"))).alias("done")))
        inside = bucketed.join(small_side(boundary), ["stratum", "bucket"])
        cut = _cut_inside(inside.where("done"))
        found = cut if found is None else found.unionByName(cut)
        if boundary.where("NOT done").isEmpty():
            return found
        open_ = cut_lineage(inside.where("NOT done").select("stratum", "h", "id"))
        wanted = boundary.where("NOT done").select("stratum", F.col("need").alias("take"))


def _cut_inside(inside: DataFrame) -> DataFrame:
    """The key at place ``need`` of each stratum's rows, by a sort."""
    counted = inside.groupBy("stratum", "bucket", "need", "h", "id").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("stratum", "bucket").orderBy("h", "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        counted.withColumn("upto", F.sum("n").over(within))
        .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        .select("stratum", F.col("h").alias("cut_h"), F.col("id").alias("cut_id"))
    )


def number_rows(df: DataFrame, order: str, name: str, chunk: int = 1_000_000,
                by: Sequence[str] = ()) -> DataFrame:
    """Dense numbers 1..n along an integer column with distinct values, without a global sort.

    Rows are counted per range of ``chunk`` values; a row's number is its number inside its range
    plus the rows in earlier ranges.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / chunk).cast("long"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    return (
        join_same(ranged.withColumn("_rn", F.row_number().over(inside)), offsets, [*by, "_range"])
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_range", "_rn", "_offset")
    )


def running_total(df: DataFrame, by: Sequence[str], order: str, amount: Column, name: str,
                  chunk: int = 1000) -> DataFrame:
    """Sum of ``amount`` over the rows before each row of its group, in two levels.

    Totals per range of ``chunk`` order values are summed first, so a group of any size is spread
    over as many tasks as it has ranges.
    """
    ranged = df.withColumns({
        "_range": F.floor(F.col(order) / chunk).cast("long"), "_amount": amount,
    })
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*by, "_range").agg(F.sum("_amount").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        join_same(ranged.withColumn("_before", F.coalesce(F.sum("_amount").over(inside), F.lit(0))),
                  offsets, [*by, "_range"])
        .withColumn(name, F.col("_offset") + F.col("_before"))
        .drop("_range", "_amount", "_before", "_offset")
    )


def exact_percentiles(df: DataFrame, value: str, fractions: Sequence[float],
                      by: Sequence[str] = (), margin: float = 0.0005, bound: int = TASK_ROWS) -> DataFrame:
    """Linear-interpolated percentiles as columns ``p0, p1, ...`` plus ``n`` and ``mean``.

    An approximate sketch only proposes edges around each rank; :func:`values_at_ranks` counts exactly between
    them and looks closer where a wanted rank lies. No group is ever sorted or collected in one task.
    """
    group = [*by, "_cell"]
    rows = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("v"), F.lit(0).cast("long").alias("_cell"))
    spots = sorted({min(1.0, max(0.0, f + s * margin)) for f in fractions for s in (-1, 1)})
    sizes = cut_lineage(rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"),
        F.percentile_approx("v", [float(s) for s in spots], int(10 / margin)).alias("edges")))
    places = [F.lit(float(f)) * (F.col("n") - 1) for f in fractions]
    wanted = F.array_distinct(F.array(*[side(p).cast("long") for p in places for side in (F.floor, F.ceil)]))
    ranks = sizes.select(*group, F.explode(wanted).alias("rank"))
    values = values_at_ranks(rows, ranks, sizes.select(*group, "n", "edges"), by, len(spots), bound)
    joined = join_same(values.withColumn("_cell", F.lit(0).cast("long")), sizes.select(*group, "n", "mean"), group)
    out = []
    for i, place in enumerate(places):
        at_low = F.max(F.when(F.col("rank") == F.floor(place), F.col("v")))
        at_high = F.max(F.when(F.col("rank") == F.ceil(place), F.col("v")))
        part = F.max(place - F.floor(place))
        out.append((at_low + (at_high - at_low) * part).alias(f"p{i}"))
    return joined.groupBy(*group).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *out).drop("_cell")


def values_at_ranks(rows: DataFrame, ranks: DataFrame, sizes: DataFrame, by: Sequence[str], edges: int,
                    bound: int = TASK_ROWS) -> DataFrame:
    """(by, rank, v): the values at wanted ranks, counted from 0 in ascending order.

    ``rows``: by, _cell, v. ``ranks``: by, _cell, rank. ``sizes``: by, _cell, n, edges (array of ``edges`` values).

    A cell of at most ``bound`` rows is sorted. A larger one is counted in slots, one per edge for the values
    equal to it and one per gap; a slot of one value is an answer, any other that holds a wanted rank becomes a
    cell with edges of its own. Cells shrink geometrically, whatever the distribution, and so does what a
    round reads; no task's work grows with a group.
    """
    group = [*by, "_cell"]
    ranks = ranks.withColumn("local", F.col("rank"))
    found: list[DataFrame] = []
    while True:
        large = sizes.where(F.col("n") > bound)
        some = not large.isEmpty()
        inside = join_same(rows, small_side(sizes.where(F.col("n") <= bound).select(*group)), group) if some else rows
        found.append(_values_by_sort(inside, ranks, group).select(*by, "rank", "v"))
        if not some:
            break
        place = F.lit(0)
        for i in range(edges):
            edge = F.get("edges", F.lit(i))
            place = place + (F.col("v") > edge).cast("int") + (F.col("v") >= edge).cast("int")
        placed = join_same(rows, small_side(large.select(*group, "edges")), group).withColumn("slot", place).drop("edges")
        upto = Window.partitionBy(*group).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        slots = placed.groupBy(*group, "slot").agg(
            F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        slots = slots.withColumn("start", F.sum("m").over(upto) - F.col("m"))
        hit = cut_lineage(join_same(ranks, slots, group).where(
            (F.col("local") >= F.col("start")) & (F.col("local") < F.col("start") + F.col("m"))))
        found.append(hit.where("low = high").select(*by, "rank", F.col("low").alias("v")))
        wider = hit.where("low <> high")
        if wider.isEmpty():
            break
        cell = (F.col("_cell") * (2 * MOST_EDGES + 1) + F.col("slot")).alias("_cell")
        needed = wider.select(*group, "slot").distinct()
        rows = cut_lineage(join_same(placed, small_side(needed), [*group, "slot"]).select(*by, cell, "v"))
        ranks = wider.select(*by, cell, "rank", (F.col("local") - F.col("start")).alias("local"))
        edges = len(INNER)
        sizes = cut_lineage(rows.groupBy(*group).agg(
            F.count(F.lit(1)).alias("n"), F.percentile_approx("v", INNER, 10_000).alias("edges")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _values_by_sort(rows: DataFrame, ranks: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, rank, v) of cells small enough to be sorted; equal values are counted first."""
    running = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", F.sum("m").over(running))
    return join_same(ranks, counted, group).where(
        (F.col("local") < F.col("upto")) & (F.col("local") >= F.col("upto") - F.col("m"))).select(*group, "rank", "v")
