"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Sources get targets by weight, capped at a multiple of their size, the excess shared again by weight.
A target above the source's size first takes whole epochs; what is left of it is drawn: each document
has the key ``-ln(u) / quality`` (u uniform, from a digest of seed and id), and documents are taken in
the order of their keys until the budget is used up; the last one gives the words that are left.

No source is sorted. Keys are put into 1,024 ranges per source, a running sum over the ranges finds
the one with the cut, which is split into 1,024 again; only the rows of that last range (a millionth
of a source) are ordered. Every row is then compared with its source's cut. Texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurate.llm.common import WORD, documents, own, stored
from sparkcurate.session import small_side

#: Key ranges per level, and levels.
RANGES, LEVELS = 1024, 2

#: Characters that lower a document's quality.
JUNK = "0123456789#*$%&|<>!@=_~^{}[]"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A weight from 0.1 to 1: it falls with the share of digits and symbols."""
    length = F.coalesce(F.length(text), F.lit(0))
    junk = length - F.coalesce(F.length(F.translate(text, JUNK, "")), F.lit(0))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * junk / F.greatest(length, F.lit(1)))


def exponential_key(id_col: Column, quality: Column, seed: int) -> Column:
    """``-ln(u) / quality`` with u in (0, 1) from an md5 of seed and id; the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("~"))))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return -F.log((number + 0.5) / F.lit(float(1 << 48))) / quality


def source_targets(rows: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Per source: source_size and target. ``rows``: source, size.

    Sources in code point order, null last, take the weights in turn. Each round shares what the
    capped sources leave by weight; it ends when no further source exceeds ``most`` times its size.
    """
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    # One row per source.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stored(sums.withColumn("weight", F.get(cycle, rank % len(weights))))
    cap = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        found = ranked.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, cap)).alias("used"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if found.n == capped or not found.open:
            break
        capped = found.n
        level = (share * total - (found.used or 0.0)) / found.open
    target = F.least(cap, F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", F.round(target, 6).alias("target"))


def draw_cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source with a budget: the place in the order where it is used up.

    ``rows``: source, key, id, tie, size. ``budgets``: source, budget. Returns source, cut (key, id, tie)
    and part, the words each row at the cut gives. Rows that are equal in all of these share evenly.
    """
    same = F.col("rows.source").eqNullSafe(F.col("found.source"))
    spread = F.floor(F.col("key") / (F.col("key") + 1) * RANGES**LEVELS).cast("long")
    placed = rows.withColumn("place", spread)
    found = budgets.where("budget > 0").withColumn("path", F.lit(0).cast("long"))
    for level in range(LEVELS + 1):
        if level < LEVELS:
            divisor = RANGES ** (LEVELS - 1 - level)
            inside = same & (F.floor(F.col("place") / (divisor * RANGES)) == F.col("path"))
            bucket = [F.floor(F.col("place") / divisor).cast("long").alias("path")]
        else:
            inside = same & (F.col("place") == F.col("path"))
            bucket = [F.struct("key", "id", "tie").alias("path")]
        sums = (
            placed.alias("rows").join(small_side(found).alias("found"), inside)
            .select(F.col("rows.source").alias("source"), "budget", "size", *bucket)
            .groupBy("source", "budget", "path")
            .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        )
        order = Window.partitionBy("source").orderBy("path").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        upto = sums.withColumn("upto", F.sum("size").over(order))
        found = stored(
            upto.where("upto >= budget and upto - size < budget")
            .withColumn("budget", F.col("budget") - F.col("upto") + F.col("size"))
            .select("source", "budget", "path", "n")
        )
    return found.select("source", F.col("path").alias("cut"),
                        F.floor(F.col("budget") / F.col("n")).cast("long").alias("part"))


def mix_sources(docs: DataFrame, quality: Column | None = None, weights: tuple = (3.0, 1.0, 2.0),
                share: float = 1.5, most: float = 2.0, seed: int = 42, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", keep: tuple = ()) -> DataFrame:
    """How many words of every document a mix of the sources takes.

    Returns the id, size (words), source_size, target (of its source) and taken, plus the input columns
    in ``keep``. One row per input row. ``quality`` is a positive weight per row
    (:func:`text_quality`). A null text has size 0 and gives 0 words; null ids are drawn like ids; a
    null source is a source of its own, the last. Ties in the key are broken by id, then text; rows equal
    in all three share what is left evenly. ``most`` must not be below ``share``. An empty table
    gives an empty result. Extra columns are ignored.
    """
    text = F.col(text_col)
    key, size, tie, source = own("key"), own("size"), own("tie"), own("source")
    weight = F.greatest(text_quality(text) if quality is None else quality, F.lit(1e-6))
    full = docs.select(
        F.col(id_col), *[F.col(c) for c in keep], word_count(text).alias(size),
        F.col(source_col).alias(source), exponential_key(F.col(id_col), weight, seed).alias(key),
        F.xxhash64(text).alias(tie),
    )
    light = stored(full.drop(*keep))
    rows = light.select(F.col(source).alias("source"), F.col(size).alias("size"),
                       F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(tie).alias("tie"))
    targets = source_targets(rows, list(weights), share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    planned = stored(targets.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long")).withColumn(
        "budget", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")))
    cuts = draw_cuts(rows, planned.select("source", "budget"))
    same = F.col("p.source").eqNullSafe(F.col("c.source"))
    plan = planned.alias("p").join(cuts.alias("c"), same, "left").select(
        F.col("p.source").alias(own("s")), "source_size", "target", "epochs", "cut", "part")
    plan_source = plan.columns[0]
    place = F.struct(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(tie).alias("tie"))
    drawn = F.when(F.col("cut").isNull(), 0).when(place < F.col("cut"), F.col(size)).when(
        place == F.col("cut"), F.col("part")).otherwise(0)
    # Kept columns are read again rather than written; without any, the stored rows are enough.
    return (full if keep else light).join(small_side(plan), F.col(source).eqNullSafe(F.col(plan_source))).select(
        F.col(id_col), *[F.col(c) for c in keep], F.col(size).alias("size"), "source_size", "target",
        (F.col("epochs") * F.col(size) + drawn).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, columns as given: one row per epoch, and one more for a drawn document.

    The document at the cut is kept if at least half of it fits. Clean documents of a source whose
    target is below its size are left out only by the draw. Wordless documents add nothing and stay once.
    """
    names = {c: own("c") for c in docs.columns}
    hidden = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    mix = mix_sources(
        hidden, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"],
        keep=tuple(n for c, n in names.items() if c != "doc_id"), **options)
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    copies = own("copies")
    repeated = mix.withColumn(copies, F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select(*[F.col(n).alias(c) for c, n in names.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document: weights 3, 1, 2 in turn, 150% of all words, at most twice."""
    return mix_sources(documents(spark, sf_dir, "doc_id", "text", "source"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '~')) AS digest, coalesce(length(text), 0) AS chars,
         coalesce(length(text) - length(translate(text, '0123456789#*$%&|<>!@=_~^{}[]', '')), 0) AS junk,
         text
  FROM documents),
keyed AS (
  SELECT doc_id, source, size, text,
         -ln((('0x' || digest[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
         / greatest(0.1::DOUBLE, 1::DOUBLE - 5::DOUBLE * junk / greatest(chars, 1)) AS key
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM sources),
walked AS (
  SELECT *, sum(cap) OVER (ORDER BY ratio)
            + ratio * (sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio)) AS used FROM levels),
filled AS (
  SELECT (any_value(total) - coalesce(sum(cap) FILTER (WHERE used <= total), 0))
         / sum(weight) FILTER (WHERE used > total) AS level FROM walked),
planned AS (
  SELECT source, source_size, round(least(cap, weight * level), 6) AS target FROM walked, filled),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM planned),
ordered AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
         floor(e.target)::BIGINT - e.epochs * e.source_size AS budget,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - (upto - size))))::BIGINT AS taken
FROM ordered
"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": OP5_SQL}
