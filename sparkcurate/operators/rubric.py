"""Rubric scores, judges, votes, win rates and judge cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.numbers import clamp, rate, report_round, ten_scale
from sparkcurate.functions.text import word_count
from sparkcurate.schemas import WEIGHTS

# Fixed values. Politeness markers of the offline judge.
POLITE_MARKERS = ("dạ", "ạ", "anh", "chị", "cảm ơn")

# Fixed values. USD per million tokens (in, out); the first key contained in a model name counts.
PRICES = (
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 2.50, 10.00),
    ("gemini-1.5-flash", 0.075, 0.30),
    ("gemini-1.5-pro", 1.25, 5.00),
)

# Fixed values. Judges that must not grade their own students.
DENIED_JUDGES = ("claude", "anthropic", "deepseek")


def weighted_mean(means: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted mean of criterion columns; absent ones count as 0, weights must include a positive."""
    used = {c: w for c, w in weights.items() if w > 0 and c in means}
    if not used:
        raise ValueError("no positive weight matches the scores")
    total = F.lit(0.0)
    for criterion, weight in used.items():
        total = total + F.coalesce(means[criterion], F.lit(0.0)) * F.lit(float(weight))
    return total / F.lit(float(sum(used.values())))


def case_scores(scores: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """(sample_id, mode, judge, criterion, score) to one row per case with judge means as columns."""
    return scores.groupBy("sample_id", "mode").agg(*[
        F.avg(F.when(F.col("criterion") == c, F.col("score"))).alias(c) for c in criteria
    ])


def summarise_by_mode(cases: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Criterion means and weighted averages per mode plus an ``overall`` row, in one roll-up.

    A literal row that counts nothing keeps the overall row for an empty input (0, hence -2.5 on
    the ten scale).
    """
    criteria = list(weights)
    rows = cases.select("mode", *criteria, F.lit(1).alias("one"))
    floor = rows.sparkSession.createDataFrame([(0,)], "one INT")
    rolled = (
        rows.unionByName(floor, allowMissingColumns=True).rollup("mode").agg(
            F.grouping("mode").alias("is_total"), F.sum("one").cast("long").alias("n"),
            *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in criteria],
        )
        .where("is_total = 1 OR n > 0")
    )
    five = F.when(
        F.col("n") > 0, weighted_mean({c: F.col(c) for c in criteria}, weights)
    ).otherwise(F.lit(0.0))
    mode = F.when(F.col("is_total") == 1, F.lit("overall")).otherwise(F.col("mode"))
    return rolled.withColumns({"mode": mode, "score_5": five}).withColumn(
        "score_10", ten_scale(F.col("score_5"))
    ).select("mode", "n", "score_5", "score_10", *criteria)


def rounded(summary: DataFrame, keep: Sequence[str] = ("mode", "n")) -> DataFrame:
    """The report form: every number rounded half-even to four decimals."""
    return summary.select(*keep, *[
        report_round(F.col(c)).alias(c) for c in summary.columns if c not in keep
    ])


def criterion_means(summary: DataFrame, criteria: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """(criterion, mean_5) of the overall row."""
    overall = summary.where(F.col("mode") == "overall")
    return overall.unpivot([], list(criteria), "criterion", "mean_5").select(
        "criterion", report_round(F.col("mean_5")).alias("mean_5")
    )


def judge_spread(scores: DataFrame, case: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Max minus min of the judges' mean scores per case; 0 with fewer than two judges."""
    per_judge = scores.groupBy(*case, "judge").agg(F.avg("score").alias("s"))
    return per_judge.groupBy(*case).agg(
        F.when(F.count("s") < 2, F.lit(0.0)).otherwise(F.max("s") - F.min("s")).alias("spread")
    )


def mean_spread(spread: DataFrame) -> DataFrame:
    """Mean disagreement over the cases."""
    return spread.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg("spread"), F.lit(0.0)).alias("judge_disagreement"),
    )


def majority(votes: DataFrame, case: Sequence[str]) -> DataFrame:
    """One verdict per case: the side with more judges, else a tie."""
    a, b = F.count_if(F.col("vote") == "A"), F.count_if(F.col("vote") == "B")
    return votes.groupBy(*case).agg(
        F.when(a > b, "A").when(b > a, "B").otherwise("tie").alias("verdict")
    )


def win_rates(verdicts: DataFrame, mode: str = "mode") -> DataFrame:
    """win, tie and loss shares per mode plus an ``overall`` row (zeros for no verdicts)."""
    v = F.col("verdict")
    rows = verdicts.select(F.col(mode).alias("mode"), v)
    floor = rows.sparkSession.createDataFrame([(None, None)], "mode STRING, verdict STRING")
    total = F.count("verdict")
    shares = {
        "win": F.count_if(v == "A"), "tie": F.count_if(v == "tie"),
        "loss": total - F.count_if(v == "A") - F.count_if(v == "tie"),
    }
    rolled = rows.unionByName(floor).rollup("mode").agg(
        F.grouping("mode").alias("is_total"), total.alias("n"),
        *[F.coalesce(F.try_divide(n, total), F.lit(0.0)).alias(k) for k, n in shares.items()],
    )
    name = F.when(F.col("is_total") == 1, F.lit("overall")).otherwise(F.col("mode"))
    return rolled.where("is_total = 1 OR n > 0").select(name.alias("mode"), "win", "tie", "loss", "n")


def percent_table(rates: DataFrame) -> DataFrame:
    """Display form of win rates: percent with one decimal."""
    def percent(column: str, name: str) -> Column:
        return report_round(F.col(column) * 100, 1).alias(name)

    return rates.select(
        F.col("mode").alias("slice"), percent("win", "a_win_pct"), percent("tie", "tie_pct"),
        percent("loss", "b_win_pct"), "n",
    )


def head_to_head(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases both runs answered; mode, prompt and reference come from run A."""
    other = b.select("id", F.col("answer").alias("answer_b"))
    return a.select("id", "mode", "prompt", F.col("answer").alias("answer_a")).join(other, "id")


def polite_count(text: Column, markers: Sequence[str] = POLITE_MARKERS) -> Column:
    """How many of the markers occur."""
    lowered = F.lower(text)
    count = F.lit(0)
    for marker in markers:
        count = count + lowered.contains(marker).cast("int")
    return count


def heuristic_score(text: Column, markers: Sequence[str] = POLITE_MARKERS) -> Column:
    """Offline judge: length and politeness on the 1..5 scale."""
    length = word_count(text) / F.lit(20.0)
    return clamp(F.lit(1.0) + length + polite_count(text, markers) * F.lit(0.5))


def tone_score(text: Column, markers: Sequence[str] = POLITE_MARKERS) -> Column:
    """The offline judge's tone score."""
    return clamp(F.lit(1.0) + polite_count(text, markers))


def heuristic_vote(a: Column, b: Column) -> Column:
    """The offline judge's pairwise verdict from two scores."""
    return F.when(F.abs(a - b) < 1e-9, "tie").when(a > b, "A").otherwise("B")


def price_of(model: Column, prices: Sequence[tuple[str, float, float]] = PRICES) -> Column:
    """Struct (usd_in, usd_out) of the first price key contained in the model name; 0 without one."""
    def entry(usd_in: float, usd_out: float) -> Column:
        return F.struct(F.lit(float(usd_in)).alias("usd_in"), F.lit(float(usd_out)).alias("usd_out"))

    out = None
    for key, usd_in, usd_out in prices:
        test, value = model.contains(key), entry(usd_in, usd_out)
        out = F.when(test, value) if out is None else out.when(test, value)
    return entry(0, 0) if out is None else out.otherwise(entry(0, 0))


def judge_usage(calls: DataFrame,
                prices: Sequence[tuple[str, float, float]] = PRICES) -> DataFrame:
    """Calls, tokens and estimated cost per judge and in total (``judge`` = ``total``).

    ``calls``: judge, model, calls, prompt_tokens, completion_tokens. Integer token sums are
    priced after aggregation, so the cost does not depend on the order of additions.
    """
    per_model = calls.groupBy("judge", "model").agg(
        F.sum("calls").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    ).withColumn("p", price_of(F.col("model"), prices)).withColumn(
        "usd", F.col("prompt_tokens") / 1e6 * F.col("p.usd_in")
        + F.col("completion_tokens") / 1e6 * F.col("p.usd_out"),
    )
    rolled = per_model.rollup("judge").agg(
        F.grouping("judge").alias("is_total"),
        *[F.sum(c).cast("long").alias(c) for c in ("calls", "prompt_tokens", "completion_tokens")],
        report_round(F.sum("usd")).alias("est_usd"),
    )
    name = F.when(F.col("is_total") == 1, F.lit("total")).otherwise(F.col("judge"))
    return rolled.select(
        name.alias("judge"), "calls", "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), "est_usd",
    )


def exact_match(pairs: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Share of predictions equal to their reference."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col(prediction) == F.col(reference)).alias("exact_match"),
    )
