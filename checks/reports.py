"""Rubric, judges, win rates, latency, cost and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, round6, table
from checks.texts import WS
from sparkcurate.functions import answers as A
from sparkcurate.functions import numbers as N
from sparkcurate.operators import logs, rubric, turns

WEIGHTS = {"click": 2.0, "view": 1.0, "purchase": 1.5, "error": 0.5, "absent": 1.0}


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Judge scores derived from events: users as cases, event types as criteria."""
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        u.alias("sample_id"), F.concat(F.lit("m"), (u % 5).cast("string")).alias("mode"),
        F.concat(F.lit("j"), (F.col("event_id") % 3).cast("string")).alias("judge"),
        F.col("event_type").alias("criterion"),
        N.clamp(F.col("value") / 10).alias("score"))


SCORES = """
scores AS (SELECT user_id AS sample_id, 'm' || (user_id % 5) AS mode, 'j' || (event_id % 3) AS judge,
  event_type AS criterion, least(5::DOUBLE, greatest(1::DOUBLE, value / 10)) AS score FROM events),
cases AS (SELECT sample_id, mode, avg(score) FILTER (WHERE criterion = 'click') AS click,
  avg(score) FILTER (WHERE criterion = 'view') AS view, avg(score) FILTER (WHERE criterion = 'purchase') AS purchase,
  avg(score) FILTER (WHERE criterion = 'error') AS error FROM scores GROUP BY ALL),
means AS (SELECT coalesce(mode, 'overall') AS mode, count(*) AS n, coalesce(avg(click), 0) AS click, coalesce(avg(view), 0) AS view,
  coalesce(avg(purchase), 0) AS purchase, coalesce(avg(error), 0) AS error, 0::DOUBLE AS absent FROM cases GROUP BY ROLLUP (mode)),
five AS (SELECT *, (click * 2 + view + purchase * 1.5::DOUBLE + error * 0.5::DOUBLE) / 6::DOUBLE AS s FROM means)
"""


@query(f"""
WITH {SCORES} SELECT mode, n, round(s, 6) AS score_5, round((s - 1) / 4 * 10, 6) AS score_10, round(click, 6) AS click,
  round(view, 6) AS view, round(purchase, 6) AS purchase, round(error, 6) AS error, absent FROM five""")
def rubric_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    """AG8, AG9: weighted rubric means per mode and overall."""
    cases = rubric.case_scores(scores(spark, sf), list(WEIGHTS))
    return round6(rubric.summarise_by_mode(cases, WEIGHTS))


@query(f"""
WITH {SCORES}, r AS (SELECT click, view, purchase, error, absent FROM means WHERE mode = 'overall')
SELECT criterion, round_even(value, 4) AS mean_5 FROM (UNPIVOT r ON COLUMNS(*) INTO NAME criterion VALUE value)""")
def criterion_means(spark: SparkSession, sf: str) -> DataFrame:
    """SI5, PR19: overall mean per criterion, rounded for the report."""
    summary = rubric.summarise_by_mode(rubric.case_scores(scores(spark, sf), list(WEIGHTS)), WEIGHTS)
    return rubric.criterion_means(summary, list(WEIGHTS))


@query(f"""
WITH {SCORES} SELECT mode, round((s - 1) / 4 * 10, 6) AS score_10 FROM five WHERE mode <> 'overall'
ORDER BY round((s - 1) / 4 * 10, 6), mode LIMIT 3""")
def weakest_modes(spark: SparkSession, sf: str) -> DataFrame:
    """TK2: the three weakest modes on the ten scale."""
    from sparkcurate.operators.kpi import weakest

    summary = rubric.summarise_by_mode(rubric.case_scores(scores(spark, sf), list(WEIGHTS)), WEIGHTS)
    rows = round6(summary.select("mode", "score_10")).where("mode <> 'overall'")
    return weakest(rows, "mode", "score_10", 3)


@query(f"""
WITH {SCORES}, j AS (SELECT sample_id, judge, avg(score) AS s FROM scores GROUP BY ALL),
d AS (SELECT sample_id, CASE WHEN count(*) < 2 THEN 0 ELSE max(s) - min(s) END AS spread FROM j GROUP BY sample_id)
SELECT count(*) AS n, round(avg(spread), 6) AS judge_disagreement FROM d""")
def judge_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    """AG10: mean spread between judges."""
    return round6(rubric.mean_spread(rubric.judge_spread(scores(spark, sf))))


VOTES = """
votes AS (SELECT user_id AS id, 'm' || (user_id % 5) AS mode,
  CASE WHEN value < 8 THEN 'A' WHEN value < 30 THEN 'B' ELSE 'tie' END AS vote FROM events),
verdicts AS (SELECT id, mode, CASE WHEN count(*) FILTER (WHERE vote = 'A') > count(*) FILTER (WHERE vote = 'B') THEN 'A'
  WHEN count(*) FILTER (WHERE vote = 'B') > count(*) FILTER (WHERE vote = 'A') THEN 'B' ELSE 'tie' END AS verdict
  FROM votes GROUP BY ALL)
"""


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """Judge votes derived from events."""
    v, u = F.col("value"), F.col("user_id")
    return table(spark, sf, "events").select(
        u.alias("id"), F.concat(F.lit("m"), (u % 5).cast("string")).alias("mode"),
        F.when(v < 8, "A").when(v < 30, "B").otherwise("tie").alias("vote"))


@query(f"WITH {VOTES} SELECT id, mode, verdict FROM verdicts")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    """AG11: one verdict per case."""
    return rubric.majority(votes(spark, sf), ("id", "mode"))


RATES = """SELECT coalesce(mode, 'overall') AS mode, round(avg((verdict = 'A')::INT::DOUBLE), 6) AS win,
  round(avg((verdict = 'tie')::INT::DOUBLE), 6) AS tie, round(avg((verdict = 'B')::INT::DOUBLE), 6) AS loss, count(*) AS n
  FROM verdicts GROUP BY ROLLUP (mode)"""


@query(f"WITH {VOTES} {RATES}")
def win_rates(spark: SparkSession, sf: str) -> DataFrame:
    """AG12: win, tie and loss shares per mode and overall."""
    return round6(rubric.win_rates(rubric.majority(votes(spark, sf), ("id", "mode"))))


HEAD = f"""
h AS (SELECT t.conv_id AS id, t.turn, t.text, least(5::DOUBLE, greatest(1::DOUBLE,
   1 + len({WS.format("t.text")}) / 20::DOUBLE + 0.5::DOUBLE * ({" + ".join(f"contains(lower(t.text), '{m}')::INT" for m in ("la", "the", "eau", "un"))}))) AS score
  FROM conversations t WHERE role = 'assistant'),
v AS (SELECT a.id, 'm' || (a.id % 3) AS mode, CASE WHEN abs(a.score - b.score) < 1e-9 THEN 'tie' WHEN a.score > b.score THEN 'A' ELSE 'B' END AS verdict
  FROM h a JOIN h b ON a.id = b.id AND b.turn = a.turn + 2)
"""
MARKS = ("la", "the", "eau", "un")


def _run(spark: SparkSession, sf: str, shift: int) -> DataFrame:
    """All assistant turns as answers of one run; the case is the conversation and a turn number."""
    rows = table(spark, sf, "conversations").where("role = 'assistant'")
    return rows.select(
        F.concat_ws("-", "conv_id", F.col("turn") - shift).alias("id"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("mode"),
        F.lit("").alias("prompt"), F.col("text").alias("answer"))


@query(f"""
WITH {HEAD} SELECT coalesce(mode, 'overall') AS slice, round_even(avg((verdict = 'A')::INT::DOUBLE) * 100, 1) AS a_win_pct,
  round_even(avg((verdict = 'tie')::INT::DOUBLE) * 100, 1) AS tie_pct, round_even(avg((verdict = 'B')::INT::DOUBLE) * 100, 1) AS b_win_pct,
  count(*) AS n FROM v GROUP BY ROLLUP (mode)""")
def head_to_head(spark: SparkSession, sf: str) -> DataFrame:
    """JO2, TX21, AG12, SI6: every assistant turn against the next one, by the offline judge."""
    pairs = rubric.head_to_head(_run(spark, sf, 0), _run(spark, sf, 2))
    a = rubric.heuristic_score(F.col("answer_a"), MARKS)
    b = rubric.heuristic_score(F.col("answer_b"), MARKS)
    judged = pairs.withColumns({"a": a, "b": b}).select(
        "id", "mode", rubric.heuristic_vote(F.col("a"), F.col("b")).alias("vote"))
    return rubric.percent_table(rubric.win_rates(rubric.majority(judged, ("id", "mode"))))


@query(f"""
SELECT conv_id, turn, round(least(5::DOUBLE, greatest(1::DOUBLE, 1 + len({WS.format("text")}) / 20::DOUBLE + 0.5::DOUBLE * (
  contains(lower(text), 'la')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'eau')::INT + contains(lower(text), 'un')::INT))), 6) AS score,
  least(5, 1 + contains(lower(text), 'la')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'eau')::INT + contains(lower(text), 'un')::INT)::DOUBLE AS tone
FROM conversations WHERE role = 'assistant'""")
def heuristic_judge(spark: SparkSession, sf: str) -> DataFrame:
    """TX21: offline scores of answers."""
    rows = table(spark, sf, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.round(rubric.heuristic_score(F.col("text"), MARKS), 6).alias("score"),
                       rubric.tone_score(F.col("text"), MARKS).cast("double").alias("tone"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 3 THEN 3::DOUBLE WHEN 2 THEN 3::DOUBLE
    ELSE least(5::DOUBLE, greatest(1::DOUBLE, floor(value) / 4)) END AS tone,
  CASE WHEN event_id % 4 = 0 AND value < 10 THEN 'A' WHEN event_id % 4 = 0 AND value < 20 THEN 'B' ELSE 'tie' END AS winner FROM events""")
def judge_parse(spark: SparkSession, sf: str) -> DataFrame:
    """TX22, TX23: judge replies with noise, missing values, broken and trailing text."""
    i, v = F.col("event_id"), F.col("value")
    number = (F.floor(v) / 4).cast("string")
    won = F.when(v < 10, " a ").when(v < 20, "B").otherwise("none")
    reply = (
        F.when(i % 4 == 0, F.concat(F.lit('Sure: {"tone": '), number, F.lit(', "winner": "'), won, F.lit('"} ok')))
        .when(i % 4 == 1, F.concat(F.lit('{"tone": "'), number, F.lit('"}')))
        .when(i % 4 == 2, F.lit('{"tone": 5} and {"tone": 1}')).otherwise("no verdict")
    )
    rows = table(spark, sf, "events").select("event_id", A.judge_json(reply).alias("j"))
    return rows.select("event_id", A.judge_score(F.col("j"), "tone").alias("tone"),
                       A.judge_winner(F.col("j")).alias("winner"))


@query("""
SELECT event_type, count(*) AS n, round_even(quantile_cont(value, 0.5), 4) AS p50,
       round_even(quantile_cont(value, 0.95), 4) AS p95, round_even(avg(value), 4) AS mean FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """AG13, PR19: exact percentiles per group."""
    return logs.latency_summary(table(spark, sf, "events"), "value", ("event_type",))


@query("""
SELECT count(*) AS n, round_even(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
       round_even(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round_even(avg(l_extendedprice), 4) AS mean FROM lineitem""")
def latency_overall(spark: SparkSession, sf: str) -> DataFrame:
    """AG13: exact percentiles over all rows."""
    return logs.latency_summary(table(spark, sf, "lineitem"), "l_extendedprice")


@query("""
SELECT p_brand, count(*) AS n, floor(quantile_cont(p_size, 0.5))::BIGINT AS median FROM part GROUP BY p_brand""")
def median_floor(spark: SparkSession, sf: str) -> DataFrame:
    """AG14: medians of whole numbers, rounded down."""
    return logs.median_floor(table(spark, sf, "part"), "p_size", ("p_brand",))


PRICE_SQL = """CASE WHEN contains(p_brand, 'Brand#1') THEN 0.15::DOUBLE WHEN contains(p_brand, 'Brand#') AND contains(p_brand, '2') THEN 2.5::DOUBLE ELSE 0::DOUBLE END"""
PRICE_LIST = (("Brand#1", 0.15, 0.60), ("2", 2.50, 10.00))


@query(f"""
WITH u AS (SELECT 'j' || (p_size % 3) AS judge, p_brand AS model, count(*) AS calls, sum(l_quantity::BIGINT) AS pin, sum(l_suppkey) AS pout
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
c AS (SELECT *, pin / 1e6::DOUBLE * {PRICE_SQL.replace("p_brand", "model")}
       + pout / 1e6::DOUBLE * CASE WHEN contains(model, 'Brand#1') THEN 0.6::DOUBLE WHEN contains(model, '2') THEN 10::DOUBLE ELSE 0::DOUBLE END AS usd FROM u)
SELECT coalesce(judge, 'total') AS judge, sum(calls)::BIGINT AS calls, sum(pin)::BIGINT AS prompt_tokens, sum(pout)::BIGINT AS completion_tokens,
  sum(pin + pout)::BIGINT AS total_tokens, round_even(sum(usd), 4) AS est_usd FROM c GROUP BY ROLLUP (judge)""")
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    """AG15, JO11: tokens and cost per judge, first matching price."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    calls = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("j"), (F.col("p_size") % 3).cast("string")).alias("judge"),
        F.col("p_brand").alias("model"), F.lit(1).alias("calls"),
        F.col("l_quantity").cast("long").alias("prompt_tokens"),
        F.col("l_suppkey").alias("completion_tokens"))
    return rubric.judge_usage(calls, PRICE_LIST)


@query("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 THEN l_quantity / l_tax ELSE 0 END, 6) AS tok_per_s,
  round(CASE WHEN l_quantity > 1 AND l_tax - l_discount > 0 THEN (l_quantity - 1) / (l_tax - l_discount) ELSE 0 END, 4) AS decode_tok_per_s,
  round(l_discount, 6) AS ttft FROM lineitem""")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    """TX30: guarded speed figures."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *N.speed(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")))
    return rows.select(
        "l_orderkey", "l_linenumber", F.round("tok_per_s", 6).alias("tok_per_s"),
        F.round("decode_tok_per_s", 4).alias("decode_tok_per_s"), F.round("ttft", 6).alias("ttft"))


KEYS = {"click": "loss", "view": "eval_loss", "purchase": "eval_rubric_avg", "error": "train_runtime"}
KEY_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KEYS.items()) + " ELSE 'epoch' END"
MERGED = f"""
m AS (SELECT user_id AS step, {KEY_SQL} AS key, arg_max(value, (epoch_us(ts), event_id)) AS value FROM events
      WHERE event_id % 7 <> 0 AND {KEY_SQL} <> 'train_runtime' GROUP BY ALL)
"""


def log_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Log entries derived from events; some values are not numbers."""
    key = None
    for kind, name in KEYS.items():
        test = F.col("event_type") == kind
        key = F.when(test, name) if key is None else key.when(test, name)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("step"), key.otherwise("epoch").alias("key"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.struct("ts", "event_id").alias("pos"))


@query(f"WITH {MERGED} SELECT step, key, round(value, 6) AS value FROM m")
def log_merge(spark: SparkSession, sf: str) -> DataFrame:
    """AG16: the last number per step and key, summary keys dropped."""
    return round6(logs.merge_log(log_entries(spark, sf)))


@query(f"""
WITH {MERGED} SELECT step, max(value) FILTER (WHERE key = 'epoch') AS epoch, max(value) FILTER (WHERE key = 'loss') AS loss,
  max(value) FILTER (WHERE key = 'eval_loss') AS eval_loss FROM m GROUP BY step""")
def curve_table(spark: SparkSession, sf: str) -> DataFrame:
    """AG16, SI5: one row per step."""
    return logs.curve_table(logs.merge_log(log_entries(spark, sf)), ("loss", "eval_loss", "epoch"))


@query(f"""
WITH {MERGED} SELECT count(DISTINCT step) AS steps, max(step) AS max_step,
  arg_min(value, step) FILTER (WHERE key = 'loss') AS first_loss, arg_max(value, step) FILTER (WHERE key = 'loss') AS last_loss,
  min(value) FILTER (WHERE key = 'eval_loss') AS best_eval_loss, arg_max(value, step) FILTER (WHERE key = 'eval_loss') AS last_eval_loss,
  max(value) FILTER (WHERE key = 'eval_rubric_avg') AS best_rubric FROM m""")
def training_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AG17: first, last and best values."""
    return logs.training_summary(logs.merge_log(log_entries(spark, sf)))


@query("""
WITH f AS (SELECT 'run' || (o_custkey % 50) AS run, 'p' || o_orderkey AS path, CASE WHEN o_orderkey % 40 <> 0 THEN o_orderkey % 1000 END AS step FROM orders)
SELECT run, path, step FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY (step IS NULL) DESC, coalesce(step, -1) DESC, path DESC) = 1""")
def best_log(spark: SparkSession, sf: str) -> DataFrame:
    """WI8: the most complete log file of each run."""
    k = F.col("o_orderkey")
    files = table(spark, sf, "orders").select(
        F.concat(F.lit("run"), (F.col("o_custkey") % 50).cast("string")).alias("run"),
        F.concat(F.lit("p"), k.cast("string")).alias("path"), F.when(k % 40 != 0, k % 1000).alias("step"))
    return logs.best_log(files)


@query("""SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND role = 'assistant' ORDER BY conv_id, turn LIMIT 25""")
def answered_subset(spark: SparkSession, sf: str) -> DataFrame:
    """FI7, TK4: the first k rows with a reference, in a stated order (the limit is the feature)."""
    from sparkcurate.functions.text import is_blank

    rows = table(spark, sf, "conversations").where("role = 'assistant'").where(~is_blank(F.col("text")))
    return rows.select("conv_id", "turn").orderBy("conv_id", "turn").limit(25)


@query("""
SELECT u.conv_id, u.turn, length(a.text) AS n FROM conversations u
JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def mock_answers(spark: SparkSession, sf: str) -> DataFrame:
    """GE13: replayed references, filled in where missing."""
    from sparkcurate.operators.generate import mock_answers as replay

    pairs = turns.next_turns(table(spark, sf, "conversations"), "conv_id").withColumn(
        "id", F.struct("conv_id", "turn"))
    missing = F.col("conv_id") % 2 == 0
    cases = pairs.select("id", F.when(missing, F.lit("")).otherwise(F.col("answer")).alias("reference"))
    built = pairs.select("id", "answer")
    out = replay(cases, built)
    return out.select("id.conv_id", "id.turn", F.length("answer").alias("n"))


@query("""
SELECT g, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
FROM (SELECT CASE WHEN user_id % 4 <> 0 THEN event_type END AS g, value FROM events) GROUP BY g""")
def latency_null_group(spark: SparkSession, sf: str) -> DataFrame:
    """AG13: percentiles of a group column with nulls; they are a group of their own."""
    from sparkcurate.operators import order

    rows = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 4 != 0, F.col("event_type")).alias("g"), "value")
    found = order.exact_percentiles(rows, "value", (0.5, 0.95), ("g",))
    return found.select("g", "n", F.round("p0", 6).alias("p50"), F.round("p1", 6).alias("p95"))


@query("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, 0 AS off_50, 0 AS off_95
FROM events GROUP BY event_type""")
def latency_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """AG13: sketches stored by type and day and merged by type; how many error bounds their percentiles are off."""
    from sparkcurate.operators import order, sketches
    from sparkcurate.session import fresh_path

    rows = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    path = fresh_path(spark, "sketches")
    sketches.store_sketches(sketches.quantile_sketches(rows, "value", ("event_type", "day")), path, ("day",))
    merged = sketches.merged_sketches(spark.read.parquet(path), ("event_type",))
    found = sketches.sketched_percentiles(merged, (0.5, 0.95), ("event_type",))
    error = 2 * sketches.rank_error() + 0.01  # and one row, as the exact ones lie between two: a group has 100 or more
    ends = [f + s * error for f in (0.5, 0.95) for s in (-1, 1)]
    exact = order.exact_percentiles(rows, "value", ends, ("event_type",)).select("event_type", *[
        F.col(f"p{i}").alias(f"e{i}") for i in range(4)])

    def off(p: str, low: str, high: str) -> Column:
        return F.when((F.col(p) < F.col(low)) | (F.col(p) > F.col(high)), 1).otherwise(0)

    return found.join(exact, "event_type").select(
        "event_type", "n", F.round("mean", 6).alias("mean"), "low", "high", off("p0", "e0", "e1").alias("off_50"),
        off("p1", "e2", "e3").alias("off_95"))
