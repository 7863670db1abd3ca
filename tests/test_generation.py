"""Generated records, pairs, gold sets, streaming jobs."""

import pytest
from pyspark.sql import functions as F

from sparkcurate.operators import generate as G
from sparkcurate.operators.preference import FAULTS, preference_examples
from sparkcurate.operators.rules import judge_answers
from sparkcurate.operators.validate import check_records
from sparkcurate.plans import build, evaluate
from sparkcurate.plans.example_domain import ABSTAIN, BOOK, KIT
from sparkcurate.session import fresh_path, pin, shared_dir, small_side
from sparkcurate.streaming import jobs

MODES = ("sync", "licence", "region", "abstention", "knowledge", "differential", "distractor")


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([
        (0, "SYNC_STALLED", "The shelf is old and the train had no reception", ["train had no reception"],
         "No reception, so it cannot fetch.", 0.66, None),
        (1, "REGION_BLOCKED", "Since the move nothing opens", [], "The move is the only change.", 0.55,
         ("high", "third call")),
        (2, ABSTAIN, "Odd.", [], "Nothing to go by.", 0.35, None),
    ], "seq LONG, label STRING, complaint STRING, evidence ARRAY<STRING>, think STRING, confidence DOUBLE, "
       "churn_override STRUCT<level: STRING, why: STRING>")


def test_chat_dataset(spark, seeds):
    facts = spark.createDataFrame([(0, "Who owns it?", "We do."), (1, "What now?", "Wait.")],
                                  "pos LONG, question STRING, answer STRING")
    rows = build.chat_dataset(spark, KIT, 42, 46, seeds, facts).persist()
    got = {r.mode: r.n for r in rows.groupBy("mode").agg(F.count("*").alias("n")).collect()}
    assert got["knowledge"] == 12 and got["differential"] == 7 and got["distractor"] == 5
    assert got["abstention"] == 4 and got["sync"] + got["licence"] + got["region"] == 18
    assert check_records(_wide(rows), MODES).where("NOT valid").isEmpty()
    assert rows.select("id").distinct().count() == rows.count()
    again = build.chat_dataset(spark, KIT, 42, 46, seeds, facts)
    assert again.select("id", "messages").exceptAll(rows.select("id", "messages")).isEmpty()
    chats = rows.where("mode NOT IN ('knowledge') AND source IS NULL").select(
        F.col("messages")[1]["content"].alias("complaint"), F.col("messages")[2]["content"].alias("answer"))
    assert judge_answers(chats, BOOK).where("NOT verdict.ok").isEmpty()
    written = rows.where("source = 'authored' AND mode = 'region'").first()
    assert '"churn_risk":{"level":"high","why":"third call"}' in written.messages[2].content


def _wide(rows):
    spark = rows.sparkSession
    from sparkcurate.schemas import RECORD
    return spark.createDataFrame([], RECORD).unionByName(rows, allowMissingColumns=True)


def test_bad_seed_fails_the_job(spark, seeds):
    bad = seeds.withColumn("think", F.lit("The record was found."))
    with pytest.raises(Exception, match="rejected seed"):
        build.authored_records(bad, KIT).collect()


def test_preference_dataset(spark):
    rows = build.preference_dataset(spark, KIT, 7, 3).persist()
    got = {r.bad_type: r.n for r in rows.groupBy("bad_type").agg(F.count("*").alias("n")).collect()}
    assert got == {f: 3 for f in FAULTS}
    assert check_records(_wide(rows), MODES).where("NOT valid").isEmpty()
    ticket = F.col("prompt")[1]["content"].alias("complaint")
    chosen = rows.select(ticket, F.col("chosen")[0]["content"].alias("answer"))
    assert judge_answers(chosen, BOOK).where("NOT verdict.ok").isEmpty()
    missing = rows.where("bad_type = 'missing_fields'").select(F.col("rejected")[0]["content"].alias("t"))
    assert missing.where(F.col("t").contains("churn_risk") | F.col("t").contains("compensation")).isEmpty()
    assert preference_examples(rows).where("chosen = rejected").isEmpty()


def test_replayed_gold_is_perfect(spark):
    gold = build.gold_dataset(spark, KIT, 999, 40).persist()
    labels = {r.leading_root_cause: r.n for r in gold.groupBy("leading_root_cause").agg(
        F.count("*").alias("n")).collect()}
    assert labels == {label: 10 for label in BOOK.all_labels}
    cases = gold.select("id", F.col("mode").alias("slice"), F.col("messages")[0]["content"].alias("complaint"),
                        F.col("leading_root_cause").alias("gold_rc"))
    answers = gold.select(F.lit("replay").alias("run"), "id", F.col("reference").alias("answer"))
    report = evaluate.run_reports(evaluate.fact_table(cases, answers, BOOK), BOOK).first()
    assert report.rc_accuracy == 1.0 and report.abstention_hallucination == 0.0
    assert report.cue_faithfulness >= 0.95


def test_draws_ignore_partitions(spark):
    rows = spark.range(200).withColumnRenamed("id", "attempt").withColumn(
        "label", G.cycled_label(BOOK.labels, F.col("attempt")))
    a = G.build_cases(rows.repartition(1), KIT, 3).select("attempt", "answer", "complaint")
    b = G.build_cases(rows.repartition(64), KIT, 3).select("attempt", "answer", "complaint")
    assert a.exceptAll(b).isEmpty()
    styles = {r.style: r.n for r in G.draw_cases(rows, KIT, 3).groupBy("style").agg(F.count("*").alias("n")).collect()}
    assert set(styles) == {"clean", "selfcorrect", "multihop"} and styles["clean"] > 80


def test_sub_cause_and_classifier(spark):
    rows = spark.createDataFrame([(1, "SYNC_STALLED", "radio_off")], "attempt LONG, label STRING, sub_cause STRING")
    package = G.with_package(G.draw_cases(rows, KIT, 1), KIT).first().package
    assert package.customer_self_service[-1].action == "Ask us for a radio check of the device."
    tickets = spark.createDataFrame([
        ("1", "It was borrowed. What now?"), ("2", "Just odd."), ("3", "Borrowed in airplane mode.")],
        "id STRING, complaint STRING")
    made = G.classify_tickets(tickets, KIT)
    got = {r.id: r for r in judge_answers(made.select("id", "complaint", "answer"), BOOK).collect()}
    assert {i: r.label for i, r in got.items()} == {"1": "LICENCE_LAPSED", "2": ABSTAIN, "3": ABSTAIN}
    assert all(r.verdict.ok for r in got.values()) and got["1"].evidence == ["It was borrowed"]


def test_too_few_accepted(spark):
    rows = spark.range(5).select(F.col("id").alias("attempt"), F.struct((F.col("id") > 3).alias("ok")).alias("verdict"))
    assert G.first_accepted(rows, 1).first().seq == 0
    with pytest.raises(ValueError, match="too few"):
        G.first_accepted(rows, 2)


def test_cycle(spark):
    pairs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos LONG, v STRING")
    rows = G.cycle_to(pairs, "pos", 8).orderBy("seq").collect()
    assert [(r.seq, r.v) for r in rows] == [(i, "abc"[i % 3]) for i in range(8)]
    assert G.cycle_to(pairs, "pos", 2).count() == 2


def test_small_side_and_pin(spark):
    assert small_side(spark.range(5), 10).count() == 5
    big = spark.range(50)
    assert small_side(big, 10) is big
    rows = pin(spark.range(10).withColumn("x", F.md5(F.col("id").cast("string")))).where("x > '8'")
    assert 0 < rows.count() < 10
    assert shared_dir(spark) == shared_dir(spark)


def test_gate_stream_equals_batch_and_survives_a_restart(spark):
    gold = build.gold_dataset(spark, KIT, 5, 12)
    rows = gold.select("id", F.col("messages")[0]["content"].alias("complaint"),
                       F.when(F.col("id") < "eval-00004", F.lit("no json")).otherwise(F.col("reference")).alias("answer"))
    source, good, bad, state = (fresh_path(spark, n) for n in ("in", "good", "bad", "state"))
    rows.write.parquet(source)
    schema = rows.schema
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.gate(stream, BOOK, good, bad, state).awaitTermination()
    batch = judge_answers(spark.read.parquet(source), BOOK)
    assert spark.read.parquet(good).count() == batch.where("verdict.ok").count() == 8
    held = spark.read.parquet(bad).collect()
    assert len(held) == 4 and all("no JSON" in r.failures[0] for r in held)


def test_latency_stream(spark, tmp_path):
    from sparkcurate.sources.readers import read_latency_log

    (tmp_path / "log").mkdir()
    lines = [f"2024-05-0{d} 10:0{i}:00\tadapter=a\ttokens=5\tttft={t}s\ttok_per_s=1.00\tx"
             for d in (1, 2, 3) for i, t in enumerate(("0.100", "0.200", "0.300", "0.400"))]
    (tmp_path / "log" / "a.tsv").write_text("\n".join(lines) + "\n")
    stream = read_latency_log(spark, str(tmp_path / "log"), stream=True)
    windows = jobs.latency_counts(stream, "ts", "adapter", "ttft")
    out = fresh_path(spark, "lat")
    jobs.to_table(windows, out, fresh_path(spark, "lat-state")).awaitTermination()
    rows = jobs.latency_windows(spark.read.parquet(out)).orderBy("start").collect()
    assert [(r.start.day, r.n, round(r.p50, 4)) for r in rows] == [(1, 4, 0.25), (2, 4, 0.25)]


def test_repeated_answers_are_judged_once(spark):
    from sparkcurate.operators.rules import judge_answers, judge_repeated
    from sparkcurate.plans.example_domain import BOOK, KIT

    attempts = spark.createDataFrame([(n % 2, BOOK.labels[0]) for n in range(40)], "attempt long, label string")
    rows = G.build_cases(attempts, KIT, 7).select("complaint", "answer").unionByName(
        spark.createDataFrame([("none", None)] * 3, "complaint string, answer string"))
    got = judge_repeated(rows, BOOK).select("complaint", "times", "verdict.ok").collect()
    assert sorted((r.times, r.ok) for r in got) == [(3, False), (20, True), (20, True)]
    assert sum(r.times for r in got if r.ok) == judge_answers(rows, BOOK).where("verdict.ok").count()
