"""Verdicts, KPIs, rubric, votes, percentiles, logs, retrieval, lookups."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sparkcurate.operators import catalog, kpi, logs, lookup, order, retrieval, rubric, validate
from sparkcurate.operators import rules as R
from sparkcurate.plans import evaluate
from sparkcurate.plans.example_domain import ABSTAIN, BOOK
from sparkcurate.schemas import SAMPLE

L = F.lit


def facts(spark, rows):
    names = ("id", "slice", "gold_rc", "pred_rc", "correct", "confidence", "cue_grounded_frac")
    data = [(*r, *([True] * 5), "") for r in rows]
    assert len(names) + 6 == 13
    return spark.createDataFrame(data, SAMPLE)


def test_kpis_have_their_own_denominators(spark):
    df = facts(spark, [
        ("1", "a", "X", "X", True, 0.9, 1.0), ("2", "a", "X", "Y", False, 0.95, 0.5),
        ("3", "b", "NO", "PARSE_FAIL", False, None, 0.0), ("4", "b", "NO", "NO", True, 0.3, 1.0),
        ("5", "b", "NO", "WEIRD", False, 0.85, 1.0),
    ])
    k = kpi.kpi_report(df, ("X", "Y"), "NO").first()
    assert (k.n, k.rc_accuracy, k.rc_accuracy_clear) == (5, 0.4, 0.5)
    assert k.abstention_hallucination == pytest.approx(2 / 3)
    assert k.overconfident_wrong_rate == 0.2 and k.parse_fail_rate == 0.2
    assert k.runbook_completeness == 1.0 and k.cue_faithfulness == pytest.approx(0.7)
    # bins 9: {.9 right, .95 wrong}, 3: {.3 right}, 8: {.85 wrong}
    assert k.ece == pytest.approx((abs(0.9 - 1 + 0.95) + abs(0.3 - 1) + 0.85) / 4)
    empty = kpi.kpi_report(df.where("false"), ("X", "Y"), "NO").first()
    assert empty.n == 0 and empty.ece == 0.0 and empty.rc_accuracy == 0.0
    matrix = {(r.gold, r.pred): r.n for r in kpi.confusion_matrix(df, ("X", "Y"), "NO").collect()}
    assert matrix[("NO", "WEIRD")] == 1 and matrix[("Y", "X")] == 0 and len(matrix) == 13


def test_ece_edges(spark):
    df = facts(spark, [("1", "a", "X", "X", True, 1.0, 1.0), ("2", "a", "X", "X", True, -0.2, 1.0)])
    assert kpi.kpi_report(df, ("X",), "NO").first().ece == pytest.approx(1.2 / 2)


def test_leaderboard_and_delta(spark):
    runs = spark.createDataFrame(
        [("b", 0.5, 1.0), ("a", 0.5, 1.0), ("c", None, None), ("d", 0.9, 0.1)],
        "run STRING, rc_accuracy_clear DOUBLE, no_fabrication_rate DOUBLE")
    assert [r.run for r in kpi.leaderboard(runs).orderBy("rank").collect()] == ["d", "a", "b", "c"]
    scores = spark.createDataFrame(
        [("r1", "m", 1.0), ("r2", "m", 4.0), ("r3", "m", 6.5), ("r3", "n", 2.0)],
        "run STRING, mode STRING, score DOUBLE")
    got = {r.mode: r.delta for r in kpi.previous_delta(scores, "run", "mode", "score", "r3").collect()}
    assert got == {"m": 2.5, "n": None}


def sample_scores(spark, rows):
    criteria = list(rubric.WEIGHTS)
    data = [(s, m, "j", c, float(v)) for s, m, v in rows for c in criteria]
    return spark.createDataFrame(data, "sample_id STRING, mode STRING, judge STRING, criterion STRING, score DOUBLE")


def test_rubric_summary(spark):
    scores = sample_scores(spark, [("1", "comparison", 4), ("2", "comparison", 4), ("3", "intent", 2)])
    summary = rubric.summarise_by_mode(rubric.case_scores(scores, list(rubric.WEIGHTS)))
    got = {r.mode: r for r in summary.collect()}
    assert got["comparison"].score_10 == pytest.approx(7.5)
    assert got["intent"].score_10 == pytest.approx(2.5)
    assert got["overall"].score_5 == pytest.approx(10 / 3) and got["overall"].n == 3
    none = rubric.summarise_by_mode(rubric.case_scores(scores.where("false"), list(rubric.WEIGHTS))).collect()
    assert [(r.mode, r.n, r.score_5, r.score_10) for r in none] == [("overall", 0, 0.0, -2.5)]
    with pytest.raises(ValueError, match="no positive weight"):
        rubric.weighted_mean({"tone": L(1.0)}, {"tone": 0.0})


def test_judges_and_votes(spark):
    two = spark.createDataFrame(
        [("1", "a", 4.0), ("1", "b", 2.0), ("2", "a", 5.0)], "sample_id STRING, judge STRING, score DOUBLE")
    spread = {r.sample_id: r.spread for r in rubric.judge_spread(two).collect()}
    assert spread == {"1": 2.0, "2": 0.0}
    verdicts = spark.createDataFrame([("m", v) for v in ("A", "A", "B", "tie")], "mode STRING, verdict STRING")
    got = {r.mode: (r.win, r.tie, r.loss, r.n) for r in rubric.win_rates(verdicts).collect()}
    assert got == {"overall": (0.5, 0.25, 0.25, 4), "m": (0.5, 0.25, 0.25, 4)}
    none = rubric.win_rates(verdicts.where("false")).collect()
    assert [(r.mode, r.win, r.n) for r in none] == [("overall", 0.0, 0)]
    votes = spark.createDataFrame(
        [("1", "A"), ("1", "A"), ("1", "B"), ("2", "A"), ("2", "B"), ("3", "tie")], "id STRING, vote STRING")
    assert {r.id: r.verdict for r in rubric.majority(votes, ("id",)).collect()} == {
        "1": "A", "2": "tie", "3": "tie"}


def test_cost_takes_the_first_price(spark):
    calls = spark.createDataFrame(
        [("gpt", "gpt-4o-2024", 1, 400, 200)] + [("gpt", "gpt-4o-2024", 1, 300, 150)] * 2
        + [("mini", "gpt-4o-mini", 1, 1_000_000, 0), ("free", "mock", 2, 10, 10)],
        "judge STRING, model STRING, calls LONG, prompt_tokens LONG, completion_tokens LONG")
    got = {r.judge: r for r in rubric.judge_usage(calls).collect()}
    assert (got["gpt"].calls, got["gpt"].total_tokens) == (3, 1500) and got["gpt"].est_usd == 0.0075
    assert got["mini"].est_usd == 0.15 and got["free"].est_usd == 0.0
    assert got["total"].est_usd == pytest.approx(0.1575)


def test_denied_judge(spark):
    df = spark.createDataFrame([("GPT",), ("DeepSeek",)], "judge STRING")
    assert validate.deny_judges(df.limit(1), rubric.DENIED_JUDGES).count() == 1
    with pytest.raises(Exception, match="not allowed"):
        validate.deny_judges(df, rubric.DENIED_JUDGES).collect()


def percentile(values, q):
    values, rank = sorted(values), q * (len(values) - 1)
    low = math.floor(rank)
    high = math.ceil(rank)
    return values[low] + (values[high] - values[low]) * (rank - low)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 1000, 20_011])
def test_exact_percentiles(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 5), 1.0, -3.5]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE").repartition(5)
    row = order.exact_percentiles(df, "v", (0.0, 0.5, 0.95, 1.0)).first()
    assert row.n == n and row.mean == pytest.approx(statistics.fmean(values))
    for got, q in zip((row.p0, row.p1, row.p2, row.p3), (0.0, 0.5, 0.95, 1.0), strict=True):
        assert got == pytest.approx(percentile(values, q), abs=1e-12)


def test_latency_summary(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,)], "v DOUBLE")
    row = logs.latency_summary(df, "v").first()
    assert (row.n, row.p50, row.mean) == (4, 0.25, 0.25)
    none = logs.latency_summary(df.where("false"), "v").collect()
    assert [tuple(r) for r in none] == [(0, 0.0, 0.0, 0.0)]
    whole = spark.createDataFrame([("a", 3), ("a", 6), ("b", 5)], "k STRING, v INT")
    assert {r.k: r.median for r in logs.median_floor(whole, "v", ("k",)).collect()} == {"a": 4, "b": 5}


def test_numbering_and_totals(spark):
    df = spark.range(0, 5000, 3).withColumn("g", (F.col("id") % 2)).repartition(7)
    rows = order.number_rows(df, "id", "no", 100).orderBy("id").collect()
    assert [r.no for r in rows] == list(range(1, len(rows) + 1))
    by = order.number_rows(df, "id", "no", 50, ("g",)).groupBy("g").agg(
        F.max("no").alias("m"), F.count_distinct("no").alias("d"), F.count("*").alias("n")).collect()
    assert all(r.m == r.d == r.n for r in by)
    sums = order.running_total(df, ["g"], "id", F.col("id"), "t", 40).orderBy("id").collect()
    seen = {0: 0, 1: 0}
    for r in sums:
        assert r.t == seen[r.g]
        seen[r.g] += r.id


def test_log_merge(spark):
    entries = spark.createDataFrame([
        (10, "loss", 2.0, 0), (10, "eval_loss", 1.5, 1), (20, "loss", 1.0, 2), (20, "loss", 0.9, 3),
        (20, "train_runtime", 99.0, 4), (20, "flag", None, 5), (20, "eval_rubric_avg", 3.3, 6)],
        "step LONG, key STRING, value DOUBLE, pos INT")
    merged = logs.merge_log(entries)
    table = logs.curve_table(merged, ("eval_loss", "loss", "zeta", "alpha"))
    assert table.columns == ["step", "loss", "eval_loss", "alpha", "zeta"]
    assert {r.step: (r.loss, r.eval_loss) for r in table.collect()} == {10: (2.0, 1.5), 20: (0.9, None)}
    s = logs.training_summary(merged).first()
    assert (s.steps, s.max_step, s.first_loss, s.last_loss) == (2, 20, 2.0, 0.9)
    assert (s.best_eval_loss, s.last_eval_loss, s.best_rubric) == (1.5, 1.5, 3.3)


def brute_force(docs, queries):
    import collections
    import re

    tokens = {d: re.findall("[a-z0-9]+", t.lower()) for d, t in docs.items()}
    df = collections.Counter(w for t in tokens.values() for w in set(t))
    idf = {w: math.log((1 + len(docs)) / (1 + c)) + 1 for w, c in df.items()}

    def vector(words):
        tf = collections.Counter(words)
        return {w: n * idf.get(w, 0.0) for w, n in tf.items()}

    vectors = {d: vector(t) for d, t in tokens.items()}

    def cosine(a, b):
        dot = sum(v * b.get(w, 0.0) for w, v in a.items())
        na, nb = (math.sqrt(sum(v * v for v in x.values())) for x in (a, b))
        return dot / (na * nb) if na and nb else 0.0

    out = {}
    for q, text in queries.items():
        v = vector(re.findall("[a-z0-9]+", text.lower()))
        scores = {d: round(cosine(v, w), 6) for d, w in vectors.items()}
        best = max(scores.values())
        out[q] = (min(d for d, s in scores.items() if s == best), best)
    return out


@pytest.mark.parametrize("hot_limit", [1_000_000, 20])
def test_nearest_equals_brute_force(spark, hot_limit):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]

    def text(n):
        return " ".join(["the"] * 2 + rng.choices(vocabulary, weights, k=n))

    docs = {i: text(rng.randint(1, 25)) for i in range(120)}
    docs[50] = docs[20]  # an exact copy: the first one wins
    queries = {i: text(rng.randint(0, 12)) for i in range(40)}
    queries.update({100: "unknown terms only", 101: "", 102: docs[50], 103: "the"})
    corpus = spark.createDataFrame(list(docs.items()), "doc_id LONG, text STRING")
    asked = spark.createDataFrame(list(queries.items()), "q_id LONG, text STRING")
    index = retrieval.build_index(corpus, "doc_id", "text", hot_limit)
    assert index.hot_limit == (20 if hot_limit == 20 else None)
    got = {r.q_id: (r.doc, r.score) for r in retrieval.nearest(asked, "q_id", "text", index).collect()}
    want = brute_force(docs, queries)
    assert {q: d for q, (d, _) in got.items()} == {q: d for q, (d, _) in want.items()}
    for q, (_, score) in want.items():
        assert got[q][1] == pytest.approx(score, abs=1.1e-6)


def answer(**changes):
    import json

    package = {
        "diagnosis": {"leading_root_cause": "SYNC_STALLED", "confidence": 0.7,
                      "evidence_in_ticket": ["reader in airplane mode"], "to_confirm": []},
        "runbook_id": "RB-SYNC", "owner_team": "Sync Team", "support_contact": "sync desk",
        "escalation": "Sync on-call", "severity": "S3", "priority": "P3", "fix_steps": ["x"],
        "eta_ttr": "1 h", "churn_risk": {"level": "low"}, "compensation": {"offer": "none"},
        "customer_self_service": [{"tier": i, "action": "a"} for i in (1, 2, 3)],
        "artifacts": {k: "t" for k in ("rca_md", "work_order_md", "customer_email", "diagram_mermaid")},
    }
    diagnosis = changes.pop("diagnosis", {})
    package.update(changes)
    package["diagnosis"].update(diagnosis)
    return "<think>ok</think>" + json.dumps(package)


TICKET = "My reader was in airplane mode all week"
VERDICTS = [
    ("fine", TICKET, answer(), None),
    ("unparsed", TICKET, "<think>delivered at noon</think> none", "no JSON package"),
    ("claims", TICKET, answer(why_plain="the record was found"), "unsupported claims: record was found"),
    ("evidence", TICKET, answer(diagnosis={"evidence_in_ticket": ["screen is cracked badly"]}), "ungrounded"),
    ("cue", "no words that matter", answer(diagnosis={"evidence_in_ticket": []}), "no cue supports"),
    ("unknown", TICKET, answer(diagnosis={"leading_root_cause": "ELSE"}, runbook_id=None), "unknown label"),
    ("sure", TICKET, answer(diagnosis={"confidence": 0.86}), "confidence above 0.85"),
    ("text", TICKET, answer(diagnosis={"confidence": "0.5"}), None),
    ("none", TICKET, answer(diagnosis={"confidence": "high"}), "missing or invalid confidence"),
    ("owner", TICKET, answer(owner_team="Other"), "owner_team differs"),
    ("severity", TICKET, answer(severity="S4 low"), None),
    ("bad severity", TICKET, answer(severity="S1"), "severity is not allowed"),
    ("sub", TICKET, answer(diagnosis={"sub_cause": "radio_off"}), None),
    ("bad sub", TICKET, answer(diagnosis={"sub_cause": "clock_skew"}), "unknown sub cause"),
    ("ladder", TICKET, answer(customer_self_service=[{"tier": 1, "action": "a"}] * 3), "ladder"),
    ("promise", TICKET, answer(compensation={"offer": "full refund"}), "promises: full refund"),
    ("abstain", TICKET, answer(diagnosis={"leading_root_cause": ABSTAIN, "confidence": 0.3}, runbook_id=None),
     "abstained"),
    ("abstain id", "odd", answer(diagnosis={"leading_root_cause": ABSTAIN, "confidence": 0.3,
                                            "evidence_in_ticket": []}), "must not cite"),
    ("abstain ok", "odd", answer(diagnosis={"leading_root_cause": ABSTAIN, "confidence": 0.3,
                                            "evidence_in_ticket": []}, runbook_id=None), None),
    ("two cues", "airplane mode, borrowed", answer(diagnosis={
        "leading_root_cause": ABSTAIN, "confidence": 0.45, "evidence_in_ticket": []}, runbook_id=None), None),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([v[:3] for v in VERDICTS], "id STRING, complaint STRING, answer STRING")
    got = {r.id: r.verdict for r in R.judge_answers(rows, BOOK).select("id", "verdict").collect()}
    for name, _, _, reason in VERDICTS:
        v = got[name]
        assert v.ok == (reason is None), (name, v.failures)
        assert reason is None or (len(v.failures) == 1 and reason in v.failures[0]), (name, v.failures)
    assert got["unparsed"].no_fabricated_telemetry is False
    trusted = R.judge_answers(rows.where("id = 'cue'"), BOOK, trust_label=True)
    assert trusted.first().verdict.ok


def test_samples_and_runs(spark, tmp_path):
    gold = spark.createDataFrame(
        [("1", "s", TICKET, "SYNC_STALLED"), ("2", "s", "odd", ABSTAIN)],
        "id STRING, slice STRING, complaint STRING, gold_rc STRING")
    answers = spark.createDataFrame(
        [("r1", "1", answer()), ("r1", "2", "broken"), ("r2", "2", answer(artifacts={"rca_md": "x"})),
         ("r2", "1", "<think>T+28s</think>{}")], "run STRING, id STRING, answer STRING")
    facts_df = evaluate.fact_table(gold, answers, BOOK)
    got = {(r.run, r.id): r for r in facts_df.collect()}
    good, broken, wrong, empty = (got[k] for k in (("r1", "1"), ("r1", "2"), ("r2", "2"), ("r2", "1")))
    assert good.correct and good.runbook_complete and good.runbook_fidelity and good.artifacts_valid
    assert broken.pred_rc == "PARSE_FAIL" and broken.cue_grounded_frac == 0.0 and not broken.artifacts_valid
    assert wrong.pred_rc == "SYNC_STALLED" and not wrong.artifacts_valid and wrong.cue_grounded_frac == 0.0
    assert empty.pred_rc == "PARSE_FAIL" and empty.cue_grounded_frac == 1.0
    assert not empty.no_fabricated_telemetry and empty.telemetry_hits == ["T+28s"]
    board = [r.run for r in evaluate.compare_runs(facts_df, BOOK).orderBy("rank").collect()]
    assert board == ["r1", "r2"]
    evaluate.write_run(facts_df, BOOK, str(tmp_path))
    report = {r.run: r for r in spark.read.json(str(tmp_path / "report")).collect()}
    assert report["r1"].n == 2 and report["r1"].per_slice_accuracy.s == 0.5
    from sparkcurate.sources.readers import read_fact_csv
    assert read_fact_csv(spark, str(tmp_path / "per_sample")).where("telemetry_hits = 'T+28s'").count() == 1


def test_book_from_tables(spark):
    books = spark.createDataFrame([
        (k, *[v[c] for c in ("runbook_id", "owner_team", "support_contact", "escalation", "severity", "priority")])
        for k, v in BOOK.runbooks.items()],
        "label STRING, runbook_id STRING, owner_team STRING, support_contact STRING, escalation STRING, severity STRING, priority STRING")
    cues = spark.createDataFrame([
        (k, i, p) for k, groups in BOOK.signatures.items() for i, p in enumerate(groups)],
        "label STRING, sig_id INT, phrases ARRAY<STRING>")
    subs = spark.createDataFrame([
        (k, s, v) for k, m in BOOK.sub_causes.items() for s, v in m.items()],
        "label STRING, sub_cause STRING, severity STRING")
    built = R.RuleBook.from_tables(books, cues, ABSTAIN, subs)
    rows = spark.createDataFrame([v[:3] for v in VERDICTS], "id STRING, complaint STRING, answer STRING")
    got = {r.id: r.verdict.ok for r in R.judge_answers(rows, built).collect()}
    assert got == {name: reason is None for name, _, _, reason in VERDICTS}


def test_catalog(spark):
    rows = [("X", "X 1", 128, 10, "red", " Còn hàng", None, 1), ("X", "X 1", 128, 11_990_000, "blue", "hết", None, 0),
            ("X", "X 1", 128, 10, "red", "hết", None, 2), ("Y", "Y 2", 64, None, "", "hết", "Ngừng kinh doanh", 3),
            ("Z", "Z 3", None, None, None, "", "", 4)]
    products = spark.createDataFrame(
        rows, "series STRING, name STRING, storage_gb LONG, price LONG, color STRING, availability STRING, crawl_note STRING, pos LONG"
    ).withColumn("chip", F.concat(L("c"), F.col("pos"))).withColumn("screen_inch", L(6.1)).withColumn(
        "camera_main_mp", L(48)).withColumn("warranty_months", L(12))
    specs = ("chip", "screen_inch", "camera_main_mp", "warranty_months")
    groups = catalog.catalog_groups(products, specs)
    got = {r.series: r for r in groups.collect()}
    assert got["X"].prices == [10, 11_990_000] and got["X"].colors == ["blue", "red"]
    assert got["X"].available and got["X"].chip == "c0" and got["X"].price_label == "10đ–11.990.000đ"
    assert got["Y"].colors == [] and got["Y"].price_label == catalog.NO_PRICE
    assert [r.series for r in catalog.by_price(groups).collect()] == ["Y", "Z", "X"]
    assert {r.series for r in catalog.matching(products).collect()} == {"X", "Z"}
    assert catalog.matching(products, "x 1", 128).count() == 3
    line = catalog.catalog_line(groups).where("series = 'X'").first().line
    assert line == '- X 128GB — 10đ–11.990.000đ — c0, 6.1", camera chính 48MP — màu: blue/red — còn hàng (BH 12 tháng)'


def test_lookups(spark):
    ladder = spark.range(1).select(lookup.numbered_ladder(F.array(*[
        F.struct(L(a).alias("action"), L("g").alias("addresses"), L("1").alias("expected_time"), L("v").alias("verify"))
        for a in ("x", "y")])).alias("l")).first().l
    assert [(s.tier, s.if_fails) for s in ladder] == [(1, "go to step 2"), (2, "a specialist takes over")]
    matrix = spark.createDataFrame([("EU", "car", ["a", "b"])], "region STRING, vehicle STRING, plans ARRAY<STRING>")
    asked = spark.createDataFrame([("EU", "car", "a"), ("EU", "car", "z")], "region STRING, vehicle STRING, plan STRING")
    assert {r.plan: r.eligible for r in lookup.eligibility(asked, matrix).collect()} == {"a": True, "z": False}


def test_null_groups_are_groups(spark):
    rows = [(i, (None, "a", "b")[i % 3], float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "i long, g string, v double")
    found = {r.g: (r.n, r.p0) for r in order.exact_percentiles(df, "v", (0.5,), ("g",)).collect()}
    assert found == {None: (10, 13.5), "a": (10, 14.5), "b": (10, 15.5)}
    numbers = order.number_rows(df, "i", "no", 7, ("g",)).collect()
    assert sorted(r.no for r in numbers if r.g is None) == list(range(1, 11))
    before = order.running_total(df, ("g",), "i", df["v"], "t", 7).collect()
    assert max(r.t for r in before if r.g is None) == sum(range(0, 27, 3))


def test_json_lines_hold_one_object(one):
    from sparkcurate.functions import answers

    good = ['{"a": 1}', ' {"a": {"b": [1, 2]}} ', '{"a": "}, \\"x\\": {"}']
    bad = ['{"id":"1"}, "x": {"b":2}', '{"id":"5"},"y":1', '{"a":1}{"b":2}', '{"a":1}],[{"b":2}', '[{"a":1}]', '"a"', "",
           '{"a":1', "null", None]
    from pyspark.sql import functions as F
    for text in good + bad:
        row = one(x=answers.whole_json(F.lit(text).cast("string")))
        assert (row.x is not None) == (text in good), text
