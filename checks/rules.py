"""The rule verdict on answers derived from whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import ORACLES, query, round6, table
from checks.texts import (
    NORM,
    SIGNATURES,
    detected_sql,
    grounded_sql,
    tokens_sql,
)
from sparkcurate.functions import text as X
from sparkcurate.functions.chat import think_block
from sparkcurate.operators import kpi, lookup
from sparkcurate.operators import rules as R
from sparkcurate.operators.generate import package_json
from sparkcurate.session import pin

LABELS, ABSTAIN = ("ALPHA", "BETA", "GAMMA"), "UNDECIDED"
BOOK = R.RuleBook(
    labels=LABELS, abstain=ABSTAIN, signatures=SIGNATURES,
    runbooks={name: {
        "runbook_id": f"RB-{name}", "owner_team": f"Team {name}", "support_contact": "desk",
        "escalation": "on call", "severity": "S2", "priority": "P1"} for name in LABELS},
    sub_causes={name: {"sub1": "S3"} for name in LABELS},
)


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """One model answer per document with faults fixed by the document number."""
    i, text = F.col("doc_id"), F.col("text")
    none = F.lit(None).cast("string")
    label = F.get(X.strings((*LABELS, ABSTAIN, "OMEGA")), (i % 5).cast("int"))

    def steps(*numbers: int) -> Column:
        return F.array(*[F.struct(
            F.lit(n).alias("tier"), F.lit("restart").alias("action"), F.lit("it works").alias("verify"),
            F.lit("next").alias("if_fails")) for n in numbers])

    # The quoted evidence is the last line of the text.
    quote = F.element_at(F.split("text", "\n"), -1)
    package = F.struct(
        F.struct(
            label.alias("leading_root_cause"),
            F.when(i % 13 != 0, (i % 100) / 100.0).alias("confidence"),
            F.when(i % 3 == 0, F.array(quote, F.lit("entirely invented claim of nothing")))
            .when(i % 3 == 1, F.array(quote)).otherwise(X.strings(()))
            .alias("evidence_in_ticket"),
            F.when(i % 10 == 0, "sub1").when(i % 10 == 1, "nope").alias("sub_cause"),
        ).alias("diagnosis"),
        F.when(i % 11 == 0, "RB-WRONG").when(i % 5 < 3, F.concat(F.lit("RB-"), label))
        .when((i % 5 == 3) & (i % 4 == 0), "RB-ALPHA").alias("runbook_id"),
        F.concat(F.lit("Team "), label).alias("owner_team"), F.lit("desk").alias("support_contact"),
        F.lit(" on call ").alias("escalation"), X.strings(("look",)).alias("fix_steps"),
        F.lit("soon").alias("eta_ttr"),
        F.when(i % 2 == 0, "S2 - high").when(i % 7 == 0, "S4").otherwise("S3").alias("severity"),
        F.when(i % 19 == 0, "P2").otherwise("P1").alias("priority"),
        F.struct(F.lit("low").alias("level")).alias("churn_risk"),
        F.when(i % 12 != 0, F.struct(F.lit("a voucher").alias("offer"))).alias("compensation"),
        F.when(i % 6 == 0, steps(1, 2)).when(i % 25 == 0, steps(1, 3, 2)).otherwise(steps(1, 2, 3))
        .alias("customer_self_service"),
        F.struct(
            F.lit("r").alias("rca_md"), F.when(i % 14 == 0, "  ").otherwise("w").alias("work_order_md"),
            F.when(i % 9 == 0, "You get a Full Refund, guaranteed.").otherwise("Hello.")
            .alias("customer_email"), F.lit("d").alias("diagram_mermaid")).alias("artifacts"),
    )
    think = F.when(i % 7 == 0, "The webhook was delivered at T+28s.").otherwise("Plain reasoning.")
    full = think_block(think, package_json(package))
    answer = (
        F.when(i % 23 == 0, "no json here")
        .when(i % 29 == 0, F.substr(full, F.lit(1), F.length(full) - 5)).otherwise(full)
    )
    return table(spark, sf, "documents", "doc_id", "lang", "source", "text").select(
        i.alias("id"), F.col("lang").alias("slice"), F.col("source").alias("run"),
        text.alias("complaint"), answer.alias("answer"),
        F.get(X.strings((*LABELS, ABSTAIN)), (i % 4).cast("int")).alias("gold_rc"), none.alias("note"))


FACTS = f"""
n AS (SELECT doc_id AS i, lang, source, {NORM} AS norm, {NORM.replace("text", "string_split(text, chr(10))[-1]")} AS enorm,
        (['ALPHA', 'BETA', 'GAMMA', 'UNDECIDED', 'OMEGA'])[doc_id % 5 + 1] AS label,
        (['ALPHA', 'BETA', 'GAMMA', 'UNDECIDED'])[doc_id % 4 + 1] AS gold_rc,
        CASE WHEN doc_id % 13 <> 0 THEN (doc_id % 100) / 100::DOUBLE END AS conf,
        doc_id % 23 <> 0 AND doc_id % 29 <> 0 AS parsed FROM documents),
x AS (SELECT *, {detected_sql("norm")} AS detected, {tokens_sql("norm")} AS tok, {tokens_sql("enorm")} AS etok,
        {tokens_sql("'entirely invented claim of nothing'")} AS itok FROM n),
f AS (SELECT *, label IN ('ALPHA', 'BETA', 'GAMMA') AS concrete, {grounded_sql("etok", "tok")} AS g1, {grounded_sql("itok", "tok")} AS g2,
        i % 7 <> 0 OR i % 23 = 0 AS no_claims,
        CASE i % 3 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n_ev FROM x),
r AS (SELECT *, CASE n_ev WHEN 0 THEN 0 WHEN 1 THEN g1::INT ELSE g1::INT + g2::INT END AS n_ok,
        CASE WHEN label = 'UNDECIDED' THEN len(detected) <> 1 WHEN concrete THEN list_contains(detected, label) ELSE FALSE END AS cue,
        coalesce(conf <= CASE WHEN label = 'UNDECIDED' THEN 0.45::DOUBLE ELSE 0.85::DOUBLE END, FALSE) AS calibrated,
        i % 11 <> 0 AND i % 19 <> 0 AND (i % 2 = 0 OR i % 7 <> 0) AS copies,
        NOT (label = 'UNDECIDED' AND i % 4 = 0 AND i % 11 <> 0) AS routed,
        i % 10 > 1 OR (i % 10 = 0 AND concrete) AS sub_ok, i % 6 <> 0 AND i % 25 <> 0 AS ladder,
        i % 9 <> 0 AS no_promise FROM f),
v AS (SELECT *, CASE WHEN concrete THEN copies ELSE routed END AS runbook FROM r)
"""


@query(f"""
WITH {FACTS}
SELECT i AS id, parsed AND no_claims AND n_ok = n_ev AND cue AND calibrated AND runbook AND sub_ok AND ladder AND no_promise AS ok,
  CASE WHEN parsed THEN (NOT no_claims)::INT + (n_ok <> n_ev)::INT + (NOT cue)::INT + (NOT calibrated)::INT
     + (NOT runbook)::INT + (NOT sub_ok)::INT + (NOT ladder)::INT + (NOT no_promise)::INT ELSE 1 END AS n_failures,
  NOT parsed OR n_ok = n_ev AS cue_grounding, no_claims AS no_fabricated_telemetry, NOT parsed OR cue AS rc_cue_match,
  NOT parsed OR runbook AS runbook_fidelity, NOT parsed OR calibrated AS calibration,
  CASE WHEN parsed AND NOT no_claims THEN 'T+28s|delivered at|webhook was delivered' ELSE '' END AS hits
FROM v""")
def verdict_report(spark: SparkSession, sf: str) -> DataFrame:
    """TX3, TX7-TX17, JO3, JO5, JO7, JO8, FI2: the full verdict."""
    return verdict_columns(R.judge_answers(answers(spark, sf), BOOK))


def verdict_columns(judged: DataFrame) -> DataFrame:
    """The verdict as flat columns, failures counted."""
    v = "verdict."
    return judged.select(
        "id", v + "ok", F.size(v + "failures").alias("n_failures"),
        *[v + c for c in ("cue_grounding", "no_fabricated_telemetry", "rc_cue_match",
                          "runbook_fidelity", "calibration")],
        F.array_join(v + "telemetry_hits", "|").alias("hits"))


@query(f"""
WITH {FACTS}, t AS (SELECT v.*, string_split(d.text, chr(10))[-1] AS quote FROM v JOIN documents d ON doc_id = i),
u AS (SELECT *, list_filter(CASE n_ev WHEN 0 THEN [] WHEN 1 THEN [CASE WHEN NOT g1 THEN quote END]
    ELSE [CASE WHEN NOT g1 THEN quote END, CASE WHEN NOT g2 THEN 'entirely invented claim of nothing' END] END, lambda x: x IS NOT NULL) AS loose,
  list_filter([CASE WHEN i % 11 = 0 THEN 'runbook_id differs' END, CASE WHEN i % 2 = 1 AND i % 7 = 0 THEN 'severity is not allowed' END,
    CASE WHEN i % 19 = 0 THEN 'priority differs' END], lambda x: x IS NOT NULL) AS unlike FROM t)
SELECT i AS id, CASE WHEN NOT parsed THEN 'no JSON package in the answer' ELSE array_to_string(list_filter([
  CASE WHEN NOT no_claims THEN 'unsupported claims: T+28s; delivered at; webhook was delivered' END,
  CASE WHEN len(loose) > 0 THEN 'ungrounded evidence: ' || array_to_string(loose, '; ') END,
  CASE WHEN NOT cue THEN CASE WHEN label = 'OMEGA' THEN 'unknown label: ' || chr(39) || 'OMEGA' || chr(39)
    WHEN label = 'UNDECIDED' THEN 'abstained although exactly one label has a cue' ELSE 'no cue supports label ' || chr(39) || label || chr(39) END END,
  CASE WHEN NOT calibrated THEN CASE WHEN conf IS NULL THEN 'missing or invalid confidence'
    WHEN label = 'UNDECIDED' THEN 'confidence above 0.45' ELSE 'confidence above 0.85' END END,
  CASE WHEN NOT runbook THEN CASE WHEN concrete THEN 'runbook: ' || array_to_string(unlike, '; ') ELSE 'an abstention must not cite a runbook' END END,
  CASE WHEN NOT sub_ok THEN 'unknown sub cause: ' || CASE i % 10 WHEN 0 THEN 'sub1' ELSE 'nope' END END,
  CASE WHEN NOT ladder THEN 'self-service ladder is missing, short or misnumbered' END,
  CASE WHEN NOT no_promise THEN 'promises: Full Refund; guaranteed' END], lambda x: x IS NOT NULL), ' | ') END AS failures FROM u""")
def verdict_failures(spark: SparkSession, sf: str) -> DataFrame:
    """TX17, TX7, TX9, TX12, TX15: the reasons of every verdict in full."""
    judged = R.judge_answers(answers(spark, sf), BOOK)
    return judged.select("id", F.array_join("verdict.failures", " | ").alias("failures"))


@query("""
SELECT doc_id AS id, CASE WHEN doc_id % 9 < 8 THEN 'record was found' ELSE '' END AS claims, CASE WHEN doc_id % 4 < 3 THEN 'Full refund' ELSE '' END AS promises,
  md5(text) AS said FROM documents""")
def claim_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """TX10, TX8: a claim counts wherever an answer reasons, a promise wherever it reaches the customer; copied fields do not."""
    i = F.col("doc_id")
    claim, promise = F.lit("The record was found."), F.lit("Full refund for you.")

    def put(place: int, rest: Column | str = "fine") -> Column:
        return F.when(i % 9 == place, claim).otherwise(F.lit(rest) if isinstance(rest, str) else rest)

    def give(place: int) -> Column:
        return F.when(i % 4 == place, promise).otherwise(F.lit("thanks"))

    step = F.struct(F.lit(1).alias("tier"), F.concat_ws(" ", put(6), give(0)).alias("action"), put(7).alias("verify"), F.lit("call").alias("if_fails"))
    package = F.struct(
        F.struct(F.lit("ALPHA").alias("leading_root_cause"), F.lit(0.5).alias("confidence"), F.array(put(1, F.col("text"))).alias("evidence_in_ticket"),
                 F.array(put(2)).alias("to_confirm"), F.array(F.struct(F.lit("BETA").alias("rc"), F.lit("low").alias("likelihood"), put(3).alias("why")))
                 .alias("differential")).alias("diagnosis"),
        put(4).alias("why_plain"), put(5).alias("why_technical"), put(8).alias("owner_team"), give(3).alias("escalation"),
        F.struct(give(1).alias("offer")).alias("compensation"), F.array(step).alias("customer_self_service"),
        F.struct(give(2).alias("customer_email")).alias("artifacts"))
    rows = table(spark, sf, "documents", "doc_id", "text").select(i.alias("id"), F.md5("text").alias("said"),
                                                                 think_block(put(0), package_json(package)).alias("answer"))
    parsed = R.parse_answers(rows)
    claims = X.pattern_hits(R.reasoning_scope(F.col("think"), F.col("pkg")), (r"record was found",))
    promises = X.pattern_hits(R.customer_scope(F.col("pkg")), (r"Full refund",))
    return parsed.select("id", "said", F.array_join(claims, "|").alias("claims"), F.array_join(promises, "|").alias("promises"))


def rule_tables(spark: SparkSession, sf: str) -> R.RuleTables:
    """The rules of BOOK among a label per supplier that no document speaks of."""
    supplier = table(spark, sf, "supplier").select(F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string")).alias("label"), "s_name")
    known = spark.createDataFrame([(k, *[v[c] for c in ("runbook_id", *R.COPIED_FIELDS, "severity", "priority")])
                                   for k, v in BOOK.runbooks.items()],
                                  f"label string, runbook_id string, {', '.join(f'{c} string' for c in R.COPIED_FIELDS)}, severity string, priority string")
    books = known.unionByName(supplier.select(
        "label", F.concat(F.lit("RB-"), "label").alias("runbook_id"), *[F.col("s_name").alias(c) for c in R.COPIED_FIELDS],
        F.lit("S1").alias("severity"), F.lit("P3").alias("priority")))
    cues = spark.createDataFrame([(k, i, phrases) for k, groups in SIGNATURES.items() for i, phrases in enumerate(groups)],
                                 "label string, sig_id int, phrases array<string>")
    cues = cues.unionByName(supplier.select("label", F.lit(0).alias("sig_id"), F.array(
        X.normalise(F.col("s_name")), F.lit("q q"), F.lower("label")).alias("phrases")))
    subs = books.select("label", F.lit("sub1").alias("sub_cause"), F.lit("S3").alias("severity"))
    return R.RuleTables(books, cues, ABSTAIN, subs)


@query(ORACLES["verdict_report"])
def verdict_tables(spark: SparkSession, sf: str) -> DataFrame:
    """JO3, JO5, JO7, JO8: the full verdict with rules looked up in tables."""
    return verdict_columns(R.judge_answers(answers(spark, sf), rule_tables(spark, sf)))


@query(f"""
WITH {FACTS} SELECT i AS id FROM v WHERE parsed AND no_claims AND n_ok = n_ev AND label IN ('ALPHA', 'BETA', 'GAMMA', 'UNDECIDED')
  AND calibrated AND runbook AND sub_ok AND ladder AND no_promise""")
def accepted_trusted(spark: SparkSession, sf: str) -> DataFrame:
    """FI2, TX16: the gate with the author's label trusted."""
    judged = R.judge_answers(answers(spark, sf), BOOK, trust_label=True)
    return R.accept(judged).select("id")


SAMPLE_SQL = """
s AS (SELECT i AS id, lang AS slice, source AS run, gold_rc, CASE WHEN parsed THEN label ELSE 'PARSE_FAIL' END AS pred_rc,
  parsed AND label = gold_rc AS correct, CASE WHEN parsed THEN conf END AS confidence,
  round(CASE WHEN NOT parsed THEN 0 WHEN n_ev = 0 THEN 1 ELSE n_ok / n_ev::DOUBLE END, 6) AS cue_grounded_frac,
  no_claims AS no_fabricated_telemetry,
  parsed AND CASE WHEN concrete THEN i % 12 <> 0 ELSE label = 'UNDECIDED' END AS runbook_complete,
  parsed AND CASE WHEN concrete THEN copies ELSE label = 'UNDECIDED' END AS runbook_fidelity,
  parsed AND i % 14 <> 0 AS artifacts_valid, parsed AND ladder AS self_service_ok,
  CASE WHEN parsed AND NOT no_claims THEN 'T+28s; delivered at; webhook was delivered' ELSE '' END AS telemetry_hits
FROM v)
"""


@query(f"WITH {FACTS}, {SAMPLE_SQL} SELECT * EXCLUDE (run) FROM s")
def score_samples(spark: SparkSession, sf: str) -> DataFrame:
    """TX18, TX19, TX12-TX14: the per-answer fact row."""
    scored = R.score_samples(R.judge_answers(answers(spark, sf), BOOK), BOOK)
    return round6(scored.withColumn("telemetry_hits", F.array_join("telemetry_hits", "; ")))


@query(f"""
WITH {FACTS}, {SAMPLE_SQL}
SELECT slice, count(*) AS n, round(avg(correct::INT::DOUBLE), 6) AS rc_accuracy,
  round(avg(cue_grounded_frac), 4) AS cue_faithfulness,
  round(avg(no_fabricated_telemetry::INT::DOUBLE), 6) AS no_fabrication_rate,
  round(coalesce(avg((pred_rc <> 'UNDECIDED')::INT::DOUBLE) FILTER (WHERE gold_rc = 'UNDECIDED'), 0), 6) AS abstention_hallucination,
  round(avg((pred_rc = 'PARSE_FAIL')::INT::DOUBLE), 6) AS parse_fail_rate
FROM s GROUP BY slice""")
def answer_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """AG4 on parsed and judged answers, end to end."""
    facts = R.score_samples(R.judge_answers(answers(spark, sf), BOOK), BOOK)
    report = kpi.kpi_report(facts, LABELS, ABSTAIN, ("slice",))
    return report.select(
        "slice", "n", F.round("rc_accuracy", 6).alias("rc_accuracy"),
        F.round("cue_faithfulness", 4).alias("cue_faithfulness"),
        *[F.round(c, 6).alias(c) for c in (
            "no_fabrication_rate", "abstention_hallucination", "parse_fail_rate")])


@query("""
SELECT doc_id AS id, doc_id % 6 <> 0 AND doc_id % 25 <> 0 AS ladder_ok,
       doc_id % 12 <> 0 AS complete FROM documents WHERE doc_id % 23 <> 0 AND doc_id % 29 <> 0 AND doc_id % 5 < 3""")
def package_checks(spark: SparkSession, sf: str) -> DataFrame:
    """TX10, TX11, TX13: ladder and completeness of parsed packages of concrete labels."""
    parsed = R.parse_answers(answers(spark, sf)).where("parse_ok")
    rows = parsed.where(F.col("pkg.diagnosis.leading_root_cause").isin(*LABELS))
    return rows.select("id", R.ladder_ok(F.col("pkg.customer_self_service")).alias("ladder_ok"),
                       R.package_complete(F.col("loose")).alias("complete"))


@query(f"""
WITH {FACTS}, s AS (SELECT i, CASE WHEN parsed THEN label ELSE 'PARSE_FAIL' END AS label_a,
  CASE WHEN len(detected) = 1 THEN detected[1] ELSE 'UNDECIDED' END AS label_b FROM v)
SELECT i AS id, label_a, label_b FROM s WHERE label_a <> label_b""")
def rule_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    """JO13: answers whose label differs from what the cues say."""
    from sparkcurate.operators.retrieval import disagreements

    rows = answers(spark, sf)
    a = R.score_samples(R.judge_answers(rows, BOOK), BOOK).select("id", "pred_rc")
    found = X.detect_labels(F.col("norm"), SIGNATURES)
    b = pin(rows.select("id", X.normalise(F.col("complaint")).alias("norm")))
    b = pin(b.select("id", found.alias("d")))
    b = b.select("id", F.when(F.size("d") == 1, F.get("d", F.lit(0))).otherwise(ABSTAIN).alias("pred_rc"))
    return disagreements(a, b, "id")


@query("""
WITH books AS (SELECT n_name AS label, 'S' || (n_nationkey % 3 + 1) AS severity, 'base ' || n_name AS why, n_regionkey AS r FROM nation),
subs AS (SELECT n_name AS label, 'late' AS sub_cause, 'S' || (n_nationkey % 4 + 1) AS severity, 'sub ' || n_name AS why
         FROM nation WHERE n_nationkey % 2 = 0),
t AS (SELECT s_suppkey, n_name AS label, CASE s_suppkey % 3 WHEN 0 THEN 'late' WHEN 1 THEN 'lost' ELSE '' END AS sub_cause
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT t.s_suppkey, t.label, t.sub_cause, coalesce(s.severity, b.severity) AS severity, coalesce(s.why, b.why) AS why_technical,
       t.sub_cause <> '' AND s.label IS NULL AS invalid
FROM t LEFT JOIN books b USING (label) LEFT JOIN subs s USING (label, sub_cause)""")
def sub_cause_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """JO3, JO4, JO5: runbook values with sub-cause overrides; unknown sub causes."""
    nation = table(spark, sf, "nation")
    key = F.col("n_nationkey")
    books = nation.select(F.col("n_name").alias("label"), F.concat(F.lit("S"), (key % 3 + 1).cast("string"))
                          .alias("severity"), F.concat(F.lit("base "), "n_name").alias("why_technical"))
    subs = nation.where(key % 2 == 0).select(
        F.col("n_name").alias("label"), F.lit("late").alias("sub_cause"),
        F.concat(F.lit("S"), (key % 4 + 1).cast("string")).alias("severity"),
        F.concat(F.lit("sub "), "n_name").alias("why_technical"))
    pick = F.col("s_suppkey") % 3
    rows = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == key).select(
        "s_suppkey", F.col("n_name").alias("label"),
        F.when(pick == 0, "late").when(pick == 1, "lost").otherwise("").alias("sub_cause"))
    bad = lookup.invalid_sub_causes(rows, subs).select("s_suppkey", F.lit(True).alias("invalid"))
    full = lookup.resolve_sub_cause(rows, books, subs)
    return full.join(bad, "s_suppkey", "left").withColumn(
        "invalid", F.coalesce("invalid", F.lit(False)))


@query("""
WITH books AS (SELECT n_name AS label, 'S' || (n_nationkey % 3 + 1) AS severity FROM nation),
subs AS (SELECT n_name AS label, 'S' || (n_nationkey % 4 + 1) AS severity FROM nation WHERE n_nationkey % 2 = 0),
a AS (SELECT label, severity FROM books UNION SELECT label, severity FROM subs)
SELECT c.c_custkey, bool_or(starts_with('S' || (c_custkey % 4 + 1) || ' - seen', a.severity)) AS allowed
FROM customer c JOIN nation n ON c_nationkey = n_nationkey JOIN a ON a.label = n.n_name GROUP BY c.c_custkey""")
def allowed_severity(spark: SparkSession, sf: str) -> DataFrame:
    """JO8: prefix match against the severities of a label and its sub causes."""
    nation = table(spark, sf, "nation")
    key, name = F.col("n_nationkey"), F.col("n_name").alias("label")
    books = nation.select(name, F.concat(F.lit("S"), (key % 3 + 1).cast("string")).alias("severity"))
    subs = nation.where(key % 2 == 0).select(
        name, F.concat(F.lit("S"), (key % 4 + 1).cast("string")).alias("severity"))
    allowed = lookup.allowed_severities(books, subs)
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == key).select(
        "c_custkey", name, F.concat(F.lit("S"), (F.col("c_custkey") % 4 + 1).cast("string"),
                                    F.lit(" - seen")).alias("severity"))
    joined = lookup.attach(rows, allowed)
    return joined.select("c_custkey", lookup.severity_allowed(
        F.col("severity"), F.col("allowed")).alias("allowed"))


