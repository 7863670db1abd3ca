"""Generation jobs, one attempt per row of a driver table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from sparkcurate.functions import draw as D
from sparkcurate.operators import generate as G
from sparkcurate.operators import lookup, order
from sparkcurate.operators import preference as P
from sparkcurate.operators.rules import judge_answers, judge_repeated
from sparkcurate.plans import build
from sparkcurate.plans.example_domain import ABSTAIN, BOOK, KIT
from sparkcurate.session import cut_lineage

SEED = 42


def _lit(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _u(name: str) -> str:
    """SQL of a uniform draw."""
    return f"(('0x' || substring(md5('{SEED}:' || i || ':{name}'), 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _by_label(values: dict) -> str:
    return "CASE label " + " ".join(
        f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _shuffle(items: str, name: str) -> str:
    return (f"list_transform(list_sort(list_transform({items}, lambda x, p: "
            f"{{'d': md5('{SEED}:' || i || ':{name}:' || (p - 1)), 'v': x}})), lambda x: x.v)")


LABELS = BOOK.labels
CASES = f"""
a AS (SELECT event_id AS i, ({_lit(LABELS)})[event_id % {len(LABELS)} + 1] AS label FROM events),
b AS (SELECT *, floor({_u("k")} * 2)::INT + 2 AS k, {_by_label({k: _lit(s for s, _ in v) for k, v in KIT.cues.items()})} AS s,
  {_by_label({k: _lit(e for _, e in v) for k, v in KIT.cues.items()})} AS e FROM a),
r AS (SELECT *, ({_shuffle("[2, 3]", "rest")})[1:k - 1] AS rest FROM b),
o AS (SELECT *, {_shuffle("list_concat([1], rest)", "order")} AS ord FROM r),
c AS (SELECT *, replace(replace({_by_label({k: "'" + v + "'" for k, v in KIT.openers.items()})}, '{{feature}}',
    ({_lit(KIT.features)})[floor({_u("feature")} * {len(KIT.features)})::INT + 1]), '{{time}}',
    ({_lit(KIT.times)})[floor({_u("time")} * {len(KIT.times)})::INT + 1]) || ' ' || array_to_string(list_transform(ord, lambda x: s[x]), ' ') AS complaint,
  array_to_string(list_transform(ord, lambda x: e[x]), '; ') AS evidence,
  least(0.82::DOUBLE, 0.55::DOUBLE + 0.09::DOUBLE * k + ({_u("confidence")} * 0.06::DOUBLE - 0.03::DOUBLE)) AS confidence,
  CASE WHEN {_u("style")} < 0.55 THEN 'clean' WHEN {_u("style")} < 0.77 THEN 'selfcorrect' ELSE 'multihop' END AS style FROM o)
"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """One attempt per event, labels in turn."""
    rows = table(spark, sf, "events", "event_id").select(F.col("event_id").alias("attempt"))
    return rows.withColumn("label", G.cycled_label(LABELS, F.col("attempt")))


@query(f"""
WITH {CASES} SELECT i AS attempt, label, complaint, evidence, style, round(confidence, 2) AS confidence FROM c""")
def generated_cases(spark: SparkSession, sf: str) -> DataFrame:
    """GE1, GE4, WI6: drawn tickets, evidence, styles and confidences."""
    cases = G.draw_cases(attempts(spark, sf), KIT, SEED)
    return cases.select("attempt", "label", "complaint", F.array_join("evidence", "; ").alias("evidence"),
                        "style", F.round("confidence", 2).alias("confidence"))


@query(f"""
WITH a AS (SELECT event_id AS i, event_id AS attempt FROM events)
SELECT attempt, CASE WHEN {_u("kind")} < 0.5 THEN ({_lit(KIT.vague)})[floor({_u("vague")} * {len(KIT.vague)})::INT + 1]
  ELSE ({_lit(KIT.off_catalogue)})[floor({_u("off")} * {len(KIT.off_catalogue)})::INT + 1] END AS complaint,
  array_to_string(({_shuffle(_lit(LABELS), "pair")})[1:2], '|') AS pair FROM a""")
def generated_abstentions(spark: SparkSession, sf: str) -> DataFrame:
    """GE2: vague and off-catalogue tickets."""
    cases = G.draw_abstentions(attempts(spark, sf).drop("label"), KIT, SEED)
    pair = F.array_join(F.transform("differential", lambda d: d["rc"]), "|")
    return cases.select("attempt", "complaint", pair.alias("pair"))


def _times(flag: str) -> Column:
    """How many of the repeated rows have a flag."""
    return F.sum(F.when(F.col(flag), F.col("times")).otherwise(0))


@query(f"""
SELECT ({_lit(LABELS)})[event_id % {len(LABELS)} + 1] AS label, count(*) AS n, count(*) AS accepted,
       count(*) AS grounded FROM events GROUP BY ALL""")
def accepted_cases(spark: SparkSession, sf: str) -> DataFrame:
    """GE3, GE5, GE15, PR12, FI2: packages assembled from runbooks pass every rule."""
    cases = G.build_cases(attempts(spark, sf), KIT, SEED)
    judged = judge_repeated(cases.select(F.col("label").alias("want"), "complaint", "answer"), BOOK)
    return judged.groupBy(F.col("want").alias("label")).agg(
        F.sum("times").alias("n"), _times("verdict.ok").alias("accepted"), _times("cue_grounding").alias("grounded"))


@query("""
WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq
           FROM events WHERE value < 20)
SELECT event_type, event_id, seq, 'sft-cr-' || lpad(seq::VARCHAR, 5, '0') AS id FROM n""")
def numbered_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """GE5, PR11: accepted rows numbered per group without a sort of the whole group."""
    rows = table(spark, sf, "events").where("value < 20").select("event_type", "event_id")
    numbered = order.number_rows(rows, "event_id", "no", 1000, ("event_type",))
    return numbered.select("event_type", "event_id", (F.col("no") - 1).alias("seq"),
                           G.record_id("sft-cr", F.col("no") - 1).alias("id"))


@query(f"""
WITH w AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) - 1 AS p, count(*) OVER () AS g FROM documents GROUP BY lang),
a AS (SELECT lang, n, idx, idx * g + p AS i FROM w, LATERAL (SELECT unnest(range(n * 5 + 300)) AS idx)),
k AS (SELECT lang, n, i AS attempt, row_number() OVER (PARTITION BY lang ORDER BY idx) - 1 AS seq FROM a WHERE {_u("spoil")} >= 0.6)
SELECT lang, attempt, seq FROM k WHERE seq < n""")
def filled_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """GE3, GE5: as many accepted cases per language as it has documents, from attempts of which six in ten are spoilt."""
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    wanted = {r["lang"]: r["n"] for r in counts.orderBy("lang").collect()}
    key = F.col("attempt")

    def judged(rows: DataFrame) -> DataFrame:
        cases = G.build_cases(rows.withColumn("label", G.cycled_label(LABELS, F.col("index"))), KIT, SEED)
        spoilt = F.when(D.uniform(SEED, key, "spoil") < 0.6, F.lit("no package")).otherwise(F.col("answer"))
        return judge_answers(cases.select("attempt", "lang", "complaint", spoilt.alias("answer")), BOOK)

    return G.fill_quotas(spark, wanted, judged, "lang").select("lang", "attempt", "seq")


BROKEN = {"cue_dropped": 1, "fabricated_telemetry": 1, "overconfident": 1, "missing_fields": 0,
          "forced_guess": 1, "overpromise": 1, "single_path": 1}


@query(f"""
WITH a AS (SELECT ({_lit(P.FAULTS)})[event_id % {len(P.FAULTS)} + 1] AS bad_type FROM events),
b(bad_type, broken) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in BROKEN.items())})
SELECT bad_type, count(*) AS n, count(*) AS chosen_ok, sum(broken)::BIGINT AS rejected_bad, count(*) AS differ
FROM a JOIN b USING (bad_type) GROUP BY bad_type""")
def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """GE9: every pair has an accepted answer and one with its fault; only the fault of missing
    fields is one of completeness and passes the rules."""
    key = F.col("attempt")
    rows = attempts(spark, sf).withColumn("bad_type", G.cycled_label(P.FAULTS, key))
    rows = rows.withColumn("label", F.when(F.col("bad_type") == "forced_guess", ABSTAIN).otherwise(F.col("label")))
    pairs = P.corrupt(G.build_cases(rows, KIT, SEED), KIT, SEED)
    # Equal pairs are judged once.
    pairs = cut_lineage(pairs.groupBy("bad_type", "complaint", "chosen_text", "rejected_text").agg(
        F.count(F.lit(1)).alias("times")).withColumn("pair", F.monotonically_increasing_id()))
    sides = pairs.select("pair", "bad_type", "times", "complaint", (F.col("chosen_text") != F.col("rejected_text")).alias("differ"), F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("chosen_text").alias("answer")),
        F.struct(F.lit("rejected").alias("side"), F.col("rejected_text").alias("answer")))).alias("s"))
    judged = judge_answers(sides.select("pair", "bad_type", "times", "complaint", "differ", "s.side", "s.answer"), BOOK)
    per_pair = judged.groupBy("pair", "bad_type", "times", "differ").agg(
        F.bool_or((F.col("side") == "chosen") & F.col("verdict.ok")).alias("chosen_ok"),
        F.bool_or((F.col("side") == "rejected") & ~F.col("verdict.ok")).alias("rejected_bad"))
    return per_pair.groupBy("bad_type").agg(
        F.sum("times").alias("n"), *[_times(c).alias(c) for c in ("chosen_ok", "rejected_bad", "differ")])


@query("""
WITH p AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS chosen FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, chosen, CASE (conv_id + turn) % 3 WHEN 0 THEN reverse(chosen) WHEN 1 THEN chosen || ' ' || prompt
  ELSE prompt END AS rejected FROM p""")
def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """GE9, PR8: pairs from neighbouring turns, one corruption per row."""
    from sparkcurate.operators import turns

    pairs = turns.next_turns(table(spark, sf, "conversations"), "conv_id")
    kind = (F.col("conv_id") + F.col("turn")) % 3
    rejected = (F.when(kind == 0, F.reverse("answer")).when(kind == 1, F.concat_ws(" ", "answer", "prompt"))
                .otherwise(F.col("prompt")))
    return pairs.select("conv_id", "turn", F.col("answer").alias("chosen"), rejected.alias("rejected"))


RUNBOOK_SQL = """
b AS (SELECT p_partkey AS i, 'L' || p_partkey AS label, 'RB-' || p_partkey AS runbook_id, p_name AS title, p_brand AS owner_team,
  p_type AS support_contact, 'chief' AS escalation, 'S' || (p_size % 4) AS severity, 'P1' AS priority, p_size || ' h' AS eta_ttr FROM part)
"""


def runbooks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as runbooks."""
    k = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("i"), F.concat(F.lit("L"), k).alias("label"),
        F.concat(F.lit("RB-"), k).alias("runbook_id"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("owner_team"), F.col("p_type").alias("support_contact"),
        F.lit("chief").alias("escalation"),
        F.concat(F.lit("S"), (F.col("p_size") % 4).cast("string")).alias("severity"),
        F.lit("P1").alias("priority"), F.concat(F.col("p_size").cast("string"), F.lit(" h")).alias("eta_ttr"))


#: Five of an invented domain's facts; the answer's slots are runbook fields.
FEW_FACTS = {
    "time": ("When is {title} solved?", "After {eta_ttr}."),
    "owner": ("Whom does {runbook_id} belong to?", "{owner_team}, with {support_contact}, then {escalation}."),
    "rank": ("How urgent is {title}?", "{severity}, {priority}."),
    "page": ("Where is {title} written up?", "In {runbook_id}."),
    "cause": ("What is {runbook_id} about?", "{label}"),
}


def _slots(template: str) -> str:
    """SQL of a template."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"coalesce({p}, '')" if k % 2 else "'" + p.replace("'", "''") + "'" for k, p in enumerate(parts))


FEW_SQL = " UNION ALL ".join(f"SELECT label, '{fact}' AS fact, {_slots(ask)} AS question, {_slots(say)} AS answer FROM b"
                             for fact, (ask, say) in FEW_FACTS.items())


@query(f"""
WITH {RUNBOOK_SQL}, q AS ({FEW_SQL})
SELECT label, fact, variant, replace(replace(t, '{{ql}}', lower(question[1]) || question[2:]), '{{q}}', question) AS asked, answer
FROM q, (SELECT unnest({_lit(KIT.paraphrases)}) AS t, generate_subscripts({_lit(KIT.paraphrases)}, 1) - 1 AS variant) v""")
def knowledge_questions(spark: SparkSession, sf: str) -> DataFrame:
    """GE6: runbook facts, forward and reverse, in four paraphrases."""
    pairs = G.knowledge_pairs(G.templated_facts(runbooks(spark, sf), FEW_FACTS), KIT.paraphrases)
    return pairs.select("label", "fact", "variant", "asked", "answer")


@query("""
WITH n AS (SELECT count(*) AS n FROM benchmark), s AS (SELECT unnest(range((SELECT n * 5 // 2 FROM n))) AS seq)
SELECT seq, item_id FROM s JOIN benchmark ON item_id = seq % (SELECT n FROM n)""")
def cycled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """GE6: pairs repeated in turn up to a wanted number."""
    items = table(spark, sf, "benchmark").select("item_id")
    numbered = order.number_rows(items, "item_id", "no").withColumn("pos", F.col("no") - 1)
    return G.cycle_to(numbered, "pos", items.count() * 5 // 2).select("seq", "item_id")


@query(f"""
WITH {RUNBOOK_SQL}
SELECT label, '# ' || runbook_id || ' ' || title || chr(10) || owner_team || ', ' || severity || ', P1' || chr(10)
 || '## Use for' || chr(10) || title || '; ' || owner_team || '.' || chr(10) || '## Look at first' || chr(10) || '1. ' || support_contact || chr(10)
 || '## Do' || chr(10) || '1. ' || title || chr(10) || '2. ' || owner_team || chr(10) || '## Takes' || chr(10) || eta_ttr || chr(10)
 || '## Then ask' || chr(10) || 'chief' || chr(10) || '## May leave' || chr(10) || 'low, calm' || chr(10)
 || '## May get' || chr(10) || 'credit, ' || CASE WHEN i % 2 = 0 THEN 'unasked' ELSE 'on request' END || ', asked, once' AS document
FROM b""")
def runbook_documents(spark: SparkSession, sf: str) -> DataFrame:
    """GE14: runbooks rendered as pages."""
    rows = runbooks(spark, sf).select(
        "*", F.array("title", "owner_team").alias("detection_cues"),
        F.array("support_contact").alias("confirm_checks"), F.array("title", "owner_team").alias("fix_steps"),
        F.struct(F.lit("low").alias("level"), F.lit("calm").alias("why")).alias("churn_risk"),
        F.struct(F.lit("credit").alias("offer"), (F.col("i") % 2 == 0).alias("when_proactive"),
                 F.lit("asked").alias("escalate_if"), F.lit("once").alias("note")).alias("compensation_policy"))
    return lookup.runbook_document(rows, "\n".join((
        "# {runbook_id} {title}", "{owner_team}, {severity}, {priority}", "## Use for", "{detection_cues_prose}",
        "## Look at first", "{confirm_checks}", "## Do", "{fix_steps}", "## Takes", "{eta_ttr}", "## Then ask", "{escalation}",
        "## May leave", "{churn_risk_level}, {churn_risk_why}", "## May get",
        "{compensation_policy_offer}, {offered}, {compensation_policy_escalate_if}, {compensation_policy_note}")))


#: An invented domain's ways to ask and answer; the answer's slots are runbook fields.
FACTS = {
    "goodwill": ("What may a customer get when {title} strikes?", "They may get {compensation_policy_offer}, {offered}; beyond that: {compensation_policy_escalate_if}."),
    "leaving": ("Do customers leave over {title}?", "Risk {churn_risk_level}, as {churn_risk_why}."),
    "time": ("When is {title} solved?", "After {eta_ttr}."),
    "owner": ("Whom does {runbook_id} belong to?", "{owner_team}, with {support_contact}, then {escalation}."),
    "severity": ("How grave is {title}?", "{severity_note}, {priority}."),
    "steps": ("What is done about {title}?", "{fix_steps}"),
    "plain": ("Say simply where {title} comes from.", "{why_plain}"),
    "technical": ("Say precisely where {title} comes from.", "{why_technical}"),
    "cues": ("How does one recognise {title}?", "By this: {detection_cues_prose}"),
    "checks": ("What comes before acting on {title}?", "First: {confirm_checks_prose}"),
    "page": ("Where is {title} written up?", "In {runbook_id}, {title}."),
    "talk": ("How do we speak to customers about {title}?", "{customer_communication}"),
    "before": ("Has {title} happened before?", "Yes, {incident_id}: {incident_complaint} ({incident_cue}, {incident_ttr} min)."),
    "median": ("How long did past cases of {title} last?", "{median_ttr} min at the median of {incidents}."),
    "cause": ("What is {runbook_id} about?", "{label}: {one_line}"),
    "open": ("Which page do I open for {label}?", "{runbook_id} ({title})."),
}

PAGE = """{title} ({runbook_id})
{owner_team} / {severity_note} / {priority} / seen {last_reviewed}
In short: {summary}
Seen by: {detection_cues_prose}
Check:
{confirm_checks}
Do:
{fix_steps}
Takes {eta_ttr}, then {escalation}. Risk {churn_risk_level}: {churn_risk_why}.
Offer {compensation_policy_offer} {offered}; {compensation_policy_escalate_if}; {compensation_policy_note}.
Say: {customer_communication}"""

FIELDS_SQL = """
f AS (SELECT p_partkey AS i, 'L' || p_partkey AS label, 'RB-' || p_partkey AS runbook_id, p_name AS title, p_brand AS owner_team,
  p_type AS support_contact, 'chief' AS escalation, 'P1' AS priority, p_size || ' h' AS eta_ttr, 'S' || (p_size % 4) || ' by rule' AS severity_note,
  'on ' || p_size AS last_reviewed, 'sum ' || p_name AS summary, 'line ' || p_type AS one_line, 'plain ' || p_name AS why_plain, 'deep ' || p_type AS why_technical,
  'kindly ' || p_brand AS customer_communication, 'low' AS churn_risk_level, 'calm' AS churn_risk_why, 'credit' AS compensation_policy_offer,
  CASE WHEN p_partkey % 2 = 0 THEN 'unasked' ELSE 'on request' END AS offered, 'asked' AS compensation_policy_escalate_if, 'once' AS compensation_policy_note,
  '1. ' || p_name || chr(10) || '2. ' || p_brand AS fix_steps, p_name || '; ' || p_brand || '.' AS detection_cues_prose,
  '1. ' || p_type AS confirm_checks, p_type || '.' AS confirm_checks_prose FROM part),
t AS (SELECT 'L' || l_partkey AS label, l_orderkey * 10 + l_linenumber AS id, l_linestatus AS complaint, l_returnflag AS key_cue, l_quantity::BIGINT AS ttr_min FROM lineitem),
s AS (SELECT label, count(*)::VARCHAR AS incidents, floor(quantile_cont(ttr_min, 0.5))::BIGINT::VARCHAR AS median_ttr,
  min(id)::VARCHAR AS incident_id, arg_min(complaint, id) AS incident_complaint, arg_min(key_cue, id) AS incident_cue,
  arg_min(ttr_min, id)::VARCHAR AS incident_ttr FROM t GROUP BY label)
"""


def full_runbooks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as runbooks with every field."""
    return runbooks(spark, sf).select(
        "*", F.array("title", "owner_team").alias("detection_cues"),
        F.array("support_contact").alias("confirm_checks"), F.array("title", "owner_team").alias("fix_steps"),
        F.struct(F.lit("low").alias("level"), F.lit("calm").alias("why")).alias("churn_risk"),
        F.struct(F.lit("credit").alias("offer"), (F.col("i") % 2 == 0).alias("when_proactive"), F.lit("asked").alias("escalate_if"),
                 F.lit("once").alias("note")).alias("compensation_policy"),
        F.concat("severity", F.lit(" by rule")).alias("severity_note"), F.concat(F.lit("on "), F.split("eta_ttr", " ")[0]).alias("last_reviewed"),
        F.concat(F.lit("sum "), "title").alias("summary"), F.concat(F.lit("line "), "support_contact").alias("one_line"), F.concat(F.lit("plain "), "title").alias("why_plain"),
        F.concat(F.lit("deep "), "support_contact").alias("why_technical"), F.concat(F.lit("kindly "), "owner_team").alias("customer_communication"))


@query(f"WITH {FIELDS_SQL} " + " UNION ALL ".join(
    f"SELECT f.label, '{fact}' AS fact, {_slots(ask)} AS question, {_slots(say)} AS answer FROM f {'JOIN s USING (label)' if fact in ('before', 'median') else ''}"
    for fact, (ask, say) in FACTS.items()))
def runbook_answers(spark: SparkSession, sf: str) -> DataFrame:
    """GE6, AG14: sixteen kinds of facts per runbook, two of them from its incidents."""
    incidents = table(spark, sf, "lineitem").select(
        F.concat(F.lit("L"), F.col("l_partkey").cast("string")).alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_linestatus").alias("complaint"), F.col("l_returnflag").alias("key_cue"), F.col("l_quantity").cast("long").alias("ttr_min"))
    return G.templated_facts(full_runbooks(spark, sf), FACTS, incidents)


@query(f"WITH {FIELDS_SQL} SELECT label, {_slots(PAGE)} AS document FROM f")
def runbook_pages(spark: SparkSession, sf: str) -> DataFrame:
    """GE14: pages by a template of the domain, with summary, review, severity note and communication."""
    return lookup.runbook_document(full_runbooks(spark, sf), PAGE)


@query(f"""
WITH c AS (SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'ELSEWHERE' WHEN l.quality = 1 THEN ({_lit(LABELS)})[d.doc_id % {len(LABELS)} + 1] ELSE '{ABSTAIN}' END AS label
  FROM documents d JOIN labels l USING (doc_id))
SELECT 'hard-' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 5, '0') AS id, md5(text) AS prompt, label AS leading_root_cause,
  CASE label {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIT.slices.items())} ELSE '{KIT.slices[ABSTAIN]}' END AS mode, '' AS reference FROM c""")
def hard_cases(spark: SparkSession, sf: str) -> DataFrame:
    """GE10: hard gold cases from whole documents and their labels."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "ELSEWHERE").when(F.col("quality") == 1, G.cycled_label(LABELS, F.col("doc_id"))).otherwise(ABSTAIN)
    made = G.hard_records(rows.select(F.col("doc_id").alias("case"), F.col("text").alias("complaint"), label.alias("label")), KIT)
    return made.select("id", F.md5(F.col("messages")[0]["content"]).alias("prompt"), "leading_root_cause", "mode", "reference")


@query(f"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS seq, ({_lit(LABELS)})[doc_id % {len(LABELS)} + 1] AS label FROM documents),
s AS (SELECT *, {_by_label({k: "'" + v[0][0] + "'" for k, v in KIT.cues.items()})} AS cue FROM d),
n AS (SELECT count(*) AS n, 4 * count(*) AS wanted FROM d),
m(g, prefix, v) AS (VALUES ('complaint_resolution', 'sft-cr', {G.DEFAULT_MIX["complaint_resolution"]}), ('differential', 'sft-diff', {G.DEFAULT_MIX["differential"]}),
  ('distractor', 'sft-dist', {G.DEFAULT_MIX["distractor"]}), ('abstention', 'sft-abs', {G.DEFAULT_MIX["abstention"]}))
SELECT 'sft-auth-' || lpad(seq::VARCHAR, 5, '0') AS id, {_by_label({k: "'" + KIT.slices[k] + "'" for k in LABELS})} AS mode, md5(cue || ' ' || text) AS prompt, 1 AS n FROM s
UNION ALL SELECT prefix, NULL, NULL, greatest(0, greatest(1, round_even(v * (wanted / {sum(G.DEFAULT_MIX.values())}::DOUBLE), 0)::BIGINT)
  - CASE WHEN g = 'complaint_resolution' THEN n ELSE 0 END) AS n FROM m, n WHERE n > 0""")
def authored_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """GE7, GE8, TX17: authored seeds, every document with a cue, take the place of template cases."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    seeds = order.number_rows(docs, "doc_id", "no").withColumns({"seq": F.col("no") - 1, "label": G.cycled_label(LABELS, F.col("doc_id"))})
    cue, said = (KIT.text(F.col("label"), {k: v[0][part] for k, v in KIT.cues.items()}) for part in (0, 1))
    seeds = seeds.select("seq", "label", F.concat_ws(" ", cue, "text").alias("complaint"), F.array(said).alias("evidence"),
                         F.lit("Seen in the ticket.").alias("think"), F.lit(0.6).alias("confidence"))
    n = 4 * table(spark, sf, "documents").count()
    rows = build.chat_dataset(spark, KIT, SEED, n, cut_lineage(seeds), None, "mixed")
    own = F.col("source") == "authored"
    named = rows.select(F.when(own, F.col("id")).otherwise(F.regexp_replace("id", r"-\d+$", "")).alias("id"), F.when(own, F.col("mode")).alias("mode"),
                        F.when(own, F.md5(F.col("messages")[1]["content"])).alias("prompt"))
    return named.groupBy("id", "mode", "prompt").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN '{LABELS[0]}' ELSE '{ABSTAIN}' END AS label, TRUE AS parsed,
  CASE WHEN doc_id % 2 = 0 THEN 0.64::DOUBLE END AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'It is in airplane mode' ELSE '' END AS evidence
FROM documents""")
def classified_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """GE11: tickets answered by rule; whole documents with a cue sentence in front or without."""
    text = F.col("text")
    cue = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("It is in airplane mode. "), text)).otherwise(text)
    docs = table(spark, sf, "documents", "doc_id", "text")
    tickets = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), cue.alias("complaint"))
    made = G.classify_tickets(tickets, KIT)
    judged = judge_answers(made.select("id", "complaint", "answer"), BOOK)
    sure = F.col("label") != ABSTAIN
    return judged.select(
        "id", "label", F.col("parse_ok").alias("parsed"), F.when(sure, F.col("confidence")).alias("confidence"),
        F.array_join("evidence", "|").alias("evidence"))


@query("SELECT event_id AS attempt, floor(" + _u("u").replace("i ||", "event_id ||") + " * 1000)::BIGINT AS per_mille FROM events")
def uniform_draws(spark: SparkSession, sf: str) -> DataFrame:
    """GE1: draws that depend on seed and key alone."""
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        k.alias("attempt"), F.floor(D.uniform(SEED, k, "u") * 1000).alias("per_mille"))


@query("SELECT doc_id, 'x' AS part FROM documents UNION ALL SELECT item_id, NULL FROM benchmark")
def union_types(spark: SparkSession, sf: str) -> DataFrame:
    """SO1: union of record tables with different columns."""
    docs = table(spark, sf, "documents").select("doc_id", F.lit("x").alias("part"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return docs.unionByName(items, allowMissingColumns=True)


