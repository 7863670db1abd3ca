"""Preference pairs: an accepted answer against the same answer with exactly one fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions import draw as D
from sparkcurate.functions import text as X
from sparkcurate.functions.chat import joined, message, think_block
from sparkcurate.operators.generate import AUDIT, LANG, PERSONA, CaseKit, filled, package_json, record_id

# Fixed values. The kinds of faults.
FAULTS = (
    "cue_dropped", "fabricated_telemetry", "overconfident", "missing_fields", "forced_guess",
    "overpromise", "single_path",
)

# Fixed values. The confidence a faulty answer states, where the fault changes it.
CONFIDENCE = {"cue_dropped": 0.74, "fabricated_telemetry": 0.95, "overconfident": 0.97, "forced_guess": 0.88}


def rejected_side(kit: CaseKit, fault: str, package: Column, think: Column, label: Column,
                  other: Column) -> tuple[Column, Column]:
    """(think, JSON) of the faulty answer. ``other`` is a different concrete label.

    What a fault changes is data, an entry of ``CaseKit.faults``: the fields below and the texts.
    """
    if fault not in FAULTS:
        raise ValueError(f"unknown fault {fault!r}")
    change, bad = kit.faults.get(fault, {}), package
    named = other if change.get("takes_other") else label
    if change.get("takes_other"):
        bad = bad.withField("diagnosis.leading_root_cause", other)
        for name in ("runbook_id", "owner_team", "support_contact", "escalation", "severity", "priority"):
            bad = bad.withField(name, kit.book.fact(other, name))
    if fault in CONFIDENCE:
        bad = bad.withField("diagnosis.confidence", F.lit(CONFIDENCE[fault]))
    if "only_cause" in change:
        likelihood, why = change["only_cause"]
        bad = bad.withField("diagnosis.differential", F.array(F.struct(
            named.alias("rc"), F.lit(likelihood).alias("likelihood"), F.lit(why).alias("why"))))
    if "evidence" in change:
        bad = bad.withField("diagnosis.evidence_in_ticket", X.strings(tuple(change["evidence"])))
    if "without" in change:
        bad = bad.dropFields(*change["without"])
    if "offer" in change:
        offer, note = change["offer"]
        bad = bad.withField("compensation", F.struct(
            F.lit(offer).alias("offer"), F.lit(True).alias("proactive"), F.lit(note).alias("note")))
    if "mail" in change:
        bad = bad.withField("artifacts.customer_email", F.lit(change["mail"]))
    if "one_step" in change:
        bad = bad.withField("customer_self_service", F.transform(
            F.slice(package["customer_self_service"], 1, 1),
            lambda s: s.withField("if_fails", F.lit(change["one_step"]))))
    said = filled(change.get("think", "{think}"), {"think": think, "cause": named})
    return said, package_json(bad)


def corrupt(cases: DataFrame, kit: CaseKit, seed: int, key: str = "attempt") -> DataFrame:
    """Add ``chosen_text`` and ``rejected_text`` to accepted cases that carry ``bad_type``.

    One projection with a CASE per fault; the faulty side is not judged, its fault is the point.
    """
    labels = X.strings(kit.book.labels)
    others = F.filter(labels, lambda x: x != F.col("label"))
    picked = cases.withColumn("_other", D.pick(seed, F.col(key), "other", others))
    text = None
    for fault in FAULTS:
        think, payload = rejected_side(kit, fault, F.col("package"), F.col("think"),
                                       F.col("label"), F.col("_other"))
        test, value = F.col("bad_type") == fault, think_block(think, payload)
        text = F.when(test, value) if text is None else text.when(test, value)
    return picked.withColumns({"chosen_text": F.col("answer"), "rejected_text": text}).drop("_other")


def preference_records(pairs: DataFrame, kit: CaseKit, seq: str = "seq") -> DataFrame:
    """Preference records with prompt, chosen and rejected message lists."""
    tag = kit.text(F.col("label"), kit.slices)
    return pairs.select(
        record_id(F.concat(F.lit("dpo-"), F.col("bad_type")), F.col(seq)).alias("id"),
        F.lit("preference").alias("data_type"), tag.alias("mode"), F.lit(PERSONA).alias("persona"),
        "bad_type", F.lit(LANG).alias("lang"), F.lit(kit.version).alias("version"),
        F.lit(AUDIT).alias("audit_status"),
        F.array(message("system", F.lit(kit.system_prompt)), message("user", F.col("complaint")))
        .alias("prompt"),
        F.array(message("assistant", F.col("chosen_text"))).alias("chosen"),
        F.array(message("assistant", F.col("rejected_text"))).alias("rejected"),
    )


def preference_examples(records: DataFrame) -> DataFrame:
    """Training form: prompt messages, chosen and rejected texts joined by newlines."""
    return records.select(
        "id", "prompt", joined(F.col("chosen")).alias("chosen"),
        joined(F.col("rejected")).alias("rejected"),
    )
