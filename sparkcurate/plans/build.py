"""Generate gated chat records, preference pairs and gold cases from a case kit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import draw as D
from sparkcurate.operators import generate as G
from sparkcurate.operators.order import number_rows
from sparkcurate.operators.preference import FAULTS, corrupt, preference_records
from sparkcurate.operators.rules import judge_answers, require_accepted
from sparkcurate.operators.split import scaled_mix

def parity_kind(key: Column) -> Column:
    """Off-catalogue and vague tickets in turn."""
    return F.when(F.pmod(key, F.lit(2)) == 0, F.lit("out_of_catalog")).otherwise(F.lit("vague"))


def authored_records(seeds: DataFrame, kit: G.CaseKit) -> DataFrame:
    """Authored seeds as records. A seed that breaks a rule fails the job with its reasons.

    ``seeds`` carries ``seq`` and may carry ``mode`` to override the slice of its label.
    """
    cases = G.authored_cases(seeds, kit)
    checked = require_accepted(judge_answers(cases, kit.book, trust_label=True))
    mode = kit.text(F.col("label"), kit.slices)
    if "mode" in seeds.columns:
        mode = F.coalesce(F.col("mode"), mode)
    return G.sft_records(checked, kit, "sft-auth", mode).withColumn("source", F.lit("authored"))


def chat_dataset(spark: SparkSession, kit: G.CaseKit, seed: int, limit: int | None = None,
                 seeds: DataFrame | None = None, facts: DataFrame | None = None,
                 source: str = "mixed", mix: Mapping[str, int] = G.DEFAULT_MIX) -> DataFrame:
    """The full mixture. Authored seeds replace part of the groups they cover; ``source`` is
    ``authored``, ``mixed`` or ``template``; ``facts`` (question, answer, pos) feeds the Q&A group."""
    if source not in ("authored", "mixed", "template"):
        raise ValueError(f"unknown source {source!r}")
    sizes = scaled_mix(mix, limit)
    parts: list[DataFrame] = []
    covered = {"abstention": 0, "complaint_resolution": 0}
    if source != "template" and seeds is not None:
        written = authored_records(seeds, kit)
        parts.append(written)
        abstain_mode = kit.slices[kit.book.abstain]
        concrete = [kit.slices[label] for label in kit.book.labels]
        counts = written.agg(
            F.count_if(F.col("mode") == abstain_mode).alias("abstention"),
            F.count_if(F.col("mode").isin(*concrete)).alias("complaint_resolution"),
        ).first()
        covered = counts.asDict()
    if facts is not None and sizes.get("knowledge"):
        parts.append(knowledge_records(facts, kit, sizes["knowledge"]))
    if source != "authored":
        wanted = {g: max(0, sizes.get(g, 0) - covered.get(g, 0)) for g in TEMPLATE_GROUPS}
        parts.append(template_records(spark, kit, seed, wanted))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


#: Id prefix and slice (None: by label) of the groups made from templates.
TEMPLATE_GROUPS = {
    "complaint_resolution": ("sft-cr", None), "differential": ("sft-diff", "differential"),
    "distractor": ("sft-dist", "distractor"), "abstention": ("sft-abs", None),
}


def template_records(spark: SparkSession, kit: G.CaseKit, seed: int,
                     wanted: Mapping[str, int]) -> DataFrame:
    """Template cases of all groups, drawn and judged in the same rounds."""
    wanted = {g: n for g, n in wanted.items() if n > 0}
    key = F.col("attempt")

    def judged(rows: DataFrame) -> DataFrame:
        labelled = rows.withColumn("label", F.when(F.col("group") == "abstention", kit.book.abstain)
                                   .otherwise(G.cycled_label(kit.book.labels, F.col("index"))))
        cues = F.when(F.col("group") == "differential", F.lit(2)).otherwise(
            D.pick_index(seed, key, "k", 2) + 2)
        return judge_answers(G.build_cases(labelled, kit, seed, n_cues=cues, kind=parity_kind(key)), kit.book)

    accepted = G.fill_quotas(spark, wanted, judged)
    prefix = kit.text(F.col("group"), {g: p for g, (p, _) in TEMPLATE_GROUPS.items()})
    fixed = kit.text(F.col("group"), {g: m for g, (_, m) in TEMPLATE_GROUPS.items() if m})
    mode = F.coalesce(fixed, kit.text(F.col("label"), kit.slices))
    return G.sft_records(accepted, kit, prefix, mode)


def knowledge_records(facts: DataFrame, kit: G.CaseKit, n: int) -> DataFrame:
    """n question/answer records (no system turn) from numbered facts (``pos`` = 0, 1, …)."""
    from sparkcurate.functions.chat import message

    asked = G.knowledge_pairs(facts, kit.paraphrases).withColumn(
        "order", F.col("pos") * len(kit.paraphrases) + F.col("variant"))
    rows = G.cycle_to(asked, "order", n)
    return rows.select(
        G.record_id("sft-kn", F.col("seq")).alias("id"), F.lit("sft").alias("data_type"),
        F.lit("single").alias("conversation_type"), F.lit("knowledge").alias("mode"),
        F.lit(G.PERSONA).alias("persona"), F.lit(G.LANG).alias("lang"),
        F.lit(kit.version).alias("version"), F.lit(G.AUDIT).alias("audit_status"),
        F.array(message("user", F.col("asked")), message("assistant", F.col("answer")))
        .alias("messages"),
    )


def preference_dataset(spark: SparkSession, kit: G.CaseKit, seed: int,
                       per_type: int = 100) -> DataFrame:
    """``per_type`` pairs of every fault."""
    labels, abstain = kit.book.labels, kit.book.abstain

    def judged(rows: DataFrame) -> DataFrame:
        fault = F.col("bad_type")
        label = (F.when(fault == "forced_guess", abstain).when(fault == "cue_dropped", labels[0])
                 .when(fault == "overpromise", labels[-1]).otherwise(G.cycled_label(labels, F.col("index"))))
        return judge_answers(G.build_cases(rows.withColumn("label", label), kit, seed), kit.book)

    accepted = G.fill_quotas(spark, dict.fromkeys(FAULTS, per_type), judged, "bad_type").drop("seq")
    numbered = number_rows(accepted, "attempt", "_no").withColumn("seq", F.col("_no") - 1)
    return preference_records(corrupt(numbered, kit, seed), kit)


def gold_dataset(spark: SparkSession, kit: G.CaseKit, seed: int, n: int = 180) -> DataFrame:
    """n gold cases cycling over all labels and the abstention, in the clean style."""
    key = F.col("attempt")
    rows = spark.range(n).withColumnRenamed("id", "attempt").withColumn(
        "label", G.cycled_label(kit.book.all_labels, key))
    kind = F.when(F.pmod(key, F.lit(2)) == 0, F.lit("vague")).otherwise(F.lit("out_of_catalog"))
    cases = G.build_cases(rows, kit, seed, style="clean", kind=kind)
    return G.gold_records(cases.withColumn("seq", key), kit)
