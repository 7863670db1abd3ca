"""Synthetic records as dataset jobs.

A :class:`CaseKit` holds the domain texts (bounded parameters, used as literals). One input row gives
one attempt; every choice is a digest draw on the row's key, so output does not depend on the
partitioning. Rejection sampling means: attempt in rounds what is still missing, judge all attempts, keep the
first n accepted ones of each group by number.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.functions import draw as D
from sparkcurate.functions import text as X
from sparkcurate.functions.chat import message, think_block
from sparkcurate.functions.text import filled
from sparkcurate.operators.lookup import look_up, numbered_ladder, numbered_lines, runbook_fields
from sparkcurate.operators.logs import median_floor
from sparkcurate.operators.order import number_rows
from sparkcurate.operators.rules import RuleBook
from sparkcurate.session import cut_lineage, pin

# Fixed values. Reasoning styles with their weights, and the default mixture of groups.
STYLES = (("clean", 0.55), ("selfcorrect", 0.22), ("multihop", 0.23))
DEFAULT_MIX = {
    "complaint_resolution": 900, "knowledge": 600, "differential": 350, "distractor": 250,
    "abstention": 200,
}
# Fixed values. Constant metadata of generated records.
PERSONA, LANG, AUDIT = "internal_agent", "en", "approved"

STEP = "struct<action:string,addresses:string,expected_time:string,verify:string>"
DIFFERENTIAL = "array<struct<rc:string,likelihood:string,why:string>>"


@dataclass(frozen=True)
class CaseKit:
    """Domain texts of the generator."""

    book: RuleBook
    slices: Mapping[str, str]
    cues: Mapping[str, Sequence[tuple[str, str]]]  # label -> (sentence, evidence), primary first
    openers: Mapping[str, str]  # with {feature} and {time}
    features: Sequence[str]
    times: Sequence[str]
    one_line: Mapping[str, str]
    alternative: Mapping[str, tuple[str, str]]  # label -> (other label, why it is less likely)
    unseen: Mapping[str, str]
    chain: Mapping[str, str]
    to_confirm: Mapping[str, Sequence[str]]
    runbook_texts: Mapping[str, Mapping[str, object]]
    ladders: Mapping[str, Sequence[tuple[str, str, str, str]]]
    generic_ladder: Sequence[tuple[str, str, str, str]]
    vague: Sequence[str]
    off_catalogue: Sequence[str]
    route: str
    system_prompt: str
    traces: Mapping[str, str]  # style -> template of the reasoning
    documents: Mapping[str, str]  # artifact -> template
    faults: Mapping[str, Mapping[str, object]]  # fault -> what it changes, see ``rejected_side``
    paraphrases: Sequence[str] = ("{q}",)  # ways to ask a question
    no_evidence: str = "none"
    credit_note: str = ""
    version: str = "v1"
    escalate_notes: Mapping[str, Mapping[str, str]] = field(default_factory=dict)

    def by_label(self, label: Column, values: Mapping[str, Column]) -> Column:
        """A literal chosen by label."""
        out = None
        for name, value in values.items():
            test = label == name
            out = F.when(test, value) if out is None else out.when(test, value)
        return out

    def text(self, label: Column, values: Mapping[str, str]) -> Column:
        """A text chosen by label."""
        return self.by_label(label, {k: F.lit(v) for k, v in values.items()})

    def book_text(self, label: Column, name: str) -> Column:
        """A runbook text chosen by label."""
        return self.text(label, {k: str(v[name]) for k, v in self.runbook_texts.items()})

    def book_list(self, label: Column, name: str) -> Column:
        """A runbook list chosen by label."""
        return self.by_label(
            label, {k: X.strings(list(v[name])) for k, v in self.runbook_texts.items()}
        )


def steps_literal(steps: Sequence[tuple[str, str, str, str]]) -> Column:
    """Ladder steps as an array of structs."""
    names = ("action", "addresses", "expected_time", "verify")
    return F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, step, strict=True)]) for step in steps
    ]).cast(f"array<{STEP}>")


def cycled_label(labels: Sequence[str], position: Column) -> Column:
    """Labels in turn."""
    return F.get(X.strings(labels), F.pmod(position, F.lit(len(labels))).cast("int"))


def draw_cases(attempts: DataFrame, kit: CaseKit, seed: int, key: str = "attempt",
               n_cues: Column | None = None, style: Column | str = "auto") -> DataFrame:
    """Add complaint, evidence, confidence, differential and think to rows with a concrete ``label``.

    The primary cue is always used; ``n_cues`` (2 or 3 by default) counts it.
    """
    k, label = F.col(key), F.col("label")
    pairs = kit.by_label(label, {
        name: F.array(*[F.struct(F.lit(s).alias("sentence"), F.lit(e).alias("evidence"))
                        for s, e in cues])
        for name, cues in kit.cues.items()
    })
    count = n_cues if n_cues is not None else D.pick_index(seed, k, "k", 2) + 2
    drawn = attempts.withColumns({"_pairs": pairs, "_k": count.cast("int")})
    tail = F.slice(F.col("_pairs"), F.lit(2), F.size("_pairs"))
    rest = F.slice(D.shuffled(seed, k, "rest", tail), F.lit(1), F.greatest(F.lit(0), F.col("_k") - 1))
    chosen = D.shuffled(seed, k, "order", F.concat(F.slice("_pairs", 1, 1), rest))
    drawn = drawn.withColumn("_chosen", chosen)
    opener = F.replace(
        F.replace(kit.text(label, kit.openers), F.lit("{feature}"),
                  D.pick(seed, k, "feature", X.strings(kit.features))),
        F.lit("{time}"), D.pick(seed, k, "time", X.strings(kit.times)),
    )
    spread = D.uniform(seed, k, "confidence") * F.lit(0.06) - F.lit(0.03)
    raw = F.least(F.lit(0.82), F.lit(0.55) + F.lit(0.09) * F.col("_k") + spread)
    sentences = F.array_join(F.transform("_chosen", lambda c: c["sentence"]), " ")
    drawn = drawn.withColumns({
        "complaint": F.concat(opener, F.lit(" "), sentences),
        "evidence": F.transform("_chosen", lambda c: c["evidence"]),
        "confidence": F.bround(raw, 2),
        "differential": default_differential(kit, label),
    })
    chosen_style = D.weighted(seed, k, "style", STYLES) if style == "auto" else (
        F.lit(style) if isinstance(style, str) else style
    )
    drawn = drawn.withColumn("style", chosen_style)
    return drawn.withColumn("think", think_text(kit, drawn)).drop("_pairs", "_k", "_chosen")


def default_differential(kit: CaseKit, label: Column) -> Column:
    """The label first, its usual alternative second."""
    other = kit.text(label, {k: v[0] for k, v in kit.alternative.items()})
    why = kit.text(label, {k: v[1] for k, v in kit.alternative.items()})

    def entry(rc: Column, likelihood: str, reason: Column) -> Column:
        return F.struct(rc.alias("rc"), F.lit(likelihood).alias("likelihood"), reason.alias("why"))

    return F.array(entry(label, "high", kit.text(label, kit.one_line)), entry(other, "low", why))


def think_text(kit: CaseKit, df: DataFrame) -> Column:
    """Reasoning in the drawn style: cues, hypothesis, alternative, what stays unknown, confidence."""
    label = F.col("label")
    cues = F.array_join("evidence", "; ")
    other = kit.text(label, {k: v[0] for k, v in kit.alternative.items()})
    why = kit.text(label, {k: v[1] for k, v in kit.alternative.items()})
    line, unseen = kit.text(label, kit.one_line), kit.text(label, kit.unseen)
    values = {
        "cues": cues, "cause": label, "other": other, "why": why, "unseen": unseen, "line": line,
        "chain": kit.text(label, kit.chain), "confidence": F.format_string("%.2f", F.col("confidence")),
    }
    text = filled(kit.traces["clean"], values)
    for style, template in kit.traces.items():
        if style != "clean":
            text = F.when(F.col("style") == style, filled(template, values)).otherwise(text)
    return text


def with_package(cases: DataFrame, kit: CaseKit) -> DataFrame:
    """Add ``package``: the answer struct for a concrete label, assembled from runbook texts.

    A ``sub_cause`` column, if there, is carried along and tailors the last ladder step.
    """
    label, book = F.col("label"), kit.book
    sub = F.col("sub_cause") if "sub_cause" in cases.columns else F.lit(None).cast("string")
    steps = kit.by_label(label, {k: steps_literal(v) for k, v in kit.ladders.items()})
    ladder = numbered_ladder(F.coalesce(steps, steps_literal(kit.generic_ladder)))
    notes = {f"{k}\x1f{s}": n for k, subs in kit.escalate_notes.items() for s, n in subs.items()}
    if notes:
        note = kit.text(F.concat_ws("\x1f", label, sub), notes)
        ladder = F.transform(ladder, lambda s: F.when(
            (s["if_fails"] == "a specialist takes over") & note.isNotNull(),
            s.withField("action", F.concat(F.upper(F.substring(note, 1, 1)), F.substr(
                note, F.lit(2))))).otherwise(s))
    package = F.struct(
        F.struct(
            label.alias("leading_root_cause"), F.col("confidence").alias("confidence"),
            F.col("differential").cast(DIFFERENTIAL).alias("differential"),
            F.col("evidence").alias("evidence_in_ticket"),
            kit.by_label(label, {k: X.strings(v) for k, v in kit.to_confirm.items()})
            .alias("to_confirm"),
            sub.alias("sub_cause"),
        ).alias("diagnosis"),
        book.fact(label, "runbook_id").alias("runbook_id"),
        kit.book_text(label, "why_plain").alias("why_plain"),
        kit.book_text(label, "why_technical").alias("why_technical"),
        *[book.fact(label, n).alias(n) for n in ("owner_team", "support_contact", "escalation")],
        kit.book_list(label, "fix_steps").alias("fix_steps"),
        kit.book_text(label, "eta_ttr").alias("eta_ttr"),
        book.fact(label, "severity").alias("severity"),
        book.fact(label, "priority").alias("priority"),
        F.struct(kit.book_text(label, "churn_level").alias("level"),
                 kit.book_text(label, "churn_why").alias("why")).alias("churn_risk"),
        F.struct(
            kit.book_text(label, "offer").alias("offer"),
            (kit.book_text(label, "proactive") == "True").alias("proactive"),
            kit.book_text(label, "offer_note").alias("note"),
        ).alias("compensation"),
        ladder.alias("customer_self_service"),
        artifacts(kit, label).alias("artifacts"),
    )
    return cases.withColumn("package", package)


def artifacts(kit: CaseKit, label: Column) -> Column:
    """Cause analysis, work order, customer mail and diagram texts."""
    book = kit.book
    evidence = F.when(F.size("evidence") > 0, F.array_join("evidence", "; ")).otherwise(F.lit(kit.no_evidence))
    credit = F.when(kit.book_text(label, "proactive") == "True", F.concat(F.lit(kit.credit_note), F.lit(" ")))
    values = {
        "cause": label, "evidence": evidence, "steps": numbered_lines(kit.book_list(label, "fix_steps")),
        "credit": F.coalesce(credit, F.lit("")),
        **{n: book.fact(label, n) for n in ("runbook_id", "owner_team", "support_contact", "escalation",
                                            "severity", "priority")},
        **{n: kit.book_text(label, n) for n in ("why_plain", "why_technical", "eta_ttr", "customer_action")},
    }
    return F.struct(*[filled(kit.documents[n], values).alias(n)
                      for n in ("rca_md", "work_order_md", "customer_email", "diagram_mermaid")])


def draw_abstentions(attempts: DataFrame, kit: CaseKit, seed: int, key: str = "attempt",
                     kind: Column | None = None) -> DataFrame:
    """Tickets without a usable cue: vague ones, or (with a short quote) ones off the catalogue."""
    k = F.col(key)
    off = (kind if kind is not None else D.weighted(
        seed, k, "kind", (("vague", 0.5), ("out_of_catalog", 0.5)))) == "out_of_catalog"
    complaint = F.when(off, D.pick(seed, k, "off", X.strings(kit.off_catalogue))).otherwise(
        D.pick(seed, k, "vague", X.strings(kit.vague)))
    two = F.slice(D.shuffled(seed, k, "pair", X.strings(kit.book.labels)), 1, 2)
    drawn = attempts.withColumns({
        "label": F.lit(kit.book.abstain), "complaint": complaint, "_off": off,
        "confidence": F.bround(F.lit(0.25) + D.uniform(seed, k, "confidence") * F.lit(0.17), 2),
        "differential": F.transform(two, lambda rc: F.struct(
            rc.alias("rc"), F.lit("low").alias("likelihood"),
            F.lit("nothing in the ticket tells the causes apart").alias("why"))),
    })
    quote = F.when(F.col("_off"), F.array(X.short_fragment(F.col("complaint")))).otherwise(
        X.strings(()))
    return drawn.withColumn("evidence", quote).withColumn("think", F.format_string(
        "Nothing in the ticket tells the known causes apart, so no cause is named. Confidence "
        "stays at %.2f and the ticket goes to a person with a list of points to confirm.",
        F.col("confidence"))).withColumn("style", F.lit("clean")).drop("_off")


def with_abstention_package(cases: DataFrame, kit: CaseKit) -> DataFrame:
    """Add ``package`` for abstentions: routed to a person, no runbook, no offer."""
    none = F.lit(None).cast("string")
    route = F.lit(kit.route)
    package = F.struct(
        F.struct(
            F.lit(kit.book.abstain).alias("leading_root_cause"),
            F.col("confidence").alias("confidence"),
            F.col("differential").cast(DIFFERENTIAL).alias("differential"),
            F.col("evidence").alias("evidence_in_ticket"),
            X.strings(("where the feature shows as active", "any error code or prompt",
                       "whether a record of the purchase exists")).alias("to_confirm"),
            none.alias("sub_cause"),
        ).alias("diagnosis"),
        none.alias("runbook_id"),
        F.lit("We need a few more details and pass this on to a specialist.").alias("why_plain"),
        F.lit("Too few cues to choose a cause.").alias("why_technical"),
        route.alias("owner_team"), route.alias("support_contact"), route.alias("escalation"),
        X.strings(("pass on to a person", "collect the open points", "triage again"))
        .alias("fix_steps"),
        F.lit("TBD").alias("eta_ttr"), none.alias("severity"), none.alias("priority"),
        F.struct(F.lit("medium").alias("level"), F.lit("open issue of a paying customer")
                 .alias("why")).alias("churn_risk"),
        F.lit(None).cast("struct<offer:string,proactive:boolean,note:string>")
        .alias("compensation"),
        numbered_ladder(steps_literal(kit.generic_ladder)).alias("customer_self_service"),
        F.struct(
            F.lit("## Cause analysis\nNot enough evidence.").alias("rca_md"),
            F.concat(F.lit("## Work order\n- "), route).alias("work_order_md"),
            F.lit("Hello, thank you for writing. A specialist will get back to you soon.")
            .alias("customer_email"),
            F.lit("flowchart LR\n  ticket --> person").alias("diagram_mermaid"),
        ).alias("artifacts"),
    )
    return cases.withColumn("package", package)


def package_json(package: Column) -> Column:
    """Compact JSON that keeps empty fields."""
    return F.to_json(package, {"ignoreNullFields": "false"})


def with_answer(cases: DataFrame) -> DataFrame:
    """Add ``answer``: thinking block and package JSON."""
    return cases.withColumn("answer", think_block(F.col("think"), package_json(F.col("package"))))


def build_cases(attempts: DataFrame, kit: CaseKit, seed: int, key: str = "attempt",
                n_cues: Column | None = None, style: Column | str = "auto",
                kind: Column | None = None) -> DataFrame:
    """Cases for attempts whose ``label`` may be concrete or the abstention."""
    concrete = attempts.where(F.col("label") != kit.book.abstain)
    abstain = attempts.where(F.col("label") == kit.book.abstain)
    made = with_package(draw_cases(concrete, kit, seed, key, n_cues, style), kit)
    routed = with_abstention_package(draw_abstentions(abstain, kit, seed, key, kind), kit)
    return with_answer(made.unionByName(routed))


def first_accepted(judged: DataFrame, wanted: int | Mapping[str, int], key: str = "attempt",
                   group: str | None = None, chunk: int = 1_000_000) -> DataFrame:
    """The first accepted attempts (as many as wanted, per group), numbered from 0.

    Too few is an error. Numbering works on ranges of attempts, so a group of any size is spread
    over many tasks. The accepted rows are stored once: the count, the check and the result all
    read that table.
    """
    accepted = cut_lineage(judged.where("verdict.ok"))
    if group is None:
        found, needed, limit = {"": accepted.count()}, {"": wanted}, F.lit(wanted)
    else:
        sizes = accepted.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        found = {r[group]: r["n"] for r in sizes.where(F.col(group).isin(*wanted)).collect()}
        needed = dict(wanted)
        pairs = [F.lit(x) for item in needed.items() for x in item]
        limit = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(group)), F.lit(0))
    short = {k: n - found.get(k, 0) for k, n in needed.items() if found.get(k, 0) < n}
    if short:
        raise ValueError(f"too few accepted attempts, over-generate more: {short}")
    numbered = number_rows(accepted, key, "_no", chunk, (group,) if group else ())
    return numbered.where(F.col("_no") <= limit).withColumn("seq", F.col("_no") - 1).drop("_no")


def fill_quotas(spark: SparkSession, wanted: Mapping[str, int], judge: Callable[[DataFrame], DataFrame],
                group: str = "group", most: int = 200) -> DataFrame:
    """The first accepted attempts of every group, as many as wanted, numbered from 0 (``seq``).

    ``judge`` turns attempts (``attempt``, ``index``, ``group``) into rows with these columns and a verdict; it must decide
    by them alone. Attempts are tried in rounds: what a group still lacks, divided by the share accepted so far.
    A group that has enough stops. Attempts are numbered within their group and tried without
    gaps, so the rows chosen depend neither on the rounds nor on the partitioning. A group that accepts fewer than one in
    ``most`` is an error. The driver holds two numbers per group.
    """
    names = list(wanted)
    tried, have = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    kept: list[DataFrame] = []
    while True:
        sizes = {}
        for name, n in wanted.items():
            if have[name] >= n:
                continue
            if tried[name] > most * n + 1000:
                raise ValueError(f"{name}: {have[name]} of {tried[name]} attempts accepted, {n} wanted")
            share = max(have[name], 0.5) / tried[name] if tried[name] else 1.0
            sizes[name] = math.ceil(1.1 * (n - have[name]) / share) + 8
        if kept and not sizes:
            break
        blocks = [(name, tried[name], size) for name, size in sizes.items()]
        key, total, place, index = F.col("id"), 0, F.lit(0), F.lit(0).cast("long")
        for name, start, size in blocks:
            place = F.when(key >= total, F.lit(names.index(name))).otherwise(place)
            index = F.when(key >= total, key - total + start).otherwise(index)
            total += size
        rows = spark.range(total).select((index * len(names) + place).alias("attempt"), index.alias("index"),
                                         F.get(X.strings(names), place).alias(group))
        accepted = cut_lineage(judge(rows).where("verdict.ok"))
        kept.append(accepted)
        for name, _, size in blocks:
            tried[name] += size
        for row in accepted.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect():
            have[row[group]] += row["n"]
        if not blocks:
            break
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    limits = F.create_map(*[F.lit(x) for item in wanted.items() for x in item]) if wanted else F.create_map()
    numbered = number_rows(found, "attempt", "_no", by=(group,))
    return numbered.where(F.col("_no") <= F.try_element_at(limits, F.col(group))).withColumn(
        "seq", F.col("_no") - 1).drop("_no")


def record_id(prefix: str | Column, seq: Column) -> Column:
    """``prefix-00042``: at least five digits, longer numbers are kept whole."""
    digits = seq.cast("string")
    padded = F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("-"), padded)


def _metadata(kit: CaseKit) -> dict[str, Column]:
    return {"persona": F.lit(PERSONA), "lang": F.lit(LANG), "version": F.lit(kit.version),
            "audit_status": F.lit(AUDIT)}


def sft_records(cases: DataFrame, kit: CaseKit, prefix: str | Column,
                mode: Column | None = None) -> DataFrame:
    """Chat records (system, ticket, answer) of numbered cases."""
    tag = mode if mode is not None else kit.text(F.col("label"), kit.slices)
    meta = _metadata(kit)
    return cases.select(
        record_id(prefix, F.col("seq")).alias("id"), F.lit("sft").alias("data_type"),
        F.lit("single").alias("conversation_type"), tag.alias("mode"),
        *[v.alias(k) for k, v in meta.items()],
        F.array(message("system", F.lit(kit.system_prompt)), message("user", F.col("complaint")),
                message("assistant", F.col("answer"))).alias("messages"),
    )


def gold_records(cases: DataFrame, kit: CaseKit, prefix: str = "eval") -> DataFrame:
    """Gold cases: the ticket as prompt, the answer as reference, the label."""
    return cases.select(
        record_id(prefix, F.col("seq")).alias("id"),
        kit.text(F.col("label"), kit.slices).alias("mode"),
        F.col("label").alias("leading_root_cause"),
        F.array(message("user", F.col("complaint"))).alias("messages"),
        F.col("answer").alias("reference"), F.lit(PERSONA).alias("persona"),
    )


def authored_cases(seeds: DataFrame, kit: CaseKit) -> DataFrame:
    """Authored seeds (label, complaint, evidence, think, confidence, optional differential and
    churn override) completed with packages."""
    columns = seeds.columns
    base = seeds if "differential" in columns else seeds.withColumn(
        "differential", F.lit(None).cast(DIFFERENTIAL))
    base = base.withColumn("differential", F.coalesce(
        F.col("differential").cast(DIFFERENTIAL), default_differential(kit, F.col("label"))))
    is_abstain = F.col("label") == kit.book.abstain
    made = with_package(base.where(~is_abstain), kit)
    if "churn_override" in columns:
        risk = F.coalesce(F.col("churn_override"), F.col("package.churn_risk"))
        made = made.withColumn("package", F.col("package").withField("churn_risk", risk))
    routed = with_abstention_package(base.where(is_abstain), kit)
    return with_answer(made.unionByName(routed))


def knowledge_pairs(facts: DataFrame, templates: Sequence[str]) -> DataFrame:
    """(question, answer) facts times a domain's ways to ask (``{q}``, or ``{ql}`` with a small first letter); the
    templates are a literal, so no join."""
    q = F.col("question")
    lower = F.concat(F.lower(F.substring(q, 1, 1)), F.substr(q, F.lit(2)))

    def fill(template: Column) -> Column:
        return F.replace(F.replace(template, F.lit("{ql}"), lower), F.lit("{q}"), q)

    asked = F.posexplode(F.transform(X.strings(templates), fill)).alias("variant", "asked")
    return facts.select("*", asked)


def templated_facts(runbooks: DataFrame, templates: Mapping[str, tuple[str, str]], incidents: DataFrame | None = None,
                    unasked: str = "unasked", on_request: str = "on request") -> DataFrame:
    """(label, fact, question, answer): every fact of ``templates`` (question and answer with ``{field}`` slots) per runbook.

    Slots are those of :func:`runbook_fields`. With ``incidents`` (label, id, complaint, key_cue, ttr_min) there are also
    ``incident_id``, ``incident_complaint``, ``incident_cue``, ``incident_ttr`` of the first one by id, ``incidents`` and
    ``median_ttr``; a fact that asks for them is left out for a label without incidents. A fact that asks for a column no
    runbook has is an error.
    """
    rows, extra = runbooks, {}
    if incidents is not None:
        names = {"id": "incident_id", "complaint": "incident_complaint", "key_cue": "incident_cue", "ttr_min": "incident_ttr"}
        # Incidents of one id are told apart by their other fields, so that the choice does not depend on the partitions.
        first = incidents.groupBy("label").agg(F.min(F.when(F.col("id").isNotNull(), F.struct(*names))).alias("f")).select(
            "label", *[F.col(f"f.{c}").cast("string").alias(n) for c, n in names.items()])
        middle = median_floor(incidents, "ttr_min", ("label",)).select(
            "label", F.col("n").cast("string").alias("incidents"), F.col("median").cast("string").alias("median_ttr"))
        rows = look_up(cut_lineage(rows), first.join(middle, "label", "left"), ["label"])
        extra = {n: F.col(n) for n in (*names.values(), "incidents", "median_ttr")}
    values = runbook_fields(runbooks, unasked, on_request) | extra
    facts = []
    for fact, (question, answer) in templates.items():
        asked = set(re.findall(r"\{(\w+)\}", question + answer))
        if asked - set(values):
            raise ValueError(f"{fact} asks for unknown fields: {sorted(asked - set(values))}")
        known = F.lit(True) if not asked & set(extra) else F.col("incidents").isNotNull()
        facts.append(F.when(known, F.struct(F.lit(fact).alias("fact"), filled(question, values).alias("question"),
                                            filled(answer, values).alias("answer"))))
    return rows.select("label", F.explode(F.array_compact(F.array(*facts))).alias("r")).select("label", "r.*")


def hard_records(cases: DataFrame, kit: CaseKit, key: str = "case", prefix: str = "hard") -> DataFrame:
    """Gold records of written cases (``key``, complaint, label): numbered along the integer key, no reference text.

    A label that the kit does not know counts as the abstention's slice, but stays the expected label.
    """
    numbered = number_rows(cases, key, "_no")
    mode = F.coalesce(kit.text(F.col("label"), kit.slices), F.lit(kit.slices[kit.book.abstain]))
    return numbered.select(
        record_id(prefix, F.col("_no") - 1).alias("id"), mode.alias("mode"), F.col("label").alias("leading_root_cause"),
        F.array(message("user", F.col("complaint"))).alias("messages"), F.lit("").alias("reference"),
        F.lit(PERSONA).alias("persona"))


def cycle_to(pairs: DataFrame, order: str, n: int) -> DataFrame:
    """n rows by repeating the numbered pairs (``order`` = 0..count-1) in turn."""
    count = pairs.count()
    if not count:
        raise ValueError("nothing to repeat")
    rounds = F.floor((F.lit(n - 1) - F.col(order)) / count)
    repeated = pairs.where(F.col(order) < n).withColumn(
        "_round", F.explode(F.sequence(F.lit(0).cast("long"), rounds.cast("long"))))
    return repeated.withColumn("seq", F.col(order) + F.col("_round") * count).drop("_round")


def classify_tickets(tickets: DataFrame, kit: CaseKit, ticket: str = "complaint",
                     key: str = "id", seed: int = 0) -> DataFrame:
    """Answer any ticket by rule: exactly one detected label gives its package, else an abstention."""
    found = pin(tickets.withColumn("_norm", X.normalise(F.coalesce(F.col(ticket), F.lit("")))))
    found = pin(found.withColumn("detected", X.detect_labels(F.col("_norm"), kit.book.signatures)))
    single = F.size("detected") == 1
    found = found.withColumn("label", F.when(single, F.get("detected", F.lit(0))).otherwise(
        F.lit(kit.book.abstain))).drop("_norm")
    evidence = kit.by_label(F.col("label"), {
        label: X.cue_sentences(F.col(ticket), groups)
        for label, groups in kit.book.signatures.items()
    })
    sure = found.where(single).withColumn("evidence", evidence).withColumns({
        "confidence": F.bround(F.least(F.lit(0.82), F.lit(0.55) + F.lit(0.09) * F.greatest(
            F.lit(1), F.size("evidence"))), 2),
        "differential": default_differential(kit, F.col("label")), "style": F.lit("clean"),
    })
    sure = with_package(sure.withColumn("think", think_text(kit, sure)), kit)
    unsure = found.where(~single)
    routed = draw_abstentions(unsure.withColumn("_ticket", F.col(ticket)), kit, seed, key,
                              F.lit("vague"))
    if ticket == "complaint":
        routed = routed.withColumn("complaint", F.col("_ticket"))
    else:
        routed = routed.drop("complaint")
    routed = with_abstention_package(routed.drop("_ticket"), kit)
    return with_answer(sure.unionByName(routed))


def mock_answers(cases: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """Replay the reference; cases without one take the built answer of the same id."""
    replay = F.nullif(F.col("reference"), F.lit(""))
    if built is None:
        return cases.withColumn("answer", replay)
    ideal = built.select("id", F.col("answer").alias("_built"))
    return cases.join(ideal, "id", "left").withColumn(
        "answer", F.coalesce(replay, F.col("_built"))).drop("_built")
