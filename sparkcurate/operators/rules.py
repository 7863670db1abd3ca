"""The rule verdict over model answers: parse, derive features, judge, explain.

A :class:`RuleBook` holds the domain: labels, cue signatures, the runbook facts an answer must copy.
It is a parameter object of bounded size, turned into literal expressions, so judging an answer
table is a chain of row-local projections without a join or a shuffle. :class:`RuleTables` holds the same
domain as tables of any size; the verdict then looks its facts up by keyed joins. The projections are
staged: parsed JSON, normalised text and token arrays become columns once and are reused.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions import answers as A
from sparkcurate.functions import text as X
from sparkcurate.operators.lookup import allowed_severities, look_up
from sparkcurate.operators.phrases import detected_labels
from sparkcurate.schemas import ARTIFACTS, PACKAGE, PARSE_FAIL, REQUIRED_FIELDS
from sparkcurate.session import cut_lineage, pin

# Fixed values. Confidence limits for a raw ticket and for an abstention.
MAX_CONFIDENCE, MAX_ABSTAIN_CONFIDENCE = 0.85, 0.45

COPIED_FIELDS = ("owner_team", "support_contact", "escalation")

#: Dimension tables above this many rows are refused instead of being pulled to the driver.
MAX_DIMENSION_ROWS = 10_000


@dataclass(frozen=True)
class RuleBook:
    """Domain parameters of the verdict."""

    labels: tuple[str, ...]
    abstain: str
    signatures: Mapping[str, Sequence[Sequence[str]]]
    runbooks: Mapping[str, Mapping[str, str]]  # label -> runbook_id, owner_team, ..., severity
    sub_causes: Mapping[str, Mapping[str, str]] = field(default_factory=dict)  # -> severity
    out_of_catalogue: Sequence[Sequence[str]] = ()
    claim_patterns: Sequence[str] = X.CLAIM_PATTERNS
    promise_patterns: Sequence[str] = X.PROMISE_PATTERNS

    @property
    def all_labels(self) -> tuple[str, ...]:
        """Concrete labels and the abstention."""
        return (*self.labels, self.abstain)

    def fact(self, label: Column, name: str) -> Column:
        """A runbook field by label, NULL for labels without a runbook."""
        values = {k: v[name] for k, v in self.runbooks.items() if v.get(name) is not None}
        pairs = [F.lit(x) for item in values.items() for x in item]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return F.try_element_at(table, label)

    def attach(self, answers: DataFrame) -> DataFrame:
        """``answers`` as they are: every fact is a literal."""
        return answers

    def detected(self, normalised: Column) -> Column:
        """Labels whose cues occur in a normalised text."""
        return X.detect_labels(normalised, self.signatures)

    def concrete(self, label: Column) -> Column:
        """Whether the label has a runbook."""
        return label.isin(*self.labels)

    def cites(self, runbook_id: Column) -> Column:
        """Whether the id is that of a concrete runbook."""
        return runbook_id.isin(*self.runbook_ids())

    def runbook_ids(self) -> list[str]:
        """Ids of the concrete runbooks."""
        return [r["runbook_id"] for r in self.runbooks.values()]

    def severities(self, label: Column) -> Column:
        """Severities allowed for a label: its own and those of its sub causes."""
        pairs: list[Column] = []
        for name, runbook in self.runbooks.items():
            allowed = {runbook["severity"], *self.sub_causes.get(name, {}).values()}
            pairs += [F.lit(name), X.strings(sorted(a for a in allowed if a))]
        table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")
        return F.try_element_at(table, label)

    def known_sub_cause(self, label: Column, sub_cause: Column) -> Column:
        """Whether the sub cause belongs to the label."""
        known = [f"{name}\x1f{sub}" for name, subs in self.sub_causes.items() for sub in subs]
        return F.concat_ws("\x1f", label, sub_cause).isin(*known) if known else F.lit(False)

    @classmethod
    def from_tables(cls, runbooks: DataFrame, cues: DataFrame, abstain: str,
                    sub_causes: DataFrame | None = None, **other) -> RuleBook:
        """Build from dimension tables (label, runbook fields), (label, sig_id, phrases), …"""

        def bounded(df: DataFrame) -> list:
            rows = df.limit(MAX_DIMENSION_ROWS + 1).collect()
            if len(rows) > MAX_DIMENSION_ROWS:
                raise ValueError("a dimension table is too large to be a rule parameter: use RuleTables")
            return rows

        books = {r["label"]: r.asDict(recursive=True) for r in bounded(runbooks)}
        signatures: dict[str, list] = {label: [] for label in books}
        for row in sorted(bounded(cues), key=lambda r: (r["label"], r["sig_id"])):
            signatures.setdefault(row["label"], []).append(list(row["phrases"]))
        subs: dict[str, dict[str, str]] = {}
        for row in bounded(sub_causes) if sub_causes is not None else []:
            subs.setdefault(row["label"], {})[row["sub_cause"]] = row["severity"]
        return cls(tuple(books), abstain, signatures, books, subs, **other)


@dataclass(frozen=True)
class RuleTables:
    """The domain of the verdict as tables, with no bound on labels, cues or sub causes.

    ``runbooks``: label, runbook_id, owner_team, support_contact, escalation, severity, priority; one row per label.
    ``cues``: label, sig_id, phrases. ``sub_causes``: label, sub_cause, severity. A label without a cue is never detected.
    Cue phrases must be normalised. Detected labels come in ascending order.
    """

    runbooks: DataFrame
    cues: DataFrame
    abstain: str
    sub_causes: DataFrame
    claim_patterns: Sequence[str] = X.CLAIM_PATTERNS
    promise_patterns: Sequence[str] = X.PROMISE_PATTERNS

    def attach(self, answers: DataFrame) -> DataFrame:
        """``answers`` (with ``label``, ``sub_cause``, ``_cited`` and ``_norm``) with the facts that the verdict asks for."""
        own = [c for c in answers.columns if c not in ("_fact", "_allowed", "_sub", "_book", "detected")]
        rows = cut_lineage(answers.select(*own, F.monotonically_increasing_id().alias("_row")))
        books = self.runbooks.groupBy("label").agg(F.first(F.struct("runbook_id", *COPIED_FIELDS, "severity", "priority")).alias("_fact"))
        allowed = allowed_severities(self.runbooks, self.sub_causes).withColumnRenamed("allowed", "_allowed")
        subs = self.sub_causes.select("label", "sub_cause").distinct().withColumn("_sub", F.lit(True))
        ids = self.runbooks.select(F.col("runbook_id").alias("_cited")).distinct().withColumn("_book", F.lit(True))
        texts = rows.select("_row", F.col("_norm").alias("text"))
        found = detected_labels(texts, self.cues, "_row")
        facts = rows.select("_row", "label", "sub_cause", "_cited")
        for table, keys in ((books, ["label"]), (allowed, ["label"]), (subs, ["label", "sub_cause"]), (ids, ["_cited"])):
            facts = cut_lineage(look_up(facts, table, keys))
        return rows.join(facts.drop("label", "sub_cause", "_cited").join(found, "_row"), "_row").drop("_row")

    def detected(self, normalised: Column) -> Column:
        """The attached labels."""
        return F.col("detected")

    def fact(self, label: Column, name: str) -> Column:
        """An attached runbook field."""
        return F.col("_fact")[name]

    def severities(self, label: Column) -> Column:
        """The attached severities."""
        return F.col("_allowed")

    def concrete(self, label: Column) -> Column:
        """Whether a runbook was found for the label."""
        return F.col("_fact").isNotNull()

    def cites(self, runbook_id: Column) -> Column:
        """Whether a runbook with that id was found."""
        return F.coalesce("_book", F.lit(False))

    def known_sub_cause(self, label: Column, sub_cause: Column) -> Column:
        """Whether the sub cause was found for the label."""
        return F.coalesce("_sub", F.lit(False))


def parse_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``think``, ``loose`` (keys as JSON text), ``parse_ok``, ``pkg`` and ``type_error``.

    ``parse_ok`` comes from the loose parse; a wrong type deep in the package only blanks that
    field and sets ``type_error``.
    """
    text = F.coalesce(F.col(answer), F.lit(""))
    split = answers.withColumns({"think": A.think_text(text), "_body": A.after_think(text)})
    typed = F.from_json(
        A.json_start(F.col("_body")), f"{PACKAGE}, _bad STRING",
        {**A.STRICT, "columnNameOfCorruptRecord": "_bad"},
    )
    parsed = pin(split).withColumns({"loose": A.loose_json(F.col("_body")), "pkg": typed})
    return parsed.withColumns({
        "parse_ok": F.col("loose").isNotNull(),
        "type_error": F.col("loose").isNotNull() & F.col("pkg._bad").isNotNull(),
    }).drop("_body")


def reasoning_scope(think: Column, pkg: Column) -> Column:
    """Text in which claims count: thinking, reasons, evidence, checks and the customer ladder.

    Fields copied from a runbook are left out, they may mention checks legitimately.
    """
    none = X.strings(())
    diagnosis, ladder = pkg["diagnosis"], pkg["customer_self_service"]
    steps = F.flatten(F.transform(
        ladder, lambda s: F.array(s["action"], s["verify"], s["if_fails"])
    ))
    parts = F.concat(
        F.array(think, pkg["why_plain"], pkg["why_technical"]),
        F.coalesce(diagnosis["evidence_in_ticket"], none),
        F.coalesce(diagnosis["to_confirm"], none),
        F.coalesce(F.transform(diagnosis["differential"], lambda d: d["why"]), none),
        F.coalesce(steps, none),
    )
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


def customer_scope(pkg: Column) -> Column:
    """Text that reaches the customer: ladder actions, the mail and the offer."""
    actions = F.transform(pkg["customer_self_service"], lambda s: s["action"])
    rest = F.array(pkg["artifacts"]["customer_email"], pkg["compensation"]["offer"])
    return F.array_join(F.concat(F.coalesce(actions, X.strings(())), rest), "\n", "")


def ladder_ok(ladder: Column) -> Column:
    """At least three steps, numbered 1..n, each with an action."""
    numbered = F.transform(
        ladder,
        lambda s, i: F.coalesce(s["tier"] == i + 1, F.lit(False)) & ~X.is_blank(s["action"]),
    )
    return F.coalesce((F.size(ladder) >= 3) & F.forall(numbered, lambda x: x), F.lit(False))


def package_complete(loose: Column) -> Column:
    """Every required field is present and not empty."""
    ok = F.lit(True)
    for name in REQUIRED_FIELDS:
        value = F.coalesce(F.try_element_at(loose, F.lit(name)), F.lit(""))
        ok = ok & ~value.isin("", "[]", "{}")
    return F.coalesce(ok, F.lit(False))


def artifacts_valid(pkg: Column) -> Column:
    """All four artifacts carry text."""
    ok = F.lit(True)
    for name in ARTIFACTS:
        ok = ok & ~X.is_blank(pkg["artifacts"][name])
    return ok


def _same(found: Column, expected: Column) -> Column:
    return F.coalesce(X.strip(found), F.lit("")) == F.coalesce(X.strip(expected), F.lit(""))


def fidelity_failures(pkg: Column, label: Column, book: RuleBook | RuleTables) -> Column:
    """What differs from the label's runbook."""
    severity = F.coalesce(X.strip(pkg["severity"]), F.lit(""))
    allowed = F.exists(book.severities(label), lambda a: F.startswith(severity, a))
    rules = [(_same(pkg["runbook_id"], book.fact(label, "runbook_id")), "runbook_id differs")]
    rules += [(_same(pkg[n], book.fact(label, n)), f"{n} differs") for n in COPIED_FIELDS]
    rules += [
        (F.coalesce(allowed, F.lit(False)), "severity is not allowed"),
        (_same(pkg["priority"], book.fact(label, "priority")), "priority differs"),
    ]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(text)) for ok, text in rules]))


def judge_answers(answers: DataFrame, book: RuleBook | RuleTables, ticket: str = "complaint",
                  answer: str = "answer", trust_label: bool = False) -> DataFrame:
    """Add the parsed answer, the rule flags and the ``verdict`` struct.

    ``trust_label`` accepts any known label without a cue; it is for authored cases whose author,
    not the cue list, decides.
    """
    parsed = parse_answers(answers, answer)
    norm = X.normalise(F.coalesce(F.col(ticket), F.lit("")))
    stage1 = parsed.withColumns({
        "label": F.coalesce(X.strip(F.col("pkg.diagnosis.leading_root_cause")), F.lit("")),
        "confidence": A.to_number(F.col("pkg.diagnosis.confidence")),
        "evidence": F.coalesce(F.col("pkg.diagnosis.evidence_in_ticket"), X.strings(())),
        "sub_cause": F.coalesce(X.strip(F.col("pkg.diagnosis.sub_cause")), F.lit("")),
        "_norm": norm, "_cited": F.coalesce(X.strip(F.col("pkg.runbook_id")), F.lit("")),
        "_claims_in": F.when(F.col("parse_ok"), reasoning_scope(F.col("think"), F.col("pkg")))
        .otherwise(F.col("think")),
        "_promises_in": customer_scope(F.col("pkg")),
    })
    stage2 = book.attach(pin(stage1)).withColumns({
        "detected": book.detected(F.col("_norm")),
        "_tokens": X.norm_tokens(F.col("_norm")),
        "claim_hits": X.pattern_hits(F.col("_claims_in"), book.claim_patterns),
        "promise_hits": X.pattern_hits(F.col("_promises_in"), book.promise_patterns),
        "ladder_ok": ladder_ok(F.col("pkg.customer_self_service")),
        "fidelity": F.when(
            book.concrete(F.col("label")),
            fidelity_failures(F.col("pkg"), F.col("label"), book),
        ),
    })
    stage3 = pin(stage2).withColumn(
        "ungrounded",
        F.filter("evidence", lambda e: ~F.coalesce(
            X.is_grounded(e, F.col("_tokens")), F.lit(False))),
    )
    judged = pin(_with_verdict(pin(stage3), book, trust_label))
    return judged.drop("_norm", "_cited", "_tokens", "_claims_in", "_promises_in", "_fact", "_allowed", "_sub", "_book")


def judge_repeated(answers: DataFrame, book: RuleBook | RuleTables, **options) -> DataFrame:
    """:func:`judge_answers` of each distinct row, with how often it occurs as ``times``.

    For answers that repeat: a verdict says nothing of the row but what its columns hold. Equal rows are combined before
    the shuffle.
    """
    counted = answers.groupBy(*answers.columns).agg(F.count(F.lit(1)).alias("times"))
    return judge_answers(cut_lineage(counted), book, **options)


def _with_verdict(df: DataFrame, book: RuleBook | RuleTables, trust_label: bool) -> DataFrame:
    label, conf = F.col("label"), F.col("confidence")
    concrete, abstains = book.concrete(label), label == book.abstain
    if trust_label:
        cue_ok = concrete | abstains
    else:
        cue_ok = (
            F.when(abstains, F.size("detected") != 1)
            .when(concrete, F.array_contains("detected", label)).otherwise(F.lit(False))
        )
    limit = F.when(abstains, F.lit(MAX_ABSTAIN_CONFIDENCE)).otherwise(F.lit(MAX_CONFIDENCE))
    routed = ~book.cites(F.col("_cited"))
    sub = F.col("sub_cause")
    rules = df.withColumns({
        "no_claims": F.size("claim_hits") == 0,
        "cue_grounding": F.size("ungrounded") == 0,
        "label_cue": cue_ok,
        "calibrated": F.coalesce(conf <= limit, F.lit(False)),
        "runbook_ok": F.coalesce(F.size("fidelity") == 0, routed),
        "sub_cause_ok": (sub == "") | (concrete & book.known_sub_cause(label, sub)),
        "no_promises": F.size("promise_hits") == 0,
    })
    quoted = F.concat(F.lit("'"), label, F.lit("'"))
    cue_text = (
        F.when(~(concrete | abstains), F.concat(F.lit("unknown label: "), quoted))
        .when(abstains, F.lit("abstained although exactly one label has a cue"))
        .otherwise(F.concat(F.lit("no cue supports label "), quoted))
    )
    said = [
        (F.col("no_claims"), F.concat(F.lit("unsupported claims: "), _list("claim_hits"))),
        (F.col("cue_grounding"), F.concat(F.lit("ungrounded evidence: "), _list("ungrounded"))),
        (F.col("label_cue"), cue_text),
        (F.col("calibrated"), F.when(conf.isNull(), F.lit("missing or invalid confidence"))
         .otherwise(F.concat(F.lit("confidence above "), limit.cast("string")))),
        (F.col("runbook_ok"), F.coalesce(
            F.concat(F.lit("runbook: "), _list("fidelity")),
            F.lit("an abstention must not cite a runbook"))),
        (F.col("sub_cause_ok"), F.concat(F.lit("unknown sub cause: "), sub)),
        (F.col("ladder_ok"), F.lit("self-service ladder is missing, short or misnumbered")),
        (F.col("no_promises"), F.concat(F.lit("promises: "), _list("promise_hits"))),
    ]
    failures = F.array_compact(F.array(*[F.when(~ok, text) for ok, text in said]))
    ok = F.lit(True)
    for passed, _ in said:
        ok = ok & passed
    verdict = F.when(F.col("parse_ok"), F.struct(
        ok.alias("ok"), failures.alias("failures"),
        F.col("cue_grounding"), F.col("no_claims").alias("no_fabricated_telemetry"),
        F.col("label_cue").alias("rc_cue_match"), F.col("runbook_ok").alias("runbook_fidelity"),
        F.col("calibrated").alias("calibration"), F.col("claim_hits").alias("telemetry_hits"),
    )).otherwise(F.struct(
        F.lit(False).alias("ok"),
        F.array(F.lit("no JSON package in the answer")).alias("failures"),
        F.lit(True).alias("cue_grounding"), F.col("no_claims").alias("no_fabricated_telemetry"),
        F.lit(True).alias("rc_cue_match"), F.lit(True).alias("runbook_fidelity"),
        F.lit(True).alias("calibration"), X.strings(()).alias("telemetry_hits"),
    ))
    return rules.withColumn("verdict", verdict)


def _list(name: str) -> Column:
    return F.array_join(F.col(name), "; ")


def accept(judged: DataFrame) -> DataFrame:
    """The gate: only answers that pass every rule."""
    return judged.where("verdict.ok")


def require_accepted(judged: DataFrame) -> DataFrame:
    """Fail the job with the reasons of a rejected answer (for authored seeds)."""
    why = F.concat(F.lit("rejected seed: "), F.array_join("verdict.failures", " | "))
    checked = F.when(F.col("verdict.ok"), F.col("answer")).otherwise(F.raise_error(why))
    return judged.withColumn("answer", checked)


def score_samples(judged: DataFrame, book: RuleBook, gold: str = "gold_rc") -> DataFrame:
    """The per-answer fact row from judged answers that carry ``id``, ``slice`` and the gold label.

    Without evidence nothing is made up, so the grounded share is 1; an unparsed answer has 0.
    """
    ok, label = F.col("parse_ok"), F.col("label")
    pred = F.when(ok & (label != ""), label).otherwise(F.lit(PARSE_FAIL))
    scored = judged.withColumn("pred_rc", pred)
    concrete = F.col("pred_rc").isin(*book.labels)
    n = F.size("evidence")
    share = F.when(n > 0, (n - F.size("ungrounded")) / n.cast("double")).otherwise(F.lit(1.0))
    abstains = F.col("pred_rc") == book.abstain
    return scored.select(
        "id", "slice", F.col(gold).alias("gold_rc"), "pred_rc",
        (F.col("pred_rc") == F.col(gold)).alias("correct"),
        F.when(ok, F.col("confidence")).alias("confidence"),
        F.when(ok, share).otherwise(F.lit(0.0)).alias("cue_grounded_frac"),
        F.col("no_claims").alias("no_fabricated_telemetry"),
        F.when(concrete, package_complete(F.col("loose"))).otherwise(abstains)
        .alias("runbook_complete"),
        F.when(concrete, F.size("fidelity") == 0).otherwise(abstains).alias("runbook_fidelity"),
        (ok & artifacts_valid(F.col("pkg"))).alias("artifacts_valid"),
        (ok & F.col("ladder_ok")).alias("self_service_ok"),
        F.when(ok, F.col("claim_hits")).otherwise(X.strings(())).alias("telemetry_hits"),
    )
