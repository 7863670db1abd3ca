"""Record contract: rule columns, quarantine and validation statistics.

Every rule is a boolean expression with a message; a row is valid when no message remains. All of it
is row-local, so validation adds no shuffle; the statistics are one partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.chat import all_filled, has_role
from sparkcurate.functions.text import is_blank, strings
from sparkcurate.schemas import (
    CONVERSATION_TYPES,
    DATA_TYPES,
    KEEP_AUDIT,
    MODES,
    ROLES,
    WEIGHTS,
)

Rule = tuple[Column, str]


def _filled(column: Column) -> Column:
    return F.coalesce(F.length(column) >= 1, F.lit(False))


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def conversation_type(column: Column) -> Column:
    """``single_turn`` is an alias of ``single``; the default is ``multi_turn``."""
    named = F.when(column == "single_turn", F.lit("single")).otherwise(column)
    return F.coalesce(named, F.lit("multi_turn"))


def common_rules(modes: Sequence[str] = MODES) -> list[Rule]:
    """Metadata every record needs. A blank id is accepted, an empty one is not."""
    return [
        (_filled(F.col("id")), "id: must not be empty"),
        (_true(F.col("mode").isin(*modes)), "mode: unknown value"),
        (_filled(F.col("persona")), "persona: must not be empty"),
        (_filled(F.col("version")), "version: must not be empty"),
        (_filled(F.col("audit_status")), "audit_status: must not be empty"),
    ]


def message_rules(name: str) -> list[Rule]:
    """A non-empty list of messages with known roles, filled texts and no other keys."""
    messages = F.col(name)
    known = F.forall(messages, lambda m: _true(m["role"].isin(*ROLES)))
    rules = [
        (_true(F.size(messages) >= 1), f"{name}: must not be empty"),
        (_true(known), f"{name}: unknown role"),
        (_true(all_filled(messages)), f"{name}: message content must not be blank"),
    ]
    return rules


def extra_key_rule(name: str, keyed: Column) -> Rule:
    """No message has keys besides role and content. ``keyed`` holds the messages as maps."""
    allowed = strings(("role", "content"))
    closed = F.forall(keyed, lambda m: F.size(F.array_except(F.map_keys(m), allowed)) == 0)
    return (F.coalesce(closed, F.lit(True)), f"{name}: message has forbidden keys")


def sft_rules(keyed: bool = False) -> list[Rule]:
    """Chat record: at least one assistant and one user turn."""
    messages = F.col("messages")
    return [
        (conversation_type(F.col("conversation_type")).isin(*CONVERSATION_TYPES),
         "conversation_type: unknown value"),
        *message_rules("messages"),
        *([extra_key_rule("messages", F.col("keys.messages"))] if keyed else []),
        (_true(has_role(messages, "assistant")), "messages: needs an assistant turn"),
        (_true(has_role(messages, "user")), "messages: needs a user turn"),
    ]


def reasoning_rules() -> list[Rule]:
    """Reasoning record: a situation, at least one step, no blank step, a response."""
    steps = F.col("reasoning")
    return [
        (_filled(F.col("situation")), "situation: must not be empty"),
        (_true(F.size(steps) >= 1), "reasoning: must not be empty"),
        (_true(F.forall(steps, lambda s: ~is_blank(s))), "reasoning: steps must not be blank"),
        (_filled(F.col("response")), "response: must not be empty"),
    ]


def preference_rules(keyed: bool = False) -> list[Rule]:
    """Preference pair: a user turn in the prompt, only assistant turns in the completions."""
    rules: list[Rule] = []
    for name in ("prompt", "chosen", "rejected"):
        rules += message_rules(name)
        if keyed:
            rules.append(extra_key_rule(name, F.col(f"keys.{name}")))
        if name == "prompt":
            rules.append((_true(has_role(F.col(name), "user")), "prompt: needs a user turn"))
        else:
            answers = F.forall(F.col(name), lambda m: _true(m["role"] == "assistant"))
            rules.append((_true(answers), f"{name}: turns must all be assistant"))
    return rules


def messages_of(rules: Sequence[Rule], prefix: str = "") -> Column:
    """The messages of the rules that fail, in rule order."""
    return F.array_compact(
        F.array(*[F.when(~passed, F.lit(f"{prefix}{text}")) for passed, text in rules])
    )


def check_records(
    records: DataFrame, modes: Sequence[str] = MODES, keyed: bool = False
) -> DataFrame:
    """Add ``errors``, ``first_error`` and ``valid`` to rows of the record schema.

    Rules are chosen by ``data_type``. With ``keyed`` the frame carries a ``keys`` struct of the
    message lists as maps. Rows that did not decode carry ``decoded = false`` if they have it.
    """
    common = common_rules(modes)
    by_type = {
        "sft": common + sft_rules(keyed),
        "reasoning": common + reasoning_rules(),
        "preference": common + preference_rules(keyed),
    }
    errors = None
    for name in DATA_TYPES:
        found = messages_of(by_type[name], f"{name}.")
        test = F.col("data_type") == name
        errors = F.when(test, found) if errors is None else errors.when(test, found)
    errors = errors.otherwise(F.array(F.lit("data_type: unknown value")))
    if "decoded" in records.columns:
        errors = F.when(F.col("decoded"), errors).otherwise(F.array(F.lit("invalid JSON")))
    checked = records.withColumn("errors", errors)
    return checked.withColumns({
        "first_error": F.get(F.col("errors"), F.lit(0)),
        "valid": F.size("errors") == 0,
    })


def keep_audited(checked: DataFrame, keep: Sequence[str] | None = KEEP_AUDIT) -> DataFrame:
    """Valid rows with a kept audit status; ``None`` keeps every valid row."""
    valid = checked.where("valid")
    return valid if keep is None else valid.where(F.col("audit_status").isin(*keep))


def validation_stats(
    checked: DataFrame, by: Sequence[str] = (), keep: Sequence[str] | None = KEEP_AUDIT
) -> DataFrame:
    """total, valid, invalid, kept and filtered_out; per group and overall when ``by`` is given.

    ``filtered_out`` counts valid rows only, hence the audit filter must not run before the rules.
    """
    kept = F.col("valid")
    if keep is not None:
        kept = kept & F.col("audit_status").isin(*keep)
    grouped = checked.rollup(*by) if by else checked.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(kept).alias("kept"),
        (F.count_if("valid") - F.count_if(kept)).alias("filtered_out"),
    )


def valid_distribution(checked: DataFrame) -> DataFrame:
    """Counts of valid rows by data type and by mode in long form, from one pass."""
    pair = F.explode(F.array(
        F.struct(F.lit("data_type").alias("dimension"), F.col("data_type").alias("value")),
        F.struct(F.lit("mode").alias("dimension"), F.col("mode").alias("value")),
    ))
    return (
        checked.where("valid").select(pair.alias("p")).groupBy("p.dimension", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Row counts per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def missing_values(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Expected values that never occur. The expectation is a parameter list, so it is tiny."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in expected], f"{column} STRING")
    # distinct first: the anti join then meets each value once, however hot it is
    return wanted.join(df.select(column).distinct(), column, "left_anti")


def rubric_in_range(scores: DataFrame, criteria: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """Add ``in_range``: every criterion lies in 1..5."""
    ok = F.lit(True)
    for criterion in criteria:
        ok = ok & F.coalesce(F.col(criterion).between(1, 5), F.lit(False))
    return scores.withColumn("in_range", ok)


def deny_judges(df: DataFrame, denied: Sequence[str], column: str = "judge") -> DataFrame:
    """Fail the job on a denied judge, whatever its letter case."""
    banned = F.lower(F.col(column)).isin(*[d.lower() for d in denied])
    # raised inside the column itself, so that no optimiser rule can drop the check
    refused = F.raise_error(F.concat(F.lit("judge is not allowed: "), F.col(column)))
    return df.withColumn(column, F.when(banned, refused).otherwise(F.col(column)))
