"""Chat operators on turn tables (one row per turn) and on record tables.

A conversation in a turn table may be of any size, so nothing here gathers a conversation in one
task: positions come from two-level running totals, neighbours from equi joins on (key, turn).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions import chat as C
from sparkcurate.functions.text import is_blank
from sparkcurate.operators.order import running_total
from sparkcurate.schemas import ROLES


def turn_segments(turns: DataFrame, key: str, turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """Rendered turns with their character offsets in the rendered conversation.

    Concatenating ``segment`` by ``turn`` gives the conversation; ``start``/``end`` bound the
    content of the turn.
    """
    r, t = F.col(role), F.coalesce(F.col(text), F.lit(""))
    offset = running_total(turns, [key], turn, C.segment_length(r, t), "_at")
    start = F.col("_at") + C.header_length(r)
    return offset.select(
        key, turn, role, C.segment(r, t).alias("segment"), start.cast("long").alias("start"),
        (start + F.length(t)).cast("long").alias("end"),
    )


def assistant_spans(turns: DataFrame, key: str, turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """Content offsets of every assistant turn."""
    spans = turn_segments(turns, key, turn, role, text).where(F.col(role) == "assistant")
    return spans.select(key, turn, "start", "end")


def next_turns(turns: DataFrame, key: str, turn: str = "turn", role: str = "role",
               text: str = "text", first: str = "user", second: str = "assistant") -> DataFrame:
    """Turns of one role directly followed by a turn of another: (key, turn, prompt, answer)."""
    asked = turns.where(F.col(role) == first).select(key, turn, F.col(text).alias("prompt"))
    given = turns.where(F.col(role) == second).select(
        key, (F.col(turn) - 1).alias(turn), F.col(text).alias("answer"))
    return asked.join(given, [key, turn])


def gold_turns(turns: DataFrame, key: str, turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """Gold form of conversations without a given reference, turn by turn.

    The last assistant turn is the ``reference``; earlier turns are the ``prompt``; later ones go.
    A conversation without an assistant turn, or starting with its only one, is all prompt.
    """
    last = turns.groupBy(key).agg(
        F.max(F.when(F.col(role) == "assistant", F.col(turn))).alias("_last"),
        F.min(turn).alias("_first"),
    )
    joined = turns.join(last, key)
    whole = F.col("_last").isNull() | (F.col("_last") == F.col("_first"))
    part = (
        F.when(F.col(turn) == F.col("_last"), F.lit("reference"))
        .when(whole | (F.col(turn) < F.col("_last")), F.lit("prompt"))
    )
    return joined.withColumn("part", part).where(F.col("part").isNotNull()).select(
        key, turn, role, text, "part")


def conversation_checks(turns: DataFrame, key: str, role: str = "role",
                        text: str = "text") -> DataFrame:
    """Contract flags per conversation from one partial aggregation over its turns."""
    r = F.col(role)
    known = F.coalesce(r.isin(*ROLES), F.lit(False))
    flags = turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"), F.bool_and(known).alias("roles_known"),
        F.bool_and(~is_blank(F.col(text))).alias("filled"),
        F.coalesce(F.bool_or(r == "assistant"), F.lit(False)).alias("has_assistant"),
        F.coalesce(F.bool_or(r == "user"), F.lit(False)).alias("has_user"),
        F.coalesce(F.bool_or(r == "system"), F.lit(False)).alias("has_system"),
        F.count_if(r == "assistant").alias("assistant_turns"),
    )
    rules = [
        ("roles_known", "messages: unknown role"), ("filled", "messages: content is blank"),
        ("has_assistant", "messages: needs an assistant turn"),
        ("has_user", "messages: needs a user turn"),
    ]
    errors = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(t)) for c, t in rules]))
    return flags.withColumn("errors", errors).withColumns({
        "first_error": F.get("errors", F.lit(0)), "valid": F.size("errors") == 0,
    })


def inject_system(turns: DataFrame, key: str, prompt: str, turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """Add a system turn in front of conversations without one, as turn ``first - 1``."""
    lacking = turns.groupBy(key).agg(
        F.min(turn).alias("_first"), F.bool_or(F.col(role) == "system").alias("_has"),
    ).where(~F.col("_has"))
    added = lacking.select(
        key, (F.col("_first") - 1).alias(turn), F.lit("system").alias(role),
        F.lit(prompt).alias(text))
    return turns.select(key, turn, role, text).unionByName(added)


def training_rows(records: DataFrame, thinking: bool = False) -> DataFrame:
    """(id, messages, text) of chat and reasoning records; a preference record is an error."""
    reasoning = F.array(
        C.message("user", F.col("situation")),
        C.message("assistant", C.fold_reasoning(F.col("reasoning"), F.col("response"), thinking)),
    )
    refuse = F.raise_error(F.concat(F.lit("no training messages for "), F.col("data_type")))
    messages = (
        F.when(F.col("data_type") == "sft", C.plain_messages(F.col("messages")))
        .when(F.col("data_type") == "reasoning", reasoning)
        .otherwise(refuse.cast(C.MESSAGES))
    )
    return records.select("id", messages.alias("messages")).withColumn(
        "text", C.render(F.col("messages")))


def gold_cases(raw: DataFrame) -> DataFrame:
    """Normalised gold cases from rows of the gold schema (variants coalesced)."""
    single = F.coalesce("prompt", "question", "situation", "input")
    asked = F.when(single.isNotNull(), F.array(C.message("user", single)))
    messages = F.coalesce(F.col("messages"), asked)
    base = raw.withColumns({
        "_m": messages,
        "_own": F.when(F.col("messages").isNotNull(), F.col("messages")),
    })
    fallbacks = [F.col(c) for c in ("response", "answer", "gold", "expected")]
    return base.select(
        "id", "mode", "persona", "leading_root_cause",
        F.when(F.col("_own").isNotNull(), C.gold_prompt(F.col("_own"), F.col("reference")))
        .otherwise(F.col("_m")).alias("messages"),
        F.when(F.col("_own").isNotNull(),
               C.gold_reference(F.col("_own"), F.col("reference"), *fallbacks))
        .otherwise(F.coalesce(
            F.nullif(F.col("reference"), F.lit("")),
            *[F.nullif(f, F.lit("")) for f in fallbacks], F.lit(""))).alias("reference"),
    )


def labelled_gold(raw: DataFrame, abstain: str, position: str = "pos") -> DataFrame:
    """(id, slice, complaint, gold_rc, reference) of labelled gold rows.

    The ticket is the user turns joined by newlines; ids default to ``case-<position>``, labels to
    the abstention.
    """
    messages = F.coalesce(
        F.col("messages"), F.array(C.message("user", F.coalesce("prompt", F.lit("")))))
    return raw.select(
        F.coalesce("id", F.concat(F.lit("case-"), F.col(position).cast("string"))).alias("id"),
        F.coalesce("mode", F.lit("unknown")).alias("slice"),
        C.user_text(messages).alias("complaint"),
        F.coalesce("leading_root_cause", F.lit(abstain)).alias("gold_rc"),
        F.coalesce("reference", F.lit("")).alias("reference"),
    )


def judge_prompts(df: DataFrame, template: str, fields: dict[str, Column]) -> DataFrame:
    """Add ``judge_prompt``: the template with ``{name}`` replaced by columns, left to right.

    The template is cut at its placeholders first, so braces inside the texts stay as they are.
    """
    parts: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in fields if "{" + n + "}" in rest]
        if not spots:
            parts.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2:]
    return df.withColumn("judge_prompt", F.concat(*parts))


def rubric_block(descriptions: dict[str, str], criteria: Sequence[str]) -> str:
    """The scoring guide: one ``- name: description`` line per criterion."""
    return "\n".join(f"- {c}: {descriptions.get(c, '')}" for c in criteria)
