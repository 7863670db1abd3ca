"""Expressions over ``ARRAY<STRUCT<role, content>>`` message lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.text import is_blank

# Fixed values. Turn tokens of the plain chat rendering.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"

MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str | Column, content: Column) -> Column:
    """One message struct."""
    role_col = F.lit(role) if isinstance(role, str) else role
    return F.struct(role_col.alias("role"), content.alias("content"))


def plain_messages(messages: Column) -> Column:
    """Role and content only; anything else in the structs is dropped."""
    return F.transform(messages, lambda m: message(m["role"], m["content"]))


def contents(messages: Column) -> Column:
    """The list of message texts."""
    return F.transform(messages, lambda m: F.coalesce(m["content"], F.lit("")))


def joined(messages: Column) -> Column:
    """All message texts joined by newlines."""
    return F.array_join(contents(messages), "\n")


def user_text(messages: Column) -> Column:
    """The user turns joined by newlines."""
    return joined(F.filter(messages, lambda m: m["role"] == "user"))


def assistant_turns(messages: Column) -> Column:
    """Number of assistant turns."""
    return F.size(F.filter(messages, lambda m: m["role"] == "assistant"))


def has_role(messages: Column, role: str) -> Column:
    """Whether any turn has the role."""
    return F.exists(messages, lambda m: m["role"] == role)


def with_system(messages: Column, prompt: str | None) -> Column:
    """Put a system turn first unless there is one already (or no prompt is given)."""
    if not prompt:
        return messages
    added = F.concat(F.array(message("system", F.lit(prompt))), messages)
    return F.when(has_role(messages, "system"), messages).otherwise(added)


def segment(role: Column, content: Column) -> Column:
    """The rendered form of a single turn."""
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), content, F.lit(TURN_END + "\n"))


def render(messages: Column) -> Column:
    """The rendered conversation."""
    return F.array_join(F.transform(messages, lambda m: segment(m["role"], m["content"])), "")


def header_length(role: Column) -> Column:
    """Characters in front of the content of a rendered turn."""
    return F.length(role) + F.lit(len(TURN_START) + 1)


def segment_length(role: Column, content: Column) -> Column:
    """Characters of a whole rendered turn."""
    return header_length(role) + F.length(content) + F.lit(len(TURN_END) + 1)


def assistant_spans(messages: Column) -> Column:
    """``ARRAY<STRUCT<start, end>>``: content offsets of every assistant turn in :func:`render`."""
    span = "array<struct<start:int,end:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + header_length(m["role"])
        end = begin + F.length(m["content"])
        grown = F.concat(
            state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))
        )
        spans = F.when(m["role"] == "assistant", grown).otherwise(state["spans"])
        return F.struct((end + F.lit(len(TURN_END) + 1)).alias("at"), spans.alias("spans"))

    return F.aggregate(messages, start, step, lambda state: state["spans"])


def fold_reasoning(steps: Column, response: Column, thinking: bool) -> Column:
    """The assistant text of a reasoning record, with its steps in a thinking block if asked."""
    if not thinking:
        return response
    return think_block(F.array_join(steps, "\n"), response)


def think_block(think: Column, answer: Column) -> Column:
    """A thinking block followed by the answer."""
    return F.concat(F.lit("<think>\n"), think, F.lit("\n</think>\n"), answer)


def _last_assistant(messages: Column) -> Column:
    """1-based position of the last assistant turn, 0 without one."""
    roles = F.reverse(F.transform(messages, lambda m: m["role"]))
    back = F.array_position(roles, "assistant")
    return F.when(back > 0, F.size(messages) - back + 1).otherwise(F.lit(0))


def gold_prompt(messages: Column, reference: Column) -> Column:
    """Prompt turns of a gold case.

    With a reference, only a trailing assistant turn is dropped. Without one, the prompt ends in
    front of the last assistant turn. A prompt that would be empty stays as it was.
    """
    last = _last_assistant(messages)
    given = F.coalesce(reference, F.lit("")) != ""
    trailing = last == F.size(messages)
    keep = F.when(given & trailing, F.size(messages) - 1)
    keep = keep.when(~given & (last > 0), last - 1).otherwise(F.size(messages))
    cut = F.slice(messages, F.lit(1), F.greatest(keep, F.lit(0)).cast("int"))
    return F.when(F.size(cut) > 0, cut).otherwise(messages)


def gold_reference(messages: Column, reference: Column, *fallbacks: Column) -> Column:
    """The reference: as given, else the last assistant turn, else the first non-empty fallback."""
    last = _last_assistant(messages)
    turn = F.get(messages, (last - 1).cast("int"))["content"]
    options = [F.nullif(reference, F.lit("")), F.when(last > 0, F.nullif(turn, F.lit("")))]
    options += [F.nullif(f, F.lit("")) for f in fallbacks]
    return F.coalesce(*options, F.lit(""))


def all_filled(messages: Column) -> Column:
    """Whether no message is blank."""
    return F.forall(messages, lambda m: ~is_blank(m["content"]))

