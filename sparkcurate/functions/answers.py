"""Expressions that read model answers: thinking block, JSON package, tool calls, verdict text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.numbers import clamp
from sparkcurate.functions.text import is_blank, let, strip

#: JSON the way a strict decoder reads it.
STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}

LOOSE = "map<string,string>"

# Fixed values. The written form of tool calls.
TOOL_CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
TOOL_FUNCTION = r"(?s)<function=([^>\s]+)>(.*?)</function>"
TOOL_PARAMETER = r"(?s)<parameter=([^>\s]+)>\s*(.*?)\s*</parameter>"


def think_text(text: Column) -> Column:
    """Content of the first thinking block, '' without one."""
    return strip(F.regexp_extract(text, r"(?is)<think>(.*?)</think>", 1))


def after_think(text: Column) -> Column:
    """What follows the first thinking block; the whole text without one."""
    return strip(F.regexp_replace(text, r"(?is)\A.*?<think>.*?</think>", ""))


def json_start(text: Column) -> Column:
    """The text from its first opening brace on, NULL without one."""
    at = F.instr(text, "{")
    return F.when(at > 0, F.substr(text, at))


def loose_json(text: Column) -> Column:
    """Top-level keys of the first JSON object, values as JSON text; NULL if it does not parse."""
    return F.from_json(json_start(text), LOOSE, STRICT)


def one_value(text: Column) -> Column:
    """``ARRAY`` of the one JSON value a text consists of (objects as JSON text); NULL for any other text.

    The text is parsed as the first of two array elements; the second is a digest of the text, so that
    commas, brackets or further values in the text cannot pass for the end of the array.
    """
    mark = F.md5(text)
    found = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", STRICT)
    return F.when((F.size(found) == 2) & (F.get(found, 1) == mark) & ~is_blank(text), F.slice(found, 1, 1))


def one_object(text: Column) -> Column:
    """The JSON text of the one object a text consists of; NULL for any other text."""
    value = F.get(one_value(text), 0)
    return F.when(F.startswith(strip(text), F.lit("{")) & F.startswith(value, F.lit("{")), value)


def whole_json(text: Column) -> Column:
    """Like :func:`loose_json` for a text that must be one JSON object and nothing else."""
    return F.from_json(one_object(text), LOOSE, STRICT)


def to_number(value: Column) -> Column:
    """A JSON scalar's text as a double (booleans count as 1 and 0), NULL if it is no number."""
    text = F.lower(strip(value))
    return (
        F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0))
        .otherwise(text.try_cast("double"))
    )


def judge_json(text: Column) -> Column:
    """The object between the first opening and the last closing brace, or an empty map."""
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    empty = F.create_map().cast(LOOSE)
    return F.coalesce(whole_json(F.nullif(span, F.lit(""))), empty)


def judge_score(parsed: Column, criterion: str) -> Column:
    """A criterion's score limited to 1..5, 3 if missing or not a number."""
    value = to_number(F.try_element_at(parsed, F.lit(criterion)))
    return F.coalesce(clamp(value), F.lit(3.0))


def judge_winner(parsed: Column) -> Column:
    """The pairwise verdict ``A``, ``B`` or ``tie``."""
    said = F.upper(strip(F.coalesce(F.try_element_at(parsed, F.lit("winner")), F.lit(""))))
    return F.when(said.isin("A", "B"), said).otherwise(F.lit("tie"))


def looks_like_tool_call(text: Column) -> Column:
    """Whether a tool call is being written."""
    return text.contains("<tool_call>") | text.contains("<function=")


def _coerced(value: Column) -> Column:
    trimmed = strip(value)
    whole = trimmed.try_cast("decimal(38,0)").cast("string")
    return F.when(trimmed.rlike(r"\A-?\d+\z"), F.coalesce(whole, trimmed)).otherwise(trimmed)


def tool_calls(text: Column) -> Column:
    """``ARRAY<STRUCT<name, arguments MAP>>`` of the JSON and the tag form; bad JSON is skipped."""
    bodies = F.regexp_extract_all(text, F.lit(TOOL_CALL), 1)
    empty = F.create_map().cast(LOOSE)

    def from_object(body: Column) -> Column:
        def build(parsed: Column) -> Column:
            arguments = F.from_json(F.try_element_at(parsed, F.lit("arguments")), LOOSE, STRICT)
            call = F.struct(
                F.try_element_at(parsed, F.lit("name")).alias("name"),
                F.coalesce(arguments, empty).alias("arguments"),
            )
            return F.when(parsed.isNotNull(), call)

        return let(whole_json(body), build)

    def from_tags(body: Column) -> Column:
        pattern = TOOL_FUNCTION
        name = F.regexp_extract(body, pattern, 1)
        inner = F.regexp_extract(body, pattern, 2)
        parameter = F.lit(TOOL_PARAMETER)
        keys = F.regexp_extract_all(inner, parameter, 1)
        values = F.transform(F.regexp_extract_all(inner, parameter, 2), _coerced)
        last = F.filter(  # a repeated parameter keeps its last value
            F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(
                F.lit(1), F.greatest(F.size(keys), F.lit(1))).alias("i")),
            lambda e: (e["i"] <= F.size(keys)) & ~F.array_contains(
                F.slice(keys, e["i"] + 1, F.greatest(F.size(keys), F.lit(1))), e["k"]),
        )
        arguments = F.map_from_entries(
            F.transform(last, lambda e: F.struct(e["k"], e["v"]))
        )
        call = F.struct(name.alias("name"), arguments.alias("arguments"))
        return F.when(name != "", call)

    calls = F.transform(
        bodies, lambda b: F.when(F.startswith(b, F.lit("{")), from_object(b)).otherwise(from_tags(b))
    )
    return F.array_compact(calls)
