"""Spans of patterns in texts, as columns: code point offsets, counts, and their digests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.llm.common import let

#: Fields of a span. ``rank`` is the place of its kind in the list of kinds; ``before`` is the text
#: between the previous match of the pattern and this one, at most its last characters.
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string>>"

#: Characters of ``before``.
CONTEXT = 64


def pattern_spans(text: Column, kind: str, rank: int, pattern: str,
                  keep: Callable[[Column, Column], Column] | None = None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a Java pattern, as spans.

    What lies between matches gives their offsets: the text is split at the pattern, and the lengths of
    pieces and matches are summed up. ``keep(match, group)`` drops matches without trying others in
    their place. Null texts have no spans.
    """
    def walk(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        parts = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), F.arrays_zip(
            found.alias("m"), values.alias("v")), lambda piece, m: F.struct(
                piece.alias("p"), m["m"].alias("m"), m["v"].alias("v")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + F.length(x["p"])
            end = begin + F.length(x["m"])
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"),
                            F.lit(kind).alias("kind"), x["m"].alias("value"),
                            F.right(x["p"], F.lit(CONTEXT)).alias("before"))
            out = F.concat(state["out"], F.array(span))
            if keep is not None:
                out = F.when(keep(x["m"], x["v"]), out).otherwise(state["out"])
            return F.struct(end.alias("at"), out.alias("out"))

        return F.when(F.size(found) > 0, F.aggregate(parts, start, step)["out"])

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(let(matches, walk), F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind as listed, comma-joined; empty without spans."""
    return F.array_join(F.transform(
        F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def together(parts: list[Column]) -> Column:
    """All spans of several columns."""
    return reduce(lambda a, b: F.concat(a, b), parts)


def count_kind(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
