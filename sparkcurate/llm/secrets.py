"""Secret scans through a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: the strings its literal parts can
spell give alternatives of trigrams that must all occur. The index holds, for every trigram that any
query uses, the documents with it; alternatives intersect their postings, rules unite their alternatives,
and only candidate documents are verified with the pattern itself. A rule without mandatory trigrams, such
as a run of hexadecimal digits, scans every document.

The index is written to the shared folder. Postings are intersected by counting per (rule, alternative,
document), so a trigram that half of all documents hold is no hot key. Texts move once, to meet the
rules they are candidates of.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import documents, own, stored
from sparkcurate.llm.spans import count_kind, joined, pattern_spans, together

#: Strings that a part of a pattern may spell before it counts as unknown.
MOST_STRINGS = 64

#: An alternative is a set of trigrams; a query is a set of alternatives; an empty one matches everything.
Query = frozenset[frozenset[str]]
EVERYTHING: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """A kind of secret. The pattern must mean the same in Java and Python."""

    kind: str
    pattern: str
    keep: Callable[[Column, Column], Column] | None = None
    group: int = 0


#: Base rules first, in the order of the contract.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda match, value: F.length(value) >= 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%+!$-]{6,64}@[A-Za-z0-9.-]+"),
)
BASE = ("assign", "access", "hex")


def _minimal(alternatives) -> Query:
    """Alternatives without those that contain another."""
    kept: list[frozenset[str]] = []
    for one in sorted(set(alternatives), key=lambda s: (len(s), sorted(s))):
        if not any(k <= one for k in kept):
            kept.append(one)
    return frozenset(kept)


def _both(a: Query, b: Query) -> Query:
    """Either query's alternatives combined; the shorter query alone if that gets too large."""
    if len(a) * len(b) > 4 * MOST_STRINGS:
        return min(a, b, key=len)
    return _minimal(x | y for x, y in product(a, b))


def _spelled(strings: set[str]) -> Query:
    """A query for texts with one of the strings."""
    return _minimal(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _read(items) -> list[tuple[set[str] | None, Query]]:
    """Each part of a parsed pattern: the strings it can spell, if few, and a query."""
    parts: list[tuple[set[str] | None, Query]] = []
    for code, value in items:
        if code is sre.LITERAL:
            parts.append(({chr(value).lower()}, EVERYTHING))
        elif code is sre.IN:
            if value[0][0] is sre.NEGATE or any(c is not sre.LITERAL and c is not sre.RANGE for c, _ in value):
                parts.append((None, EVERYTHING))
            else:
                spans = [(v, v) if c is sre.LITERAL else v for c, v in value]
                if sum(b - a + 1 for a, b in spans) > 8:
                    parts.append((None, EVERYTHING))
                else:
                    parts.append(({chr(i).lower() for a, b in spans for i in range(a, b + 1)}, EVERYTHING))
        elif code is sre.BRANCH:
            strings: set[str] | None = set()
            query = set()
            for branch in value[1]:
                s, q = _joined(_read(branch))
                strings = strings | s if strings is not None and s is not None else None
                query |= q if s is None else _both(q, _spelled(s))
            parts.append((strings, EVERYTHING if strings is not None else _minimal(query)))
        elif code is sre.SUBPATTERN:
            parts.append(_joined(_read(value[-1])))
        elif code in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            s, q = _joined(_read(inner))
            if low == 0:
                parts.append((s | {""} if high == 1 and s is not None else None, EVERYTHING))
            else:
                parts += [(s, q)] * min(low, 3)
                if low != high or low > 3:
                    parts.append((None, EVERYTHING))
        else:
            parts.append((None, EVERYTHING))
    return parts


def _joined(parts) -> tuple[set[str] | None, Query]:
    """Parts in a row as one: all strings if few, else a query over the runs of known strings."""
    run: set[str] = {""}
    query, exact = EVERYTHING, True
    for strings, q in parts:
        query = _both(query, q)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query, exact = _both(query, _spelled(run)), False
        run = strings if strings is not None else {""}
    if exact:
        return run, query
    return None, _both(query, _spelled(run))


def trigram_query(pattern: str) -> Query:
    """The Boolean query of a pattern over trigrams of the text in lower case."""
    strings, query = _joined(_read(sre_parse.parse(pattern)))
    return query if strings is None else _both(query, _spelled(strings))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Documents (id, mark) with the rules whose trigram query they satisfy (``rules``).

    ``keyed``: id, mark, text; rules without mandatory trigrams are not in the result.
    """
    spark = keyed.sparkSession
    queries = [(rule.kind, number, sorted(alternative))
               for rule in rules for number, alternative in enumerate(sorted(map(sorted, trigram_query(rule.pattern))))
               if alternative]
    trigrams = sorted({t for _, _, alternative in queries for t in alternative})
    terms = [(kind, number, t, len(alternative)) for kind, number, alternative in queries for t in alternative]
    low = keyed.select("id", "mark", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = stored(low.select(F.explode(held).alias("trigram"), "id", "mark").distinct())
    # As many rows as the rules have trigrams.
    wanted = F.broadcast(spark.createDataFrame(
        terms, "kind string, alternative int, trigram string, need int"))
    hits = (
        postings.join(wanted, "trigram").groupBy("id", "mark", "kind", "alternative", "need")
        .agg(F.count(F.lit(1)).alias("n")).where("n = need")
    )
    return hits.groupBy("id", "mark").agg(F.sort_array(F.collect_set("kind")).alias("rules"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Secrets of every row: the id and ``found``, spans of all rules in the order of ``rules``.

    One row per input row, repeated ones included; a null text counts as empty and has no spans. Rows are
    told apart by id and text, null ids included. Extra columns are ignored, an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = candidates(keyed, rules).select(
        F.col("id").alias("of"), F.col("mark").alias("of_mark"), "rules")
    met = keyed.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    parts = []
    for rank, rule in enumerate(rules):
        spans = pattern_spans(F.col("text"), rule.kind, rank, rule.pattern, rule.keep, rule.group)
        if trigram_query(rule.pattern) != EVERYTHING:
            spans = F.when(F.array_contains("rules", rule.kind), spans).otherwise(F.array())
        parts.append(spans)
    spans = own("spans")
    return met.select(F.col("id").alias(id_col), F.explode(F.array(together(parts))).alias(spans)).select(
        id_col, F.col(spans).alias("found"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = find_secrets(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *[count_kind(F.col("found"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
