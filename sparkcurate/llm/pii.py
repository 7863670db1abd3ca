"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss.

Base kinds (email, ip, card, phone) are matched with checks of their numbers. Their spans are the seeds:
the one and the two words before a seed are lexical patterns. A pattern is scored by the seeds it
introduces against all its occurrences in the corpus, so that ``the`` introduces numbers, but mostly
other things, and scores near zero, while ``passport:`` scores high. Identifier-like tokens
that follow well-scored patterns become instances with a confidence of their own, and lift further
patterns, also such as no seed ever follows, for ``rounds`` rounds. Tokens behind patterns of final confidence
become spans of the kind that the pattern introduces.

Base spans are a projection. The graph holds distinct (pattern, value) edges with counts, summed before
they are shuffled; a pattern or value of any frequency is one row. A pattern must introduce a fixed number of
different values, whatever the size of the corpus. The words of the corpus are counted against the patterns by a broadcast
while those are few, else by word pairs that are counted before they are shuffled. Texts are read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import WORD, documents, let, lower_ascii, stored
from sparkcurate.llm.spans import SPAN, count_kind, joined, pattern_spans, together
from sparkcurate.session import broadcast_below

KINDS = ("email", "ip", "card", "phone")

#: The base patterns for Java: those of the contract with possessive loops and starts only where a match
#: can start, so that long runs cost linear time. They match the same.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$"

#: A token that may be an identifier: letters and digits with inner marks, at least one digit, 4 to 64 long.
IDENTIFIER = (r"(?<![A-Za-z0-9])(?=[A-Za-z._/@-]{0,40}[0-9])[A-Za-z0-9][A-Za-z0-9._/@-]{2,62}[A-Za-z0-9]"
              r"(?![A-Za-z0-9])")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits has a valid check digit."""
    def check(padded: Column) -> Column:
        doubled = F.translate(padded, "0123456789", "0246813579")
        total = F.lit(0)
        for i in range(1, 21):
            source = doubled if i % 2 else padded
            total = total + F.substring(source, i, 1).cast("int")
        return total % 10 == 0

    return let(F.lpad(digits, 20, "0"), check)


def only_digits(match: Column) -> Column:
    """The digits of a match."""
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of all base kinds; empty for null."""
    def card(match: Column, _: Column) -> Column:
        return let(only_digits(match), lambda d: F.length(d).between(14, 19) & F.when(
            F.length(d) <= 19, luhn(d)).otherwise(False))

    def phone(match: Column, _: Column) -> Column:
        return F.length(only_digits(match)).between(10, 15)

    none = F.array().cast(SPAN)
    found = [
        F.when(F.contains(text, F.lit("@")), pattern_spans(text, "email", 0, EMAIL)).otherwise(none),
        pattern_spans(text, "ip", 1, IP, lambda m, _: m.rlike(IP_PARTS)),
        pattern_spans(text, "card", 2, CARD, card),
        F.when(F.contains(text, F.lit("+")), pattern_spans(text, "phone", 3, PHONE, phone)).otherwise(none),
    ]
    return F.when(text.rlike("[0-9@]"), together(found)).otherwise(none)


def contexts(span: Column) -> Column:
    """The lexical patterns of a span: the word before it, and the two words before it."""
    words = F.regexp_extract_all(lower_ascii(span["before"]), F.lit(f"({WORD})"), F.lit(1))

    def last(found: Column) -> Column:
        one = F.get(found, F.size(found) - 1)
        two = F.concat_ws(" ", F.get(found, F.size(found) - 2), one)
        return F.when(F.size(found) > 1, F.array(one, two)).when(
            F.size(found) > 0, F.array(one)).otherwise(F.array().cast("array<string>"))

    return let(words, last)


def context_totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each pattern occurs in front of any word: pattern, total."""
    one = F.element_at(F.split("pattern", " "), -1)
    heads = patterns.select(F.col("pattern"), one.alias("head"))
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"({WORD})"), F.lit(1))
    pairs = texts.select(words.alias("words")).select(F.explode(F.transform(
        "words", lambda w, i: F.struct(w.alias("w"), F.get("words", i - 1).alias("v")))).alias("x"))
    heads = stored(heads)
    few = broadcast_below(heads)
    counted = pairs.select("x.w", "x.v", F.lit(1).alias("n"))
    if few is heads:  # too many for a broadcast: equal pairs are counted first
        counted = counted.groupBy("w", "v").agg(F.sum("n").alias("n"))
    met = counted.join(few, F.col("w") == F.col("head"))
    fits = (F.col("pattern") == F.col("head")) | (F.col("pattern") == F.concat_ws(" ", F.col("v"), F.col("head")))
    return met.where(fits).groupBy("pattern").agg(F.sum("n").alias("total"))


def score_patterns(edges: DataFrame, totals: DataFrame, seeds: DataFrame, rounds: int = 3,
                   least_values: int = 3, trust: float = 0.3) -> DataFrame:
    """Iterative scores of the pattern-instance graph: pattern, kind, score.

    ``edges``: pattern, value, n. ``totals``: pattern, total. ``seeds``: value, kind. A pattern's score is
    the confidence-weighted share of its occurrences that introduce instances of the kind; it must
    introduce ``least_values`` different ones. An instance believes its patterns like independent
    witnesses, those scoring at least ``trust``; seeds are certain.
    """
    certain = seeds.select("value", "kind", F.lit(1.0).alias("belief"))
    beliefs = stored(certain)
    scores = None
    for _ in range(rounds):
        scores = stored(
            edges.join(beliefs, "value").groupBy("pattern", "kind")
            .agg(F.sum(F.col("n") * F.col("belief")).alias("good"), F.count(F.lit(1)).alias("kinds"))
            .join(totals, "pattern").where(f"kinds >= {least_values}")
            .select("pattern", "kind", F.least(F.lit(0.999), F.col("good") / F.col("total")).alias("score"))
            .where(f"score >= {trust}")
        )
        doubt = F.exp(F.sum(F.log1p(-F.col("score"))))
        instances = edges.join(scores, "pattern").groupBy("value", "kind").agg(
            (1 - doubt).alias("belief"))
        beliefs = stored(
            instances.join(certain.select("value", "kind"), ["value", "kind"], "left_anti")
            .unionByName(certain))
    return scores


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3,
                  least_values: int = 3, accept: float = 0.6) -> DataFrame:
    """Personal data of every row: the id, ``base`` (spans of the base kinds) and ``more`` (found by context).

    One row per input row, repeated ones included. A null text counts as empty and has no spans. Null ids
    stay null. Spans in ``more`` never overlap base spans; if patterns of several kinds introduce a
    token, the best score, then the kind listed first, decides. Extra columns are ignored; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    tokens = F.when(F.col("text").rlike("[0-9]"), pattern_spans(F.col("text"), "token", 9, IDENTIFIER))
    rows = stored(texts.select(
        F.monotonically_increasing_id().alias("row"), "id", base_spans(F.col("text")).alias("base"),
        F.coalesce(tokens, F.array().cast(SPAN)).alias("tokens"),
    ))
    free = F.filter("tokens", lambda t: ~F.exists(
        "base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = rows.select("row", F.explode(F.concat("base", free)).alias("s"))
    uses = stored(spans.select(
        "row", "s.start", "s.end", "s.kind", "s.value", contexts(F.col("s")).alias("patterns")))
    seeds = stored(uses.where("kind <> 'token'").select("value", "kind").distinct())
    graph = stored(uses.select(F.explode("patterns").alias("pattern"), "value").groupBy("pattern", "value")
                   .agg(F.count(F.lit(1)).alias("n")))
    patterns = stored(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"))
                      .where(F.col("values") >= least_values).select("pattern"))
    totals = stored(context_totals(texts, patterns))
    edges = stored(graph.join(broadcast_below(patterns), "pattern"))
    scores = score_patterns(edges, totals, seeds, rounds, least_values).where(f"score >= {accept}")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    chosen = stored(scores.groupBy("pattern").agg(
        F.max(F.struct(F.col("score"), (-rank).alias("r"))).alias("best")).select(
            "pattern", F.col("best.score").alias("score"), (-F.col("best.r")).alias("rank")))
    best = F.max(F.struct("score", (-F.col("rank")).alias("r"), "value"))
    named = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    found = (
        uses.where("kind = 'token'").select("row", "start", "end", "value", F.explode("patterns").alias("pattern"))
        .join(chosen, "pattern").groupBy("row", "start", "end").agg(best.alias("b"))
        .select("row", "start", "end", (-F.col("b.r")).cast("int").alias("rank"), F.col("b.value").alias("value"))
        .groupBy("row").agg(F.collect_list(F.struct(
            "start", "rank", "end", named.alias("kind"), "value", F.lit("").alias("before"))).alias("more"))
    )
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), "base", F.coalesce("more", F.array().cast(SPAN)).alias("more"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    found = personal_data(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(
        "doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"), F.size("more").alias("n_by_context"),
    )


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
