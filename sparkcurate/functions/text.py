"""Text expressions: cleaning, tokens, cue signatures, patterns, grounding, excerpts."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Characters removed by a whitespace strip (all Unicode white space).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)

# Fixed values. Words that carry no content when evidence is compared with a ticket.
STOP_WORDS = tuple(
    "a an the is are was were be been it its i my me we our you your they them this that these "
    "those of to in on at for and or but so with as not no yes do does did have has had can could "
    "would should will just still even only about into from than then there here when what why how "
    "keeps keep got get getting any some more most very really also".split()
)

# Fixed values. Claims about system state that a ticket alone cannot support.
CLAIM_PATTERNS = (
    r"(?iU)\bT\+\s*\d+\s*s\b",
    r"(?iU)\bdelivered at\b",
    r"(?iU)\brecord (?:was |is )?(?:not )?found\b",
    r"(?iU)\bwebhook (?:was |is )?(?:delivered|received|fired|succeeded)\b",
    r"(?iU)\blast_seen\b[^.\n]{0,20}(?:=|:|was|at)\s*\S*\d",
    r"(?U)\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}\b",
    r"(?iU)\b\d{1,2}:\d{2}\s?(?:am|pm)\b",
    r"(?iU)=\s*not_eligible\b",
    r"(?iU)\beligibility_decision\b[^.\n]{0,20}(?:is|was|=)\s*(?:not_)?eligible",
)

# Fixed values. Promises that policy never allows towards a customer.
PROMISE_PATTERNS = (
    r"(?iU)\bfull refund\b",
    r"(?iU)\byears?\s+(?:of\s+)?free\b",
    r"(?iU)\bfree\s+for\s+life\b",
    r"(?iU)\bguarantee[ds]?\b",
)

# Fixed values. Fragments tried in this order when a short excerpt of a ticket is needed.
FRAGMENT_MARKERS = (
    "403", "logs me out", "logged out", "permission denied", "refund", "dispute", "crashes",
    "crash", "ota", "update",
)

Signatures = Mapping[str, Sequence[Sequence[str]]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: Sequence[str]) -> Column:
    """An ``ARRAY<STRING>`` literal (also when empty)."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def normalise(text: Column) -> Column:
    """Lower case, every run of other characters than ``a-z0-9`` becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def norm_tokens(normalised: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct content tokens of an already normalised text."""
    return F.array_except(F.split(normalised, " "), strings(("", *stop_words)))


def content_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct content tokens of a raw text."""
    return norm_tokens(normalise(text), stop_words)


def words(text: Column) -> Column:
    """All ``[a-z0-9]+`` words of the lower-cased text, with repeats.

    The words of the normalised text are the same ones, and splitting is faster than matching.
    """
    return F.array_remove(F.split(normalise(text), " "), "")


def space_tokens(text: Column) -> Column:
    """White-space separated tokens of the lower-cased text, with repeats."""
    parts = F.split(strip(F.lower(text)), r"(?U)[\s\x1c-\x1f]+")
    return F.array_remove(parts, "")


def word_count(text: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.size(space_tokens(text))


def has_signature(normalised: Column, signatures: Sequence[Sequence[str]]) -> Column:
    """True when every phrase of at least one signature occurs in the normalised text."""
    hit = F.lit(False)
    for phrases in signatures:
        every = F.lit(True)
        for phrase in phrases:
            every = every & normalised.contains(phrase)
        hit = hit | every
    return hit


def detect_labels(normalised: Column, signatures: Signatures) -> Column:
    """Labels whose signatures fire, in the order of ``signatures``.

    Pass a materialised column: the text is searched once per phrase.
    """
    found = [
        F.when(has_signature(normalised, groups), F.lit(label))
        for label, groups in signatures.items()
    ]
    return F.array_compact(F.array(*found)) if found else strings(())


def pattern_hits(text: Column, patterns: Sequence[str]) -> Column:
    """Every match of every pattern, pattern by pattern."""
    body = F.coalesce(text, F.lit(""))
    if not patterns:
        return strings(())
    return F.concat(*[F.regexp_extract_all(body, F.lit(p), 0) for p in patterns])


def tokens_grounded(evidence_tokens: Column, ticket_tokens: Column) -> Column:
    """Whether evidence tokens are supported by ticket tokens.

    Needs ``max(3, round(0.6 n))`` shared tokens, or all of them when there are at most three.
    """
    n = F.size(evidence_tokens)
    shared = F.size(F.array_intersect(evidence_tokens, ticket_tokens))
    enough = shared >= F.greatest(F.lit(3.0), F.round(n * F.lit(0.6)))
    return F.coalesce((n > 0) & (enough | ((n <= 3) & (shared == n))), F.lit(False))


def is_grounded(evidence: Column, ticket_tokens: Column) -> Column:
    """:func:`tokens_grounded` for a raw evidence text."""
    return let(content_tokens(evidence), lambda tokens: tokens_grounded(tokens, ticket_tokens))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(strip(text), r"(?<=[.!?])(?U)[\s\x1c-\x1f]+")


def cue_sentences(text: Column, signatures: Sequence[Sequence[str]], limit: int = 3) -> Column:
    """The first ``limit`` sentences carrying a cue; without one, the first 80 characters."""
    carrying = F.filter(
        sentences(text), lambda s: let(normalise(s), lambda n: has_signature(n, signatures))
    )
    picked = F.transform(carrying, lambda s: _drop_marks(strip(s)))
    fallback = F.array(F.substring(_drop_marks(strip(text)), 1, 80))
    return F.when(F.size(picked) > 0, F.slice(picked, 1, limit)).otherwise(fallback)


def _drop_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"[.!?]+\z", "")


def short_fragment(text: Column, markers: Sequence[str] = FRAGMENT_MARKERS) -> Column:
    """The first marker found in the text, else its first three words."""
    lowered = F.lower(text)
    plain = F.regexp_replace(lowered, "[^a-z0-9 ]+", " ")
    first = F.array_join(F.slice(F.array_remove(F.split(plain, " +"), ""), 1, 3), " ")
    out = None
    for marker in markers:
        hit = lowered.contains(marker)
        out = F.when(hit, F.lit(marker)) if out is None else out.when(hit, F.lit(marker))
    return first if out is None else out.otherwise(first)


def overlap_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the two distinct token sets; 0 when they share nothing."""
    p, r = F.array_distinct(space_tokens(prediction)), F.array_distinct(space_tokens(reference))

    def score(sides: Column) -> Column:
        left, right = sides["p"], sides["r"]
        shared = F.size(F.array_intersect(left, right)).cast("double")
        precision = F.try_divide(shared, F.size(left))
        recall = F.try_divide(shared, F.size(right))
        return F.coalesce(
            F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0)
        )

    return F.coalesce(let(F.struct(p.alias("p"), r.alias("r")), score), F.lit(0.0))


def proxy_score(prediction: Column, reference: Column) -> Column:
    """Token overlap mapped onto the 1..5 rubric scale."""
    return F.lit(1.0) + F.lit(4.0) * overlap_f1(prediction, reference)


def clean_answer(text: Column) -> Column:
    """Cut at the first turn token, drop thinking blocks and stray thinking tags."""
    head = F.get(F.split(text, r"<\|im_(?:end|start)\|>", 2), F.lit(0))
    without = F.regexp_replace(head, r"(?s)<think>.*?</think>", "")
    before = F.get(F.split(without, "<think>", 2), F.lit(0))
    return strip(F.replace(before, F.lit("</think>"), F.lit("")))


def answer_part(full: Column) -> Column:
    """The clean answer after the first closing thinking tag."""
    at = F.instr(full, "</think>")
    body = F.when(at > 0, F.substr(full, at + F.lit(len("</think>")))).otherwise(full)
    return clean_answer(body)


def think_part(full: Column) -> Column:
    """The reasoning before the first closing thinking tag, without the opening tag."""
    head = F.get(F.split(full, "</think>", 2), F.lit(0))
    return strip(F.regexp_replace(head, r"(?U)\A\s*<think>\s*", ""))


def filled(template: str, values: Mapping[str, Column]) -> Column:
    """A template's ``{name}`` slots filled with columns; the text around them is constant."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
