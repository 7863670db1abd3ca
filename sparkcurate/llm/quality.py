"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document, as a projection over the text: the ledger stores the
measurements and one bit per failed rule. Policies are versions: masks of rules that reject at once and of
rules that reject together with others. Applying a policy, comparing versions and ablating rules only read
the ledger's mask: bit operations and one aggregation, never the texts again.

Repeated windows are found inside a row: hashes of all windows, and for texts in which two are equal a
sort of (hash, position). No word leaves its row, so nothing is shuffled and no text is too hot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import WORD, documents, let

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\u000b\f\r"

#: A rule: bit name and the condition of failure over the measurements.
Rule = tuple[str, Callable[[dict[str, Column]], Column]]

RULES: tuple[Rule, ...] = (
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30),
    ("symbols", lambda m: m["n_symbols"] * 10 > m["word_chars"]),
    ("duplicate_lines", lambda m: m["n_dup_lines"] * 10 > m["n_lines"] * 3),
    ("word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 15)),
    ("shouting", lambda m: m["n_marks"] * 2 > m["n_words"]),
    ("long_lines", lambda m: m["word_chars"] > m["n_lines"] * 50_000),
)


@dataclass(frozen=True)
class Policy:
    """A version: rules that reject alone (``hard``), and how many of ``soft`` reject together."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    soft_limit: int = 2


#: The base rules reject in every version; later versions add rules.
POLICIES = (
    Policy("1", ("few_words", "repeated_windows")),
    Policy("2", ("few_words", "repeated_windows", "symbols", "shouting"),
           ("duplicate_lines", "word_length", "long_lines"), 2),
)


def mask_of(names: tuple[str, ...]) -> int:
    """The bits of rules."""
    order = [name for name, _ in RULES]
    return sum(1 << order.index(n) for n in names)


def repeat_words(words: Column) -> Column:
    """Words of an array in windows of eight that occur at least twice in it, first ones included."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
                         lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(p - F.get(at, k - 1), F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        positions = let(pairs, repeated)
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(let(positions, length))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """Struct of all measurements of a text; a null text counts as an empty one."""
    text = F.coalesce(text, F.lit(""))

    def measured(words: Column) -> Column:
        def lined(lines: Column) -> Column:
            chars = F.length(F.translate(text, SPACES, ""))
            return F.struct(
                F.size(words).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeat_words(words).cast("long").alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
                F.regexp_count(text, F.lit("!!")).cast("long").alias("n_marks"),
            )

        return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lined)

    return let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), measured)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and failure bits of every row: the id, the measurements, ``mask``.

    One row per input row, repeated ones included. A null text counts as empty: it has no words and
    fails ``few_words``. Extra columns are ignored; an empty table gives an empty ledger.
    """
    rows = docs.select(F.col(id_col), F.explode(F.array(measures(F.col(text_col)))).alias("m"))
    names = [f.name for f in rows.schema["m"].dataType.fields]
    found = {n: F.col(n) for n in names}
    mask = F.lit(0).cast("long")
    for bit, (_, failed) in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(failed(found), F.lit(1 << bit).cast("long")).otherwise(F.lit(0)))
    return rows.select(id_col, "m.*").select(id_col, *names, mask.alias("mask"))


def rejected(mask: Column, policy: Policy) -> Column:
    """Whether a policy rejects a document with these failure bits."""
    soft = F.bit_count(mask.bitwiseAND(F.lit(mask_of(policy.soft))))
    return (mask.bitwiseAND(F.lit(mask_of(policy.hard))) != 0) | (
        (soft >= policy.soft_limit) if policy.soft else F.lit(False))


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows rejected, and rows only this rule rejects.

    One aggregation over the ledger's mask. ``only`` counts rows that the policy without the rule keeps.
    """
    sums = [F.count(F.when(rejected(F.col("mask"), policy), 1)).alias("rejected")]
    names = policy.hard + policy.soft
    for name in names:
        bit = mask_of((name,))
        without = F.col("mask").bitwiseAND(F.lit(~bit))
        sums.append(F.count(F.when(F.col("mask").bitwiseAND(F.lit(bit)) != 0, 1)).alias(f"f_{name}"))
        sums.append(F.count(F.when(rejected(F.col("mask"), policy) & ~rejected(without, policy), 1))
                    .alias(f"o_{name}"))
    one = book.agg(F.count(F.lit(1)).alias("documents"), F.bit_or("mask").alias("any_mask"), *sums)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(policy.version).alias("version"), F.lit(n).alias("rule"),
                 F.col(f"f_{n}").alias("failed"), F.col(f"o_{n}").alias("only"), "rejected", "documents")
        for n in names])).alias("r")).select("r.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base verdict and the verdict of the latest policy for every document."""
    book = ledger(documents(spark, sf_dir, "doc_id", "text"))
    base = F.col("mask").bitwiseAND(F.lit(mask_of(("few_words", "repeated_windows")))) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~rejected(F.col("mask"), POLICIES[-1])).alias("kept"), "mask",
    )


OP6_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT r, i, list_slice(words, i, i + 7) AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(0, 8) t(k) GROUP BY r),
measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(regexp_extract_all(text, '!!'))::BIGINT AS n_marks
  FROM split LEFT JOIN covered USING (r)),
bits AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN n_repeat_words * 100 > n_words * 30 THEN 2 ELSE 0 END)
    + (CASE WHEN n_symbols * 10 > word_chars THEN 4 ELSE 0 END)
    + (CASE WHEN n_dup_lines * 10 > n_lines * 3 THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < n_words * 2 OR word_chars > n_words * 15 THEN 16 ELSE 0 END)
    + (CASE WHEN n_marks * 2 > n_words THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars > n_lines * 50000 THEN 64 ELSE 0 END) AS mask
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, mask & 3 <> 0 AS base_failed,
       mask & 39 = 0 AND bit_count(mask & 88) < 2 AS kept, mask::BIGINT AS mask
FROM bits
"""

QUERIES = {"op6_quality": op6_quality}
ORACLES = {"op6_quality": OP6_SQL}
