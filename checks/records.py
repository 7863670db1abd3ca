"""Record contract, statistics, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from sparkcurate.functions import chat as C
from sparkcurate.operators import rubric, split, turns, validate

MODES = ("en", "fr", "de")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """One record per document, of all three types, some of them broken in known ways."""
    i, text = F.col("doc_id"), F.col("text")
    kind = F.when(i % 37 == 0, "essay").when(i % 3 == 0, "sft").when(i % 3 == 1, "reasoning").otherwise(
        "preference")
    head = F.col("text")
    user = C.message(F.when(i % 41 == 0, "robot").otherwise("user"), head)
    answer = C.message("assistant", F.when(i % 43 == 0, F.lit(" \n\t")).otherwise(text))
    chat = F.when(i % 19 == 0, F.array(user)).when(i % 23 == 0, F.array(answer)).otherwise(
        F.array(user, answer))
    steps = F.when(i % 11 == 0, F.array(F.lit("one"), F.lit("  "))).when(
        i % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("one"), head))
    wrong = F.array(C.message(F.when(i % 17 == 0, "user").otherwise("assistant"), F.lit("no")))
    return table(spark, sf, "documents").select(
        F.when(i % 29 == 0, F.lit("")).otherwise(i.cast("string")).alias("id"),
        kind.alias("data_type"), F.col("lang").alias("mode"), F.lit("p").alias("persona"),
        F.col("source"), F.col("lang"), F.lit("v1").alias("version"),
        F.when(i % 10 < 7, "approved").otherwise("pending").alias("audit_status"),
        F.when(i % 31 == 0, "dialogue").when(i % 2 == 0, "single_turn").alias("conversation_type"),
        chat.alias("messages"), head.alias("situation"), steps.alias("reasoning"),
        text.alias("response"), F.lit("audit only").alias("why"), F.lit("none").alias("bad_type"),
        F.array(user).alias("prompt"), F.array(answer).alias("chosen"), wrong.alias("rejected"),
        i.alias("doc_id"),
    )


CHECKED = """
k AS (SELECT doc_id AS i, lang, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank, trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AS blank_head,
        CASE WHEN doc_id % 37 = 0 THEN 'essay' WHEN doc_id % 3 = 0 THEN 'sft'
             WHEN doc_id % 3 = 1 THEN 'reasoning' ELSE 'preference' END AS data_type FROM documents),
e AS (SELECT *, [
  CASE WHEN i % 29 = 0 THEN 'id: must not be empty' END,
  CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'mode: unknown value' END] AS common,
  [CASE WHEN i % 31 = 0 THEN 'conversation_type: unknown value' END,
   CASE WHEN i % 41 = 0 AND (i % 19 = 0 OR i % 23 <> 0) THEN 'messages: unknown role' END,
   CASE WHEN (i % 43 = 0 AND i % 19 <> 0) OR (blank AND i % 19 <> 0) OR (blank_head AND (i % 19 = 0 OR i % 23 <> 0))
        THEN 'messages: message content must not be blank' END,
   CASE WHEN i % 19 = 0 THEN 'messages: needs an assistant turn' END,
   CASE WHEN (i % 19 <> 0 AND i % 23 = 0) OR (i % 41 = 0) THEN 'messages: needs a user turn' END] AS sft,
  [CASE WHEN i % 11 <> 0 AND i % 13 = 0 THEN 'reasoning: must not be empty' END,
   CASE WHEN i % 11 = 0 OR (i % 13 <> 0 AND blank_head) THEN 'reasoning: steps must not be blank' END] AS reasoning,
  [CASE WHEN i % 41 = 0 THEN 'prompt: unknown role' END,
   CASE WHEN blank_head THEN 'prompt: message content must not be blank' END,
   CASE WHEN i % 41 = 0 THEN 'prompt: needs a user turn' END,
   CASE WHEN i % 43 = 0 OR blank THEN 'chosen: message content must not be blank' END,
   CASE WHEN i % 17 = 0 THEN 'rejected: turns must all be assistant' END] AS preference
  FROM k),
c AS (SELECT i, lang, data_type, CASE WHEN i % 10 < 7 THEN 'approved' ELSE 'pending' END AS audit_status,
  CASE WHEN data_type = 'essay' THEN ['data_type: unknown value']
       ELSE list_transform(list_filter(list_concat(common, CASE data_type WHEN 'sft' THEN sft
            WHEN 'reasoning' THEN reasoning ELSE preference END), lambda x: x IS NOT NULL),
            lambda x: data_type || '.' || x) END AS errors FROM e),
checked AS (SELECT *, len(errors) = 0 AS valid FROM c)
"""


@query(f"""
WITH {CHECKED} SELECT i AS doc_id, array_to_string(errors, ' | ') AS errors,
                      errors[1] AS first_error FROM checked WHERE NOT valid""")
def invalid_records(spark: SparkSession, sf: str) -> DataFrame:
    """VA1-VA8, VA10, VA12: quarantined records with all their errors."""
    bad = validate.check_records(records(spark, sf), MODES).where("NOT valid")
    return bad.select("doc_id", F.array_join("errors", " | ").alias("errors"), "first_error")


STATS = """count(*) AS total, count(*) FILTER (WHERE valid) AS valid,
  count(*) FILTER (WHERE NOT valid) AS invalid,
  count(*) FILTER (WHERE valid AND audit_status = 'approved') AS kept,
  count(*) FILTER (WHERE valid AND audit_status <> 'approved') AS filtered_out"""


@query(f"WITH {CHECKED} SELECT {STATS} FROM checked")
def validation_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AG1: totals over all records."""
    return validate.validation_stats(validate.check_records(records(spark, sf), MODES))


@query(f"WITH {CHECKED} SELECT data_type, {STATS} FROM checked GROUP BY ROLLUP (data_type)")
def directory_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AG2, AG24, SC4, SC5: statistics per record type and overall in one roll-up."""
    return validate.validation_stats(
        validate.check_records(records(spark, sf), MODES), ("data_type",))


@query(f"""
WITH {CHECKED}
SELECT 'data_type' AS dimension, data_type AS value, count(*) AS n FROM checked WHERE valid GROUP BY data_type
UNION ALL SELECT 'mode', lang, count(*) FROM checked WHERE valid GROUP BY lang""")
def valid_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """AG1: valid rows by type and mode."""
    return validate.valid_distribution(validate.check_records(records(spark, sf), MODES))


@query(f"""
WITH {CHECKED} SELECT i AS doc_id, data_type FROM checked WHERE valid AND audit_status = 'approved'""")
def audited_records(spark: SparkSession, sf: str) -> DataFrame:
    """FI1: what remains after rules and audit filter."""
    kept = validate.keep_audited(validate.check_records(records(spark, sf), MODES))
    return kept.select("doc_id", "data_type")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    """AG3: counts per tag."""
    return validate.distribution(table(spark, sf, "documents"), "source")


@query("""
WITH want(lang) AS (VALUES ('de'), ('en'), ('fr'), ('es'), ('xx'), ('zh'))
SELECT lang FROM want WHERE lang NOT IN (SELECT lang FROM documents)""")
def mode_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """JO14, SO4: expected modes without data."""
    return validate.missing_values(
        table(spark, sf, "documents"), "lang", ("de", "en", "fr", "es", "xx", "zh"))


@query("""
WITH f AS (SELECT conv_id, count(*) AS turns, bool_and(role IN ('system', 'user', 'assistant')) AS roles_known,
  bool_and(trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS filled, bool_or(role = 'assistant') AS has_assistant,
  bool_or(role = 'user') AS has_user, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns
  FROM conversations GROUP BY conv_id)
SELECT conv_id, turns, assistant_turns, roles_known AND filled AND has_assistant AND has_user AS valid,
  CASE WHEN NOT roles_known THEN 'messages: unknown role' WHEN NOT filled THEN 'messages: content is blank'
       WHEN NOT has_assistant THEN 'messages: needs an assistant turn'
       WHEN NOT has_user THEN 'messages: needs a user turn' END AS first_error FROM f""")
def conversation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """VA2, VA3, VA5, PR18: contract of turn tables without gathering conversations."""
    checked = turns.conversation_checks(table(spark, sf, "conversations"), "conv_id")
    return checked.select("conv_id", "turns", "assistant_turns", "valid", "first_error")


@query("""
SELECT event_id, value BETWEEN 1 AND 5 AND (value / 2) BETWEEN 1 AND 5 AS in_range FROM events""")
def rubric_range(spark: SparkSession, sf: str) -> DataFrame:
    """VA9: rubric scores within bounds."""
    rows = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("tone"), (F.col("value") / 2).alias("safety"))
    return validate.rubric_in_range(rows, ("tone", "safety")).select("event_id", "in_range")


@query("SELECT event_type AS judge, count(*) AS n FROM events GROUP BY event_type")
def judge_denylist(spark: SparkSession, sf: str) -> DataFrame:
    """VA11: a table without denied judges passes unchanged."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("judge"))
    return validate.distribution(validate.deny_judges(rows, rubric.DENIED_JUDGES), "judge")


STRATA = """
g AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
q AS (SELECT *, sum(size) OVER () AS total, count(*) OVER () AS strata,
             row_number() OVER (ORDER BY lang) - 1 AS pos FROM g),
t AS (SELECT *, greatest(120, ceil(0.1::DOUBLE * total))::BIGINT AS target FROM q),
take AS (SELECT lang, least(greatest(1, target // strata + CASE WHEN pos < target % strata THEN 1 ELSE 0 END),
               CASE WHEN size > 1 THEN size - 1 ELSE size END) AS take FROM t),
split AS (SELECT d.doc_id, d.lang, CASE WHEN row_number() OVER (PARTITION BY d.lang
            ORDER BY md5('42:' || d.doc_id), d.doc_id) <= take.take THEN 'val' ELSE 'train' END AS split
          FROM documents d JOIN take ON take.lang = d.lang)
"""


@query(f"WITH {STRATA} SELECT doc_id, lang, split FROM split")
def stratified_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """WI1: even shares per stratum."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return split.stratified_holdout(docs, "lang", "doc_id", 0.1, 120, 42)


@query(f"""
WITH {STRATA}, want(lang) AS (VALUES ('de'), ('en'), ('fr'), ('qq'))
SELECT lang FROM want WHERE lang NOT IN (SELECT lang FROM split WHERE split = 'val')""")
def holdout_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """SO4: modes missing on the validation side."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    marked = split.stratified_holdout(docs, "lang", "doc_id", 0.1, 120, 42)
    return validate.missing_values(
        marked.where("split = 'val'"), "lang", ("de", "en", "fr", "qq"))


def _flat(table_name: str, key: str, fraction: float, least: int) -> str:
    take = f"round_even(n * {fraction}::DOUBLE, 0)"
    return f"""
s AS (SELECT count(*) AS n FROM {table_name}),
r AS (SELECT {key}, row_number() OVER (ORDER BY md5('7:' || {key}), {key}) AS rn FROM {table_name}),
split AS (SELECT {key}, CASE WHEN n >= {least} AND {take} >= 1 AND {take} < n AND rn <= {take}
          THEN 'val' ELSE 'train' END AS split FROM r, s)"""


@query(f"WITH {_flat('documents', 'doc_id', 0.15, 2)} SELECT doc_id, split FROM split")
def flat_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """WI2: a flat share of all rows, half-even."""
    return split.flat_holdout(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.15, 7)


@query(f"WITH {_flat('benchmark', 'item_id', 0.1, 20)} SELECT item_id, split FROM split")
def preference_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """WI3: the fallback split from 20 pairs on."""
    return split.preference_holdout(table(spark, sf, "benchmark").select("item_id"), "item_id", 7)


@query(f"""
WITH {_flat('documents', 'doc_id', 0.15, 2)}
SELECT split, count(*) AS n, (SELECT count(*) FROM split a JOIN split b USING (doc_id)
         WHERE a.split <> b.split) AS overlap FROM split GROUP BY split""")
def split_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """SO2: no id on both sides."""
    marked = split.flat_holdout(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.15, 7)
    overlap = split.split_overlap(marked, "doc_id").count()
    return marked.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.lit(overlap).cast("long").alias("overlap"))


@query("""
WITH mix AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY source)
SELECT source, greatest(1, round_even(n * (50::DOUBLE / total), 0)::BIGINT) AS size FROM mix""")
def mix_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """WI4: sizes of all groups scaled to a limit."""
    counts = validate.distribution(table(spark, sf, "documents"), "source")
    return split.scaled_sizes(counts, 50).select("source", "size")
