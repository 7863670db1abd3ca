"""Formatting of records and turn tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from sparkcurate.functions import chat as C
from sparkcurate.operators import generate, logs, turns
from sparkcurate.operators.preference import preference_examples

ROLE_OF = "CASE i % 3 WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' ELSE 'system' END"

# documents as chats: their lines are turns, in the order user, assistant, system
LINES = f"""
lines AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS content
          FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
msgs AS (SELECT doc_id, i, {ROLE_OF} AS role, content FROM lines),
seg AS (SELECT *, '<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10) AS s FROM msgs)
"""


def line_chats(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, messages) from the lines of every document."""
    def turn(line, i):
        role = F.when(i % 3 == 0, "user").when(i % 3 == 1, "assistant").otherwise("system")
        return C.message(role, line)

    return table(spark, sf, "documents").select(
        "doc_id", F.transform(F.split("text", "\n"), turn).alias("messages"))


@query("""SELECT conv_id, turn, role, text AS content FROM conversations""")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """PR1: role and content only."""
    rows = table(spark, sf, "conversations")
    plain = C.plain_messages(F.array(F.struct("role", F.col("text").alias("content"),
                                              F.lit("tag").alias("meta"))))
    return rows.select("conv_id", "turn", F.explode(plain).alias("m")).select(
        "conv_id", "turn", "m.role", "m.content")


@query(f"""
WITH {LINES}, t AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS text FROM seg GROUP BY doc_id)
SELECT doc_id, md5(text) AS text, length(text) AS n FROM t""")
def chatml_text(spark: SparkSession, sf: str) -> DataFrame:
    """PR5, PR7: rendered records."""
    rows = line_chats(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), F.lit("sft").alias("data_type"), "messages",
        F.lit("").alias("situation"), F.array().cast("array<string>").alias("reasoning"),
        F.lit("").alias("response"))
    text = turns.training_rows(rows)
    return text.select(F.col("id").cast("long").alias("doc_id"), F.md5("text").alias("text"),
                       F.length("text").alias("n"))


@query(f"""
WITH {LINES}, o AS (SELECT doc_id, i, role, length(content) AS n, sum(length(s)) OVER (
  PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM seg)
SELECT doc_id, coalesce(before, 0)::BIGINT + length('<|im_start|>' || role) + 1 AS start,
       coalesce(before, 0)::BIGINT + length('<|im_start|>' || role) + 1 + n AS "end"
FROM o WHERE role = 'assistant'""")
def record_spans(spark: SparkSession, sf: str) -> DataFrame:
    """PR6: assistant content offsets of message arrays."""
    spans = line_chats(spark, sf).select(
        "doc_id", F.explode(C.assistant_spans(F.col("messages"))).alias("s"))
    return spans.select("doc_id", F.col("s.start").cast("long").alias("start"),
                        F.col("s.end").cast("long").alias("end"))


@query("""
WITH seg AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM conversations),
o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(role) + 13 AS start FROM seg)
SELECT conv_id, turn, role, s AS segment, start, start + length(text) AS "end" FROM o""")
def turn_segments(spark: SparkSession, sf: str) -> DataFrame:
    """PR5, PR6: rendered turns with offsets, conversations of any size."""
    return turns.turn_segments(table(spark, sf, "conversations"), "conv_id")


@query("""
WITH seg AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM conversations),
o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(role) + 13 AS start FROM seg)
SELECT conv_id, turn, start, start + length(text) AS "end" FROM o WHERE role = 'assistant'""")
def assistant_spans(spark: SparkSession, sf: str) -> DataFrame:
    """PR6: assistant content offsets of turn tables."""
    return turns.assistant_spans(table(spark, sf, "conversations"), "conv_id")


@query("""
WITH l AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS last, min(turn) AS first
           FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role, c.text,
       CASE WHEN c.turn = l.last THEN 'reference' ELSE 'prompt' END AS part
FROM conversations c JOIN l USING (conv_id)
WHERE l.last IS NULL OR l.last = l.first OR c.turn <= l.last""")
def gold_turns(spark: SparkSession, sf: str) -> DataFrame:
    """PR4: gold normalisation of turn tables."""
    return turns.gold_turns(table(spark, sf, "conversations"), "conv_id")


@query("""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
g AS (SELECT doc_id, p, len(p) AS n, doc_id % 2 = 0 AS given,
        CASE WHEN len(p) >= 2 THEN ((len(p) - 2) // 3) * 3 + 2 ELSE 0 END AS last FROM p),
k AS (SELECT *, CASE WHEN given AND last = n THEN n - 1 WHEN NOT given AND last > 0 THEN last - 1
                     ELSE n END AS keep FROM g)
SELECT doc_id, (CASE WHEN keep = 0 THEN n ELSE keep END)::BIGINT AS turns,
  md5(array_to_string(p[1:CASE WHEN keep = 0 THEN n ELSE keep END], chr(10))) AS prompt,
  md5(CASE WHEN given THEN 'ref ' || doc_id WHEN last > 0 AND p[last] <> '' THEN p[last] ELSE 'none' END) AS reference
FROM k""")
def gold_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """PR4, PR10: gold normalisation of message arrays, with and without a reference."""
    none = F.lit(None).cast("string")
    rows = line_chats(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), none.alias("mode"), none.alias("persona"),
        none.alias("leading_root_cause"), "messages", none.alias("prompt"), none.alias("question"),
        none.alias("situation"), none.alias("input"), F.when(F.col("doc_id") % 2 == 0, F.concat(
            F.lit("ref "), F.col("doc_id").cast("string"))).alias("reference"),
        F.lit("none").alias("response"), none.alias("answer"), none.alias("gold"),
        none.alias("expected"))
    cases = turns.gold_cases(rows)
    return cases.select(
        F.col("id").cast("long").alias("doc_id"), F.size("messages").cast("long").alias("turns"),
        F.md5(C.joined(F.col("messages"))).alias("prompt"), F.md5("reference").alias("reference"))


@query(f"""
WITH {LINES}, u AS (SELECT doc_id, string_agg(content, chr(10) ORDER BY i) AS complaint
                    FROM msgs WHERE role = 'user' GROUP BY doc_id)
SELECT CASE WHEN d.doc_id % 5 = 0 THEN 'case-' || d.doc_id ELSE d.doc_id::VARCHAR END AS id,
       coalesce(nullif(d.lang, 'fr'), 'unknown') AS slice, md5(coalesce(u.complaint, '')) AS complaint,
       CASE WHEN d.doc_id % 4 = 0 THEN 'UNDECIDED' ELSE 'SOME' END AS gold_rc, '' AS reference
FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id""")
def labelled_gold(spark: SparkSession, sf: str) -> DataFrame:
    """SC8: labelled gold rows with defaults."""
    docs = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("mode"))
    i = F.col("doc_id")
    raw = line_chats(spark, sf).join(docs, "doc_id").select(
        F.when(i % 5 != 0, i.cast("string")).alias("id"), "mode", "messages", i.alias("pos"),
        F.lit(None).cast("string").alias("prompt"), F.when(i % 4 != 0, "SOME").alias("leading_root_cause"),
        F.lit(None).cast("string").alias("reference"))
    return turns.labelled_gold(raw, "UNDECIDED").withColumn("complaint", F.md5("complaint"))


@query("""
SELECT conv_id, turn, role, text FROM conversations UNION ALL
SELECT conv_id, min(turn) - 1, 'system', 'Be brief.' FROM conversations
GROUP BY conv_id HAVING NOT bool_or(role = 'system')""")
def system_injection(spark: SparkSession, sf: str) -> DataFrame:
    """PR9: a system turn where there is none (turn table)."""
    return turns.inject_system(table(spark, sf, "conversations"), "conv_id", "Be brief.")


@query("""
WITH p AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, CASE WHEN n >= 3 THEN n ELSE n + 1 END AS turns, n >= 3 AS had,
       (n + 1) // 3 AS assistants FROM p""")
def record_system(spark: SparkSession, sf: str) -> DataFrame:
    """PR9, PR18: a system turn where there is none (message arrays); assistant turns."""
    rows = line_chats(spark, sf).withColumn("w", C.with_system(F.col("messages"), "Be brief."))
    return rows.select("doc_id", F.size("w").alias("turns"),
                       C.has_role(F.col("messages"), "system").alias("had"),
                       C.assistant_turns(F.col("messages")).alias("assistants"))


@query("""
SELECT doc_id, md5('<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || 'read' || chr(10) || lang || chr(10)
  || '</think>' || chr(10) || text || '<|im_end|>' || chr(10)) AS text FROM documents""")
def reasoning_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PR2, PR3: reasoning records as chats, audit notes left out."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("reasoning").alias("data_type"),
        F.lit(None).cast(C.MESSAGES).alias("messages"), F.col("text").alias("situation"),
        F.array(F.lit("read"), F.col("lang")).alias("reasoning"), F.col("text").alias("response"),
        F.lit("audit only").alias("why"))
    rows = turns.training_rows(docs, thinking=True)
    return rows.select(F.col("id").cast("long").alias("doc_id"), F.md5("text").alias("text"))


@query("""
SELECT u.conv_id || '-' || u.turn AS id, 'user' AS prompt_role, a.text || chr(10) || 'Done.' AS chosen,
       reverse(u.text) AS rejected
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
def preference_texts(spark: SparkSession, sf: str) -> DataFrame:
    """PR8: preference examples with joined completions."""
    pairs = turns.next_turns(table(spark, sf, "conversations"), "conv_id")
    rows = pairs.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.array(C.message("user", F.col("prompt"))).alias("prompt"),
        F.array(C.message("assistant", F.col("answer")), C.message("assistant", F.lit("Done."))).alias("chosen"),
        F.array(C.message("assistant", F.reverse("prompt"))).alias("rejected"))
    out = preference_examples(rows)
    return out.select("id", F.get("prompt", F.lit(0))["role"].alias("prompt_role"), "chosen", "rejected")


TEMPLATE = "Rate the answer.\n{rubric}\n\nQUESTION:\n{prompt}\n\nANSWER:\n{answer}\n\nJSON:"
GUIDE = {"tone": "polite", "safety": "harmless"}


@query("""
SELECT u.conv_id, u.turn, md5('Rate the answer.' || chr(10) || '- tone: polite' || chr(10) || '- safety: harmless'
  || chr(10) || chr(10) || 'QUESTION:' || chr(10) || u.text || chr(10) || chr(10) || 'ANSWER:' || chr(10)
  || a.text || chr(10) || chr(10) || 'JSON:') AS judge_prompt
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """PR13: judge prompts as a projection."""
    pairs = turns.next_turns(table(spark, sf, "conversations"), "conv_id")
    block = turns.rubric_block(GUIDE, ("tone", "safety"))
    fields = {"rubric": F.lit(block), "prompt": F.col("prompt"), "answer": F.col("answer")}
    rows = turns.judge_prompts(pairs, TEMPLATE, fields)
    return rows.select("conv_id", "turn", F.md5("judge_prompt").alias("judge_prompt"))


@query("""
WITH r AS (SELECT count(*)::VARCHAR AS n, max(doc_id)::VARCHAR AS last, min(lang) AS first_lang FROM documents)
UNPIVOT r ON n, last, first_lang INTO NAME fact VALUE value""")
def run_facts(spark: SparkSession, sf: str) -> DataFrame:
    """PR14: a run's facts as key and value."""
    row = table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"), F.min("lang").alias("first_lang"))
    return logs.run_facts(row)


@query("SELECT doc_id, 'doc-' || lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0') AS id FROM documents")
def padded_ids(spark: SparkSession, sf: str) -> DataFrame:
    """PR11: zero-padded record ids."""
    return table(spark, sf, "documents").select(
        "doc_id", generate.record_id("doc", F.col("doc_id")).alias("id"))
