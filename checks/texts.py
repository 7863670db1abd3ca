"""Text functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import query, table
from sparkcurate.functions import answers as A
from sparkcurate.functions import chat as C
from sparkcurate.functions import text as X
from sparkcurate.operators import rubric, turns

NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
STOP = "[" + ", ".join(f"'{w}'" for w in ("", *X.STOP_WORDS)) + "]"


def tokens_sql(norm: str) -> str:
    """SQL of distinct content tokens."""
    return (f"list_distinct(list_filter(string_split({norm}, ' '), "
            f"lambda x: NOT list_contains({STOP}, x)))")


def grounded_sql(evidence: str, ticket: str) -> str:
    """SQL of the grounding rule on two token lists."""
    shared = f"len(list_intersect({evidence}, {ticket}))"
    return (f"(len({evidence}) > 0 AND ({shared} >= greatest(3.0, round(0.6 * len({evidence}))) "
            f"OR (len({evidence}) <= 3 AND {shared} = len({evidence}))))")


SIGNATURES = {
    "ALPHA": [["ota"], ["the", "and", "ing"]],
    "BETA": [["aux"], ["tion", "que"]],
    "GAMMA": [["ung", "der"], ["sch"]],
}
OFF = [["zz"], ["vi", "qu", "x"]]


def signature_sql(norm: str, groups: list[list[str]]) -> str:
    """SQL of a signature test."""
    return "(" + " OR ".join(
        "(" + " AND ".join(f"contains({norm}, '{p}')" for p in ps) + ")" for ps in groups) + ")"


def detected_sql(norm: str) -> str:
    """SQL of the list of detected labels."""
    parts = ", ".join(f"CASE WHEN {signature_sql(norm, g)} THEN '{name}' END"
                      for name, g in SIGNATURES.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


@query(f"""
WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents)
SELECT doc_id, md5(norm) AS norm, len({tokens_sql("norm")}) AS n_tokens,
       array_to_string(list_sort({tokens_sql("norm")}), ' ') AS tokens FROM n""")
def normalise_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """TX4, TX5, SO3: normalised text and its content tokens."""
    rows = table(spark, sf, "documents", "doc_id", "text").select("doc_id", X.normalise(F.col("text")).alias("norm"))
    rows = rows.withColumn("t", X.norm_tokens(F.col("norm")))
    return rows.select("doc_id", F.md5("norm").alias("norm"), F.size("t").alias("n_tokens"),
                       F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query(f"""
WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents)
SELECT doc_id, array_to_string({detected_sql("norm")}, '|') AS labels,
       len({detected_sql("norm")}) AS n_labels, {signature_sql("norm", OFF)} AS off_catalogue
FROM n""")
def cue_labels(spark: SparkSession, sf: str) -> DataFrame:
    """TX6, JO7, FI5: labels by phrase signatures."""
    rows = table(spark, sf, "documents", "doc_id", "text").select("doc_id", X.normalise(F.col("text")).alias("norm"))
    labels = X.detect_labels(F.col("norm"), SIGNATURES)
    return rows.select("doc_id", F.array_join(labels, "|").alias("labels"),
                       F.size(labels).alias("n_labels"),
                       X.has_signature(F.col("norm"), OFF).alias("off_catalogue"))


PHRASES = """
c AS (SELECT doc_id AS k, 1 AS sig, [substr(norm, 5, 14), substr(norm, 40, 9)] AS phrases FROM n WHERE doc_id % 4 = 0 AND length(norm) >= 70
      UNION ALL SELECT doc_id, 2, [substr(norm, 60, 11)] FROM n WHERE doc_id % 4 = 0 AND length(norm) >= 70)
"""


@query(f"""
WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents), {PHRASES}
SELECT DISTINCT doc_id, 'D' || k AS label FROM n JOIN c ON contains(norm, phrases[1]) AND contains(norm, coalesce(phrases[2], ''))""")
def phrase_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """TX6, JO7, FI5: labels by a dictionary that grows with the documents; phrases begin and end inside words."""
    from sparkcurate.operators.phrases import cue_matches

    rows = table(spark, sf, "documents", "doc_id", "text").select("doc_id", X.normalise(F.col("text")).alias("norm"))
    said = rows.where((F.col("doc_id") % 4 == 0) & (F.length("norm") >= 70))
    cut = [(1, F.array(F.substring("norm", 5, 14), F.substring("norm", 40, 9))), (2, F.array(F.substring("norm", 60, 11)))]
    cues = said.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("label"), F.explode(F.array(*[
        F.struct(F.lit(sig).alias("sig_id"), phrases.alias("phrases")) for sig, phrases in cut])).alias("c"))
    return cue_matches(rows, cues.select("label", "c.*"), "doc_id", "norm")


MAIL, LICENCE, SCRIPT = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+", r"(?i)\b(?:licen[cs]e|copyright)\b",
    r"(?i)<script",
)


def _hits_sql(column: str) -> str:
    return "list_concat(list_concat(" + ", ".join(
        f"regexp_extract_all({column}, '{p}', 0)" for p in (MAIL, LICENCE)
    ) + f"), regexp_extract_all({column}, '{SCRIPT}', 0))"


@query(f"""
SELECT 'd' || doc_id AS id, array_to_string({_hits_sql("text")}, '|') AS hits,
       len({_hits_sql("text")}) AS n_hits FROM documents
UNION ALL
SELECT 'p' || page_id, array_to_string({_hits_sql("html")}, '|'), len({_hits_sql("html")}) FROM pages""")
def pattern_hits(spark: SparkSession, sf: str) -> DataFrame:
    """TX7, TX8: all matches of a pattern list, over whole texts."""
    docs = table(spark, sf, "documents", "doc_id", "text").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = table(spark, sf, "pages", "page_id", "html").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    rows = docs.unionByName(pages).withColumn(
        "h", X.pattern_hits(F.col("text"), (MAIL, LICENCE, SCRIPT)))
    return rows.select("id", F.array_join("h", "|").alias("hits"), F.size("h").alias("n_hits"))


@query(f"""
WITH d AS (SELECT doc_id, {tokens_sql(NORM)} AS t FROM documents),
e AS (SELECT doc_id, {tokens_sql(NORM.replace("text", "string_split(text, chr(10))[-1]"))} AS own,
             doc_id - 1 AS other FROM documents)
SELECT e.doc_id, {grounded_sql("e.own", "d.t")} AS in_own,
       {grounded_sql("e.own", "o.t")} AS in_previous
FROM e JOIN d USING (doc_id) LEFT JOIN d o ON o.doc_id = e.other""")
def grounding(spark: SparkSession, sf: str) -> DataFrame:
    """TX9: whether a document's last line is grounded in itself and in its predecessor."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    ticket = docs.select("doc_id", X.content_tokens(F.col("text")).alias("t"))
    heads = docs.select("doc_id", X.content_tokens(F.element_at(F.split("text", "\n"), -1)).alias("own"))
    previous = ticket.select((F.col("doc_id") + 1).alias("doc_id"), F.col("t").alias("p"))
    joined = heads.join(ticket, "doc_id").join(previous, "doc_id", "left")
    return joined.select(
        "doc_id", X.tokens_grounded(F.col("own"), F.col("t")).alias("in_own"),
        X.tokens_grounded(F.col("own"), F.col("p")).alias("in_previous"))


@query("""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+', 0) AS w FROM documents)
SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words FROM w""")
def word_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """TX26: the word tokeniser."""
    rows = table(spark, sf, "documents", "doc_id", "text").select("doc_id", X.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_words"),
                       F.md5(F.array_join("w", " ")).alias("words"))


SENTENCES = r"string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
CUES = [["the", "and"], ["aux"], ["ung"]]
DROP = r"regexp_replace({0}, '[.!?]+$', '')"


@query(f"""
WITH s AS (SELECT doc_id, text, {SENTENCES} AS s FROM documents),
c AS (SELECT doc_id, text, len(s) AS n_sentences, list_transform(list_filter(s, lambda x:
        {signature_sql("trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))", CUES)}),
        lambda x: {DROP.format("trim(x)")}) AS picked FROM s)
SELECT doc_id, n_sentences, array_to_string(CASE WHEN len(picked) > 0 THEN picked[1:3]
         ELSE [substring({DROP.format("trim(text)")}, 1, 80)] END, '|') AS evidence FROM c""")
def evidence_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """TX27, TK5: sentences with a cue, at most three, else the head of the text."""
    text = F.col("text")
    return table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.size(X.sentences(text)).alias("n_sentences"),
        F.array_join(X.cue_sentences(text, CUES), "|").alias("evidence"))


MARKERS = ("ota", "tion", "aux", "ung")
PLAIN = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda x: x <> '')"


@query("SELECT doc_id, CASE " + " ".join(
    f"WHEN contains(lower(text), '{m}') THEN '{m}'" for m in MARKERS)
    + f" ELSE array_to_string(({PLAIN})[1:3], ' ') END AS fragment FROM documents")
def short_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """TX28: the first marker found, else three words."""
    return table(spark, sf, "documents").select(
        "doc_id", X.short_fragment(F.col("text"), MARKERS).alias("fragment"))


WS = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"
PAIRS = """
pairs AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS answer
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')"""


@query(f"""
WITH {PAIRS}, t AS (SELECT conv_id, turn, list_distinct({WS.format("prompt")}) AS p,
                           list_distinct({WS.format("answer")}) AS r FROM pairs),
f AS (SELECT *, len(list_intersect(p, r))::DOUBLE AS s FROM t)
SELECT conv_id, turn, round(CASE WHEN s = 0 THEN 0 ELSE
         2 * (s / len(p)) * (s / len(r)) / ((s / len(p)) + (s / len(r))) END, 6) AS f1,
       round(1 + 4 * CASE WHEN s = 0 THEN 0 ELSE
         2 * (s / len(p)) * (s / len(r)) / ((s / len(p)) + (s / len(r))) END, 6) AS proxy FROM f""")
def overlap_scores(spark: SparkSession, sf: str) -> DataFrame:
    """TX20: token overlap of user turns and their answers."""
    pairs = turns.next_turns(table(spark, sf, "conversations"), "conv_id")
    p, a = F.col("prompt"), F.col("answer")
    return pairs.select("conv_id", "turn", F.round(X.overlap_f1(p, a), 6).alias("f1"),
                        F.round(X.proxy_score(p, a), 6).alias("proxy"))


@query(f"""
WITH {PAIRS}, t AS (SELECT list_distinct({WS.format("prompt")}) AS p,
                           list_distinct({WS.format("answer")}) AS r FROM pairs),
f AS (SELECT *, len(list_intersect(p, r))::DOUBLE AS s FROM t)
SELECT count(*) AS n, round(avg(1 + 4 * CASE WHEN s = 0 THEN 0 ELSE
         2 * (s / len(p)) * (s / len(r)) / ((s / len(p)) + (s / len(r))) END), 6) AS mean_proxy FROM f""")
def mean_proxy(spark: SparkSession, sf: str) -> DataFrame:
    """AG22: mean proxy score."""
    pairs = turns.next_turns(table(spark, sf, "conversations"), "conv_id")
    score = X.proxy_score(F.col("prompt"), F.col("answer"))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_proxy"))


@query("""
WITH b AS (SELECT doc_id, text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'step ' || doc_id || chr(10) || 'done' END AS think,
       md5(t) AS rest FROM b""")
def think_split(spark: SparkSession, sf: str) -> DataFrame:
    """TX1, PR2: fold steps into a thinking block around whole texts and split them again."""
    docs = table(spark, sf, "documents")
    steps = F.array(F.concat(F.lit("step "), F.col("doc_id").cast("string")), F.lit("done"))
    folded = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(
        C.fold_reasoning(steps, F.col("text"), True))
    rows = docs.select("doc_id", folded.alias("turn"))
    return rows.select("doc_id", A.think_text(F.col("turn")).alias("think"),
                       F.md5(A.after_think(F.col("turn"))).alias("rest"))


@query("""
SELECT event_id, event_id % 3 <> 2 AS parsed,
       CASE WHEN event_id % 3 <> 2 THEN regexp_extract(props, '([0-9]+)', 1)::BIGINT END AS k
FROM events""")
def json_parse(spark: SparkSession, sf: str) -> DataFrame:
    """TX2, TX3: the first JSON object of a noisy text; broken objects do not parse."""
    noisy = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<think>a</think> so: "), "props", F.lit(" end }")))
        .when(F.col("event_id") % 3 == 1, F.col("props"))
        .otherwise(F.concat(F.lit("text "), F.expr("left(props, length(props) - 1)")))
    )
    rows = table(spark, sf, "events").select("event_id", A.after_think(noisy).alias("body"))
    loose = A.loose_json(F.col("body"))
    return rows.select("event_id", loose.isNotNull().alias("parsed"),
                       loose["k"].try_cast("long").alias("k"))


@query("""
SELECT event_id, 'lookup_' || event_type AS name, regexp_extract(props, '([0-9]+)', 1) AS k,
       event_id % 2 = 0 AS json_form, TRUE AS looks_like
FROM events WHERE event_id % 5 <> 4""")
def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """TX24, FI8: tool calls in the JSON and the tag form; a broken call gives no row."""
    c = F.col
    name = F.concat(F.lit("lookup_"), c("event_type"))
    as_json = F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '),
                       c("props"), F.lit("}\n</tool_call>"))
    k = F.get_json_object("props", "$.k")
    as_tags = F.concat(F.lit("<tool_call><function="), name, F.lit("><parameter=k> "), k,
                       F.lit(" </parameter></function></tool_call>"))
    broken = F.lit('<tool_call>{"name": oops</tool_call>')
    text = F.when(c("event_id") % 5 == 4, broken).when(c("event_id") % 2 == 0, as_json).otherwise(as_tags)
    rows = table(spark, sf, "events", "event_id", "event_type", "props").select("event_id", F.concat(F.lit("ok "), text).alias("t"))
    calls = rows.select("event_id", A.looks_like_tool_call(c("t")).alias("looks_like"),
                        F.explode(A.tool_calls(c("t"))).alias("call"))
    return calls.select("event_id", c("call.name").alias("name"), c("call.arguments")["k"].alias("k"),
                        (c("event_id") % 2 == 0).alias("json_form"), "looks_like")


TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""
SELECT page_id, md5({TRIM.format("html")}) AS answer FROM pages""")
def sanitise_answer(spark: SparkSession, sf: str) -> DataFrame:
    """TX25: answers wrapped in turn tokens and thinking blocks come back clean."""
    html = F.col("html")
    dirty = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("hm</think>\n"), html, F.lit("<|im_end|>\nuser")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("<think>a\nb</think>"), html, F.lit("<think>again")))
        .otherwise(F.concat(html, F.lit("</think>")))
    )
    rows = table(spark, sf, "pages").select("page_id", dirty.alias("t"))
    third = F.col("page_id") % 3 == 2
    clean = F.when(third, X.clean_answer(F.col("t"))).otherwise(X.answer_part(F.col("t")))
    return rows.select("page_id", F.md5(clean).alias("answer"))


@query(f"""
WITH d AS (SELECT {NORM} AS t FROM documents), b AS (SELECT DISTINCT {NORM} AS t FROM benchmark)
SELECT count(*) AS n, round(avg(CASE WHEN b.t IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS exact_match
FROM d LEFT JOIN b USING (t)""")
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    """TX29: share of documents equal to a benchmark text after normalising."""
    docs = table(spark, sf, "documents").select(X.normalise(F.col("text")).alias("t"))
    refs = table(spark, sf, "benchmark").select(X.normalise(F.col("text")).alias("t")).distinct()
    pairs = docs.join(refs.withColumn("r", F.col("t")), "t", "left")
    out = rubric.exact_match(pairs, "t", "r")
    return out.select("n", F.round("exact_match", 6).alias("exact_match"))
