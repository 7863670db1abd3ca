"""Readers and writers: driver tables written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.base import KPI_SQL, LABELS, SAMPLES, UNSURE, ece_cte, query, round6, samples, table
from checks.generation import FEW_FACTS, SEED, runbooks
from checks.records import CHECKED, MODES, STRATA, records
from checks.reports import WEIGHTS, scores
from sparkcurate.operators import generate as G
from sparkcurate.functions.draw import digest
from sparkcurate.operators import kpi, order, rubric, split
from sparkcurate.operators import reports as rep
from sparkcurate.operators.rules import RuleBook
from sparkcurate.plans import build
from sparkcurate.plans.example_domain import BOOK, KIT
from sparkcurate.session import fresh_path
from sparkcurate.sources import readers as R
from sparkcurate.sources import writers as W


def _record_lines(spark: SparkSession, sf: str, kinds: Sequence[str] = ("sft", "reasoning", "preference")) -> str:
    """Record folders of compressed JSON lines; every 50th line is cut short, so it is no JSON."""
    root = fresh_path(spark, "records")
    rows = records(spark, sf)
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "doc_id"]))
    broken = F.substr(line, F.lit(1), F.length(line) - 1)
    rows = rows.withColumn("value", F.when(F.col("doc_id") % 50 == 0, broken).otherwise(line))
    for kind in kinds:
        W.write_raw_lines(rows.where(F.col("data_type") == kind), f"{root}/{kind}", compression="gzip")
    return root


@query(f"""
WITH {CHECKED}, x AS (SELECT * REPLACE (valid AND i % 50 <> 0 AS valid,
    CASE WHEN i % 50 = 0 THEN NULL ELSE data_type END AS data_type) FROM checked WHERE data_type <> 'essay')
SELECT count(*) AS total, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS invalid,
  count(*) FILTER (WHERE valid AND audit_status = 'approved') AS kept,
  count(*) FILTER (WHERE valid AND audit_status <> 'approved') AS filtered_out FROM x""")
def record_folders(spark: SparkSession, sf: str) -> DataFrame:
    """SC1-SC6, SI1, SI7: record folders with broken lines, quarantined and counted."""
    from sparkcurate.operators.validate import validation_stats

    root = _record_lines(spark, sf)
    paths = [f"{root}/{kind}/*.txt.gz" for kind in ("sft", "reasoning", "preference", "nothing")]
    rows = R.read_records(spark, paths, "quarantine", MODES)
    out = fresh_path(spark, "stats")
    W.write_jsonl(validation_stats(rows), out)
    schema = "total LONG, valid LONG, invalid LONG, kept LONG, filtered_out LONG"
    return spark.read.schema(schema).json(out)


@query("""
WITH p AS (SELECT u.conv_id, max(u.turn) AS t FROM conversations u JOIN conversations a
   ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' GROUP BY u.conv_id)
SELECT p.conv_id::VARCHAR AS id, 'm' AS mode, u.text AS prompt, a.text AS answer, '' AS reference FROM p
JOIN conversations u ON u.conv_id = p.conv_id AND u.turn = p.t JOIN conversations a ON a.conv_id = p.conv_id AND a.turn = p.t + 1""")
def answer_files(spark: SparkSession, sf: str) -> DataFrame:
    """SC9, SI3, SI6: answer CSV written in parallel with repeated ids, the last turn stays."""
    from sparkcurate.operators.turns import next_turns

    pairs = next_turns(table(spark, sf, "conversations"), "conv_id")
    rows = pairs.select(
        F.col("conv_id").cast("string").alias("id"), F.lit("m").alias("mode"), "prompt", "answer",
        F.lit(None).cast("string").alias("reference"), F.col("turn").alias("seq"))
    path = fresh_path(spark, "answers")
    W.write_csv(rows, path)
    return R.read_answer_csv(spark, path)


@query(f"""
WITH {SAMPLES} SELECT slice, {KPI_SQL} FROM samples GROUP BY slice""")
def stored_facts(spark: SparkSession, sf: str) -> DataFrame:
    """SI3, SI8, SI10: fact rows appended to a trace table; reports come from the stored rows."""
    path = fresh_path(spark, "traces")
    W.append_traces(samples(spark, sf), path)
    back = spark.read.parquet(path)
    return round6(kpi.kpi_report(back, LABELS, UNSURE, ("slice",)).drop("ece"))


@query(f"""
WITH {SAMPLES}, r AS (SELECT run, {KPI_SQL} FROM samples GROUP BY run)
SELECT run, n, rc_accuracy, rc_accuracy_clear FROM r""")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """SC10, SI4: report files per run folder, read back with the run from the path."""
    root = fresh_path(spark, "reports")
    report = kpi.kpi_report(samples(spark, sf), LABELS, UNSURE, ("run",))
    W.write_reports(report, root)
    return round6(R.read_reports(spark, root).select("run", "n", "rc_accuracy", "rc_accuracy_clear"))


RUBRIC_RUNS = """
scores AS (SELECT user_id AS sample_id, 'm' || (user_id % 5) AS mode, 'j' || (event_id % 3) AS run,
  event_type AS criterion, least(5::DOUBLE, greatest(1::DOUBLE, value / 10)) AS score FROM events),
cases AS (SELECT run, sample_id, mode, avg(score) FILTER (WHERE criterion = 'click') AS click, avg(score) FILTER (WHERE criterion = 'view') AS view,
  avg(score) FILTER (WHERE criterion = 'purchase') AS purchase, avg(score) FILTER (WHERE criterion = 'error') AS error FROM scores GROUP BY ALL),
five AS (SELECT run, coalesce(mode, 'overall') AS mode, count(*) AS n, (coalesce(avg(click), 0) * 2 + coalesce(avg(view), 0)
  + coalesce(avg(purchase), 0) * 1.5::DOUBLE + coalesce(avg(error), 0) * 0.5::DOUBLE) / 6::DOUBLE AS s
  FROM cases GROUP BY GROUPING SETS ((run, mode), (run))),
ten AS (SELECT run, mode, n, round_even((s - 1) / 4 * 10, 4) AS score_10 FROM five)
"""


def _mixed_reports(spark: SparkSession, sf: str) -> str:
    """KPI reports per source and rubric reports per judge under one root, and a file that is no report."""
    root = fresh_path(spark, "mixed")
    judged = scores(spark, sf)
    parts = [rubric.rounded(rubric.summarise_by_mode(rubric.case_scores(judged.where(F.col("judge") == f"j{k}"), list(WEIGHTS)), WEIGHTS))
             .withColumn("run", F.lit(f"j{k}")) for k in range(3)]
    marks = parts[0].unionByName(parts[1]).unionByName(parts[2])
    extras = F.struct(F.concat(F.lit("model-"), "run").alias("model"), F.struct(F.lit(0.25).alias("win")).alias("pairwise_vs_reference"))
    W.write_reports(rep.rubric_payload(marks).withColumn("extras", extras), root)
    report = kpi.kpi_report(samples(spark, sf), LABELS, UNSURE, ("run",))
    report.write.mode("append").partitionBy("run").json(root)
    W.write_raw_lines(spark.range(1).select(F.lit('{"overall": {').alias("value")), f"{root}/broken/report.json")
    return root


@query(f"""
WITH {SAMPLES}, {RUBRIC_RUNS}, k AS (SELECT run, {KPI_SQL} FROM samples GROUP BY run),
b AS (SELECT run, 'kpi' AS kind, '?' AS model, n, round(rc_accuracy_clear * 10, 5) AS score_10, round(no_fabrication_rate, 4) AS no_fabrication, NULL::DOUBLE AS win FROM k
  UNION ALL SELECT run, 'rubric', 'model-' || run, n, score_10, NULL, 0.25 FROM ten WHERE mode = 'overall')
SELECT *, row_number() OVER (ORDER BY score_10 DESC, coalesce(no_fabrication, 0) DESC, run) AS rank FROM b""")
def report_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """PR15, SC10, WI5: KPI and rubric reports of one folder tree in one leaderboard."""
    rows = rep.joint_leaderboard(R.read_report_variants(spark, _mixed_reports(spark, sf)))
    return rows.withColumns({c: F.round(c, d) for c, d in (("score_10", 5), ("no_fabrication", 4))})


@query(f"WITH {RUBRIC_RUNS} SELECT run, mode, n, score_10 FROM ten WHERE mode <> 'overall'")
def report_modes(spark: SparkSession, sf: str) -> DataFrame:
    """PR15, AG8: the mode matrix of the rubric reports among others."""
    return rep.mode_scores(R.read_report_variants(spark, _mixed_reports(spark, sf)))


@query("""
WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents)
SELECT doc_id, place, doc_id % 7 <> 0 AS decoded FROM l WHERE doc_id % 10 <> 0""")
def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SC2, SC3: line numbers of files in document order, blank lines counted, broken ones kept."""
    i = F.col("doc_id")
    line = F.to_json(F.struct(i.alias("id"), F.col("source").alias("mode")))
    value = F.when(i % 10 == 0, F.repeat(F.lit(" "), (i % 3).cast("int"))).when(i % 7 == 0, F.concat(line, F.lit("}"))).otherwise(line)
    docs = table(spark, sf, "documents").select("doc_id", "source")
    path = fresh_path(spark, "numbered")
    W.write_raw_lines(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(value.alias("value")), path)
    rows = R.read_jsonl(spark, f"{path}/*.txt", "id BIGINT, mode STRING", "quarantine", numbered=True).withColumn(
        "doc_id", F.regexp_extract("value", r'"id":(\d+)', 1).cast("long"))
    return _places(spark, path, rows, "doc_id").select("doc_id", "place", "decoded")


def _places(spark: SparkSession, path: str, rows: DataFrame, first: str) -> DataFrame:
    """Numbered lines of files that hold ranges of ``first``, with ``place``: their number plus the lines of the files before."""
    files = spark.read.text(f"{path}/*.txt").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy(F.lit(1)).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("file").agg(F.min(first).alias("low")).join(files, "file").select(
        "file", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, "file").withColumn("place", F.col("lineno") + F.col("before"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents")
def shuffled_lines(spark: SparkSession, sf: str) -> DataFrame:
    """TK6, SI7: lines written in a reproducible order of digests."""
    docs = table(spark, sf, "documents").select("doc_id")
    path = fresh_path(spark, "shuffled")
    W.write_raw_lines(W.shuffled_order(docs, "doc_id", 42).select(F.col("doc_id").cast("string").alias("value")), path)
    rows = R.read_numbered(spark, f"{path}/*.txt").withColumn("doc_id", F.col("value").cast("long"))
    return _places(spark, path, rows.withColumn("digest", digest(42, F.col("doc_id"))), "digest").select("doc_id", "place")


@query(f"""
WITH {CHECKED} SELECT i::VARCHAR AS id, data_type FROM checked WHERE data_type = 'sft' AND valid AND i % 50 <> 0 AND audit_status = 'approved'""")
def record_file(spark: SparkSession, sf: str) -> DataFrame:
    """SC6: a materialised record file, its invalid and unaudited rows left out."""
    return R.load_record_file(spark, f"{_record_lines(spark, sf, ("sft",))}/sft/*.txt.gz", ("approved",), MODES).select("id", "data_type")


@query("""
SELECT p_brand AS series, count(*) AS n, sum((p_retailprice * 100)::BIGINT)::BIGINT AS price FROM part
WHERE p_partkey % 10 <> 0 GROUP BY p_brand""")
def product_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SC12: product lines, broken ones dropped."""
    path = fresh_path(spark, "products")
    good = F.to_json(F.struct(F.col("p_brand").alias("series"),
                              F.round(F.col("p_retailprice") * 100).cast("long").alias("price")))
    line = F.when(F.col("p_partkey") % 10 == 0, F.lit('{"series": "x", "price":')).otherwise(good)
    W.write_raw_lines(table(spark, sf, "part").select(line.alias("value")), path)
    rows = R.read_products(spark, path)
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))


@query("""
WITH d AS (SELECT doc_id % 5 AS k, replace(replace(text, chr(10), ' '), chr(13), ' ') AS t FROM documents)
SELECT md5(trim(CASE k WHEN 2 THEN t || chr(10) || 'end' ELSE t END, ' ' || chr(9) || chr(10))) AS text, count(*) AS n
FROM d WHERE trim(t, ' ' || chr(9)) <> '' OR k = 2 GROUP BY ALL""")
def mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SC13: lines as plain text, text fields, message lists, references and JSON strings."""
    t, k = F.regexp_replace("text", r"[\n\r]", " "), F.col("doc_id") % 5
    quoted = F.regexp_extract(F.to_json(F.struct(t.alias("w"))), r'(?s)^\{"w":(.*)\}$', 1)
    chat = F.array(F.struct(F.lit("user").alias("role"), t.alias("content")),
                   F.struct(F.lit("user").alias("role"), F.lit("end").alias("content")))
    line = (
        F.when(k == 0, F.to_json(F.struct(t.alias("text"))))
        .when(k == 1, F.to_json(F.struct(t.alias("reference"))))
        .when(k == 2, F.to_json(F.struct(chat.alias("messages")))).when(k == 3, quoted).otherwise(t)
    )
    path = fresh_path(spark, "lines")
    W.write_raw_lines(table(spark, sf, "documents", "doc_id", "text").select(line.alias("value")), path)
    rows = R.read_texts(spark, path).select(F.md5(F.btrim("text", F.lit(" \t\n"))).alias("text"))
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_type AS adapter, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id AS tokens, round(value, 3) AS ttft
FROM events WHERE event_id % 20 <> 0""")
def latency_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SC15: tab-separated latency lines."""
    stamp = F.date_format(F.date_trunc("second", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    line = F.concat_ws("\t", stamp, F.concat(F.lit("adapter="), "event_type"), F.lit("4bit=False"),
                       F.concat(F.lit("tokens="), F.col("user_id").cast("string")),
                       F.concat(F.lit("ttft="), F.round("value", 3).cast("string"), F.lit("s")))
    bad = F.when(F.col("event_id") % 20 == 0, F.lit("restart")).otherwise(line)
    path = fresh_path(spark, "latency")
    W.write_raw_lines(table(spark, sf, "events").select(bad.alias("value")), path)
    rows = R.read_latency_log(spark, path)
    return rows.select("adapter", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "tokens",
                       F.round("ttft", 3).alias("ttft"))


@query("SELECT n_name AS label, n_regionkey::BIGINT AS sig_id, n_name || '|x' AS phrases FROM nation")
def dimension_files(spark: SparkSession, sf: str) -> DataFrame:
    """SC14: reference tables from JSON lines."""
    path = fresh_path(spark, "cues")
    W.write_jsonl(table(spark, sf, "nation").select(
        F.col("n_name").alias("label"), F.col("n_regionkey").alias("sig_id"),
        F.array("n_name", F.lit("x")).alias("phrases")), path)
    rows = R.read_dimension(spark, path, "label STRING, sig_id BIGINT, phrases ARRAY<STRING>")
    return rows.withColumn("phrases", F.array_join("phrases", "|"))


@query(f"WITH {STRATA} SELECT lang, count(*) AS n FROM split WHERE split = 'val' GROUP BY lang")
def stored_split(spark: SparkSession, sf: str) -> DataFrame:
    """SI2: a split stored once and read by partition."""
    path = fresh_path(spark, "split")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    W.read_or_build(spark, path, lambda: split.stratified_holdout(docs, "lang", "doc_id", 0.1, 120, 42))
    again = W.read_or_build(spark, path, lambda: docs.withColumn("split", F.lit("never")))
    return again.where("split = 'val'").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'run-' || n_nationkey AS run, 42::BIGINT AS seed, n_name AS data_version FROM nation")
def run_table(spark: SparkSession, sf: str) -> DataFrame:
    """SI9: run metadata appended to a runs table."""
    path = fresh_path(spark, "runs")
    rows = table(spark, sf, "nation").select(
        F.concat(F.lit("run-"), F.col("n_nationkey").cast("string")).alias("run"),
        F.lit(42).cast("long").alias("seed"), F.col("n_name").alias("data_version"))
    W.append_runs(rows.where("run < 'run-2'"), path)
    W.append_runs(rows.where("run >= 'run-2'"), path)
    return spark.read.parquet(path)


@query(f"""
WITH {SAMPLES}, {ece_cte("run, slice")}, k AS (SELECT run, slice, {KPI_SQL} FROM samples GROUP BY run, slice)
SELECT k.*, coalesce(ece, 0) AS ece, 0 AS again FROM k LEFT JOIN ece USING (run, slice)""")
def incremental_facts(spark: SparkSession, sf: str) -> DataFrame:
    """SI8, SI10, AG4, AG7: facts stored in batches, one of them twice and one replaced; reports from their partials."""
    from sparkcurate.plans import evaluate

    facts, root = samples(spark, sf), fresh_path(spark, "batches")
    book = RuleBook(LABELS, UNSURE, {}, {})
    part = F.pmod(F.col("id"), F.lit(3))
    evaluate.add_batch(facts.where(part < 2), book, root, "b1")  # too much, replaced below
    stored = [evaluate.add_batch(facts.where(part == k), book, root, f"b{k}") for k in (0, 1, 2, 1)]
    again = F.lit(sum(stored) - 3)
    return round6(evaluate.stored_reports(spark, root, ("run", "slice"))).withColumn("again", again)


MIX_SQL = ", ".join(f"('{g}', {n})" for g, n in G.DEFAULT_MIX.items())


@query(f"""
WITH m(g, v) AS (VALUES {MIX_SQL}), n AS (SELECT count(*) AS n FROM documents)
SELECT CASE g WHEN 'complaint_resolution' THEN 'sft-cr' WHEN 'knowledge' THEN 'sft-kn' WHEN 'differential' THEN 'sft-diff'
  WHEN 'distractor' THEN 'sft-dist' ELSE 'sft-abs' END AS prefix,
  greatest(1, round_even(v * (n.n / {sum(G.DEFAULT_MIX.values())}::DOUBLE), 0)::BIGINT) AS n FROM m, n""")
def chat_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """GE5-GE7, SO1, WI4: the full mixture, as many records as there are documents."""
    facts = G.templated_facts(runbooks(spark, sf), FEW_FACTS).join(
        runbooks(spark, sf).select("label", "i"), "label")
    # Five kinds of facts each: one integer order over all of them.
    kinds = F.array(*[F.lit(k) for k in FEW_FACTS])
    facts = facts.withColumn("i", F.col("i") * 5 + F.array_position(kinds, F.col("fact")))
    numbered = order.number_rows(facts.select("question", "answer", "i"), "i", "no")
    facts = numbered.withColumn("pos", F.col("no") - 1)
    n = table(spark, sf, "documents").count()
    rows = build.chat_dataset(spark, KIT, SEED, n, None, facts, "template")
    prefix = F.regexp_replace("id", r"-\d+$", "")
    return rows.groupBy(prefix.alias("prefix")).agg(F.count_distinct("id").alias("n"))


@query(f"""
WITH l AS (SELECT row_number() OVER () - 1 AS i FROM documents)
SELECT (['{"', '".join(BOOK.all_labels)}'])[i % {len(BOOK.all_labels)} + 1] AS label, count(*) AS n, min('eval-' || lpad(i::VARCHAR, greatest(5, length(i::VARCHAR))::INT, '0')) AS first_id
FROM l GROUP BY ALL""")
def gold_set(spark: SparkSession, sf: str) -> DataFrame:
    """GE10: gold cases cycling over all labels, as many as there are documents."""
    rows = build.gold_dataset(spark, KIT, 999, table(spark, sf, "documents").count())
    return rows.groupBy(F.col("leading_root_cause").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))

