"""Readers for JSON-lines records, gold sets, answer tables, reports, logs and reference tables.

All of them are distributed scans with an explicit schema. A missing path gives an empty frame where
the reader says so, and an error otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurate import schemas as S
from sparkcurate.functions.answers import STRICT, one_object, one_value
from sparkcurate.functions.chat import joined
from sparkcurate.functions.text import is_blank, strip
from sparkcurate.operators.validate import check_records, keep_audited, validation_stats
from sparkcurate.session import broadcast_below, cut_lineage


def _lines(spark: SparkSession, paths: str | Sequence[str], empty_ok: bool, *more: Column) -> DataFrame:
    """(file, value, more) lines, blank ones too; with ``empty_ok`` a path without files gives no rows."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    found = []
    for path in listed:
        try:
            lines = spark.read.text(path)
        except AnalysisException as error:
            if not empty_ok or error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(lines.select(F.col("_metadata.file_path").alias("file"), "value", *more))
    if not found:
        empty = spark.createDataFrame([], "file STRING, value STRING")
        return empty.select("*", *[F.lit(0).cast("long").alias(name) for name in ("block", "at") if more])
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _text(spark: SparkSession, paths: str | Sequence[str], empty_ok: bool) -> DataFrame:
    """(file, value) lines without blank ones; with ``empty_ok`` a path without files gives no rows."""
    return _lines(spark, paths, empty_ok).where(~is_blank(F.col("value")))


def read_numbered(spark: SparkSession, paths: str | Sequence[str], empty_ok: bool = False) -> DataFrame:
    """(file, lineno, value): lines with their number in their file, from 1; blank lines count and are left out.

    A line is numbered within the block of its file that a task read; the lines of earlier blocks are added.
    The lines are stored first, so that both steps see the same blocks however the files are split.
    """
    block = F.col("_metadata.file_block_start").alias("block")
    lines = cut_lineage(_lines(spark, paths, empty_ok, block, F.monotonically_increasing_id().alias("at")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = lines.where(~is_blank(F.col("value"))).join(broadcast_below(cut_lineage(blocks)), ["file", "block"])
    return placed.select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("lineno"), "value")


def split_paths(data_dir: str, data_types: Sequence[str]) -> list[str]:
    """Where the files of each record type lie."""
    return [f"{data_dir.rstrip('/')}/{t}/*.jsonl" for t in data_types]


def decode(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Add ``row`` (the parsed struct) and ``decoded`` to JSON lines; ``value`` stays beside it.

    A line is decoded if it is one JSON object and nothing else. A wrong type in one field only
    blanks that field.
    """
    whole = one_object(F.col(value)).isNotNull()
    return lines.withColumns({
        "row": F.from_json(F.col(value), schema, STRICT), "decoded": whole,
    })


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str,
               on_error: str = "fail", empty_ok: bool = False, numbered: bool = False) -> DataFrame:
    """JSON-lines scan. ``on_error``: ``fail`` aborts, ``quarantine`` keeps bad lines as rows with
    ``decoded = false``, ``drop`` leaves them out. Blank lines are skipped. ``numbered`` adds ``lineno``."""
    if on_error not in ("fail", "quarantine", "drop"):
        raise ValueError(f"unknown on_error {on_error!r}")
    lines = read_numbered(spark, paths, empty_ok) if numbered else _text(spark, paths, empty_ok)
    rows = decode(lines, schema)
    if on_error == "fail":
        # as a filter, so that no column pruning can skip the check
        where = [F.lit(":"), F.col("lineno").cast("string")] if numbered else []
        bad = F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("file"), *where)).cast("boolean")
        rows = rows.where(F.when(F.col("decoded"), F.lit(True)).otherwise(bad))
    elif on_error == "drop":
        rows = rows.where("decoded")
    return rows.select(*lines.columns, "decoded", "row.*")


def read_records(spark: SparkSession, paths: str | Sequence[str], on_error: str = "quarantine",
                 modes: Sequence[str] = S.MODES, empty_ok: bool = True, numbered: bool = False) -> DataFrame:
    """Record files with the contract checked: record columns, ``errors``, ``valid``, raw ``value``;
    ``lineno`` if ``numbered``."""
    rows = read_jsonl(spark, paths, S.RECORD, on_error, empty_ok, numbered)
    rows = rows.withColumn("keys", F.from_json(F.col("value"), S.RECORD_KEYS, STRICT))
    return check_records(rows, modes, keyed=True).drop("keys")


def invalid_lines(spark: SparkSession, paths: str | Sequence[str], modes: Sequence[str] = S.MODES) -> DataFrame:
    """(file, lineno, error): the lines of record files that break the contract or are no JSON, each with its first error."""
    rows = read_records(spark, paths, "quarantine", modes, numbered=True)
    return rows.where(~F.col("valid")).select("file", "lineno", F.col("first_error").alias("error"))


def load_split(spark: SparkSession, data_dir: str, data_types: Sequence[str] = S.DATA_TYPES,
               keep: Sequence[str] | None = S.KEEP_AUDIT, on_error: str = "fail",
               modes: Sequence[str] = S.MODES) -> tuple[DataFrame, DataFrame]:
    """(kept records, statistics by data type) of the record folders, in one scan definition.

    Statistics count every row, the audit filter comes after the rules. A missing folder is empty.
    """
    checked = read_records(spark, split_paths(data_dir, data_types), on_error, modes)
    return keep_audited(checked, keep), validation_stats(checked, ("data_type",), keep)


def load_record_file(spark: SparkSession, path: str, keep: Sequence[str] | None = S.KEEP_AUDIT,
                     modes: Sequence[str] = S.MODES) -> DataFrame:
    """A materialised record file: invalid rows are left out, a missing file is an error."""
    return keep_audited(read_records(spark, path, "quarantine", modes, empty_ok=False), keep)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Raw gold rows. A ``prompt`` (or ``question`` …) may be a text or a message list."""
    rows = read_jsonl(spark, path, S.GOLD, "fail")
    listed = F.coalesce(*[
        F.from_json(F.col(c), S.MESSAGES) for c in ("prompt", "question", "situation", "input")
    ])
    return rows.withColumn("messages", F.coalesce(F.col("messages"), listed))


SAMPLE_TEXTS = ("mode", "prompt", "answer", "reference")


def read_answer_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-sample CSV by id: rows without an id go, the last of several equal ids stays:
    by ``seq`` if the file has that column, else by place.

    All four text columns must be there; absent ones would make every comparison a tie.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = [c for c in ("id", *SAMPLE_TEXTS) if c not in raw.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    if "seq" in raw.columns:  # written in parallel: the number says which row is later
        at = F.col("seq").cast("long")
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in SAMPLE_TEXTS]
    rows = raw.select("id", *texts, at.alias("at")).where(F.coalesce("id", F.lit("")) != "")
    latest = rows.groupBy("id").agg(F.max_by(F.struct(*SAMPLE_TEXTS), "at").alias("r"))
    return latest.select("id", "r.*")


def read_fact_csv(spark: SparkSession, path: str) -> DataFrame:
    """The per-answer fact table as written by the CSV sink."""
    return spark.read.schema(S.SAMPLE).csv(
        path, header=True, multiLine=True, quote='"', escape='"')


def read_reports(spark: SparkSession, root: str, schema: str = S.KPI_REPORT) -> DataFrame:
    """``<root>/<run>/report.json`` files, run from the folder name; unreadable ones are skipped.

    Folders ``run=<run>``, as one partitioned write leaves them, are read too if there is any.
    """
    top, lines = root.rstrip("/"), spark.read.schema(f"{schema}, _bad STRING").option(
        "columnNameOfCorruptRecord", "_bad")
    try:
        parts = lines.json(f"{top}/run=*")
        name = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/run=([^/]*)/[^/]+$", 1))
        return parts.select(name.alias("run"), "*").where(F.col("_bad").isNull()).drop("_bad")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    raw = lines.option("multiLine", True).json(f"{top}/*/report.json")
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/report\.json(?:/[^/]+)?$", 1)
    return raw.select(run.alias("run"), "*").where(F.col("_bad").isNull()).drop("_bad")


def _decoded(name: Column) -> Column:
    """A percent-encoded name in clear; a plus sign stays, and so does a name that is not encoded."""
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def read_report_variants(spark: SparkSession, root: str) -> DataFrame:
    """(run, report): the reports of all runs under ``root`` as VARIANT values, whatever their shape.

    Files ``<run>/report.json`` and lines in folders ``run=<run>`` are read; what is not one JSON object is skipped,
    a root without reports gives no rows.
    """
    top = root.rstrip("/")
    found = []
    for pattern, whole, name in ((f"{top}/*/report.json", True, r"([^/]+)/report\.json(?:/[^/]+)?$"),
                                 (f"{top}/run=*", False, r"/run=([^/]*)/[^/]+$")):
        try:
            raw = spark.read.text(pattern, wholetext=whole)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        run = _decoded(F.regexp_extract(F.col("_metadata.file_path"), name, 1))
        run = run if whole else _decoded(run)  # a partition's folder is itself an encoded name
        found.append(raw.select(run.alias("run"), F.try_parse_json("value").alias("report")))
    if not found:
        return spark.createDataFrame([], "run STRING, report STRING").withColumn("report", F.try_parse_json("report"))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return rows.where(F.startswith(F.schema_of_variant("report"), F.lit("OBJECT<")))


LOG_STATE = "log_history ARRAY<MAP<STRING, STRING>>"


def read_training_logs(spark: SparkSession, root: str) -> DataFrame:
    """Log entries (run, pos, step, key, value) of the best state file of every run under ``root``.

    A run's own file wins, else the checkpoint with the highest step. Only numbers become values.
    """
    from sparkcurate.operators.logs import best_log

    raw = spark.read.schema(LOG_STATE).option("multiLine", True).option(
        "recursiveFileLookup", True).option("pathGlobFilter", "trainer_state.json").json(root)
    path = F.col("_metadata.file_path")
    pattern = r"([^/]+)(?:/checkpoint-(\d+))?/trainer_state\.json$"
    files = raw.select(
        F.regexp_extract(path, pattern, 1).alias("run"), path.alias("path"),
        F.nullif(F.regexp_extract(path, pattern, 2), F.lit("")).cast("long").alias("step"),
        "log_history",
    )
    chosen = best_log(files).select("path")
    entries = files.drop("step").join(chosen, "path", "left_semi").select(
        "run", F.posexplode("log_history").alias("pos", "entry"))
    keyed = entries.select("run", "pos", F.col("entry")["step"].cast("long").alias("step"),
                           F.explode("entry").alias("key", "text"))
    return keyed.select("run", "pos", "step", "key", F.col("text").try_cast("double").alias("value"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Product lines; broken lines are dropped, a missing file is empty."""
    return read_jsonl(spark, path, S.PRODUCT, "drop", empty_ok=True).drop("file", "value", "decoded")


def line_text(value: Column) -> Column:
    """The text of a mixed line: ``text``, joined ``messages``, ``reference``, a JSON string, or the
    line itself when it is no JSON."""
    alone = one_value(value)
    plain = F.get(alone, 0)
    shape = f"text STRING, messages {S.MESSAGES}, reference STRING"
    parsed = F.from_json(one_object(value), shape, STRICT)
    is_object = F.startswith(strip(value), F.lit("{"))
    is_string = F.startswith(strip(value), F.lit('"'))
    from_object = F.coalesce(
        F.nullif(parsed["text"], F.lit("")), joined(parsed["messages"]),
        F.nullif(parsed["reference"], F.lit("")), F.lit(""))
    other = F.lit("")  # other JSON values carry no text
    return (
        F.when(alone.isNull(), strip(value))
        .when(is_object, from_object).when(is_string, plain).otherwise(other)
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts of a mixed file, one per line, blank ones left out."""
    lines = _text(spark, path, empty_ok=False)
    return lines.select(line_text(F.col("value")).alias("text")).where(~is_blank(F.col("text")))


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference table stored as Parquet (``*.parquet``) or JSON lines."""
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def latency_columns(value: Column) -> list[Column]:
    """Fields of a tab-separated latency line: a timestamp, then ``key=value`` cells."""
    cells = F.split(value, "\t")

    def number(key: str) -> Column:
        return F.regexp_extract(value, rf"\t{key}=(-?[0-9.]+)", 1).try_cast("double")

    return [
        F.try_to_timestamp(F.get(cells, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.regexp_extract(value, r"\tadapter=([^\t]*)", 1).alias("adapter"),
        number("tokens").cast("long").alias("tokens"), number("ttft").alias("ttft"),
        number("tok_per_s").alias("tok_per_s"),
        number("decode_tok_per_s").alias("decode_tok_per_s"),
    ]


def read_latency_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The append-only latency log, as a table or as a stream of its folder."""
    reader = spark.readStream if stream else spark.read
    lines = reader.format("text").load(path)
    return lines.select(*latency_columns(F.col("value"))).where(F.col("ts").isNotNull())
