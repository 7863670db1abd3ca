"""Record files, contract, splits, gold cases, formatting."""

import json

import pytest
from pyspark.sql import functions as F

from sparkcurate.functions import chat as C
from sparkcurate.operators import split as S
from sparkcurate.operators import turns as T
from sparkcurate.operators import validate as V
from sparkcurate.plans import curate
from sparkcurate.schemas import GOLD, RECORD
from sparkcurate.sources import readers as R
from sparkcurate.sources import writers as W

MODE = "eligibility"


def sft(number=1, **changes):
    record = {
        "id": f"s{number}", "data_type": "sft", "conversation_type": "multi_turn", "mode": MODE,
        "persona": "p", "lang": "en", "version": "v1", "audit_status": "approved",
        "messages": [
            {"role": "system", "content": "be kind"}, {"role": "user", "content": "hello"},
            {"role": "assistant", "content": "hi"}, {"role": "user", "content": "more"},
            {"role": "assistant", "content": "sure"}],
    }
    record.update(changes)
    return record


def reasoning(**changes):
    record = sft(data_type="reasoning", situation="s", reasoning=["a", "b"], response="r", why="audit")
    del record["messages"]
    record.update(changes)
    return record


def preference(**changes):
    record = sft(data_type="preference", bad_type="x", prompt=[{"role": "user", "content": "q"}],
                 chosen=[{"role": "assistant", "content": "good"}],
                 rejected=[{"role": "assistant", "content": "bad"}])
    del record["messages"]
    record.update(changes)
    return record


def write_lines(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n",
                    encoding="utf-8")
    return str(path)


TURN = {"role": "user", "content": "x"}

CASES = [
    (sft(), None), (sft(conversation_type="single_turn", extra="kept out"), None),
    (reasoning(), None), (preference(), None), (sft(id=" "), None),
    (sft(mode="nope"), "sft.mode: unknown value"),
    (sft(id=""), "sft.id: must not be empty"),
    (sft(messages=[TURN]), "sft.messages: needs an assistant turn"),
    (sft(messages=[{"role": "assistant", "content": "x"}]), "sft.messages: needs a user turn"),
    (sft(messages=[TURN, {"role": "assistant", "content": " \n "}]),
     "sft.messages: message content must not be blank"),
    (sft(messages=[TURN, {"role": "assistant", "content": "y", "name": "z"}]),
     "sft.messages: message has forbidden keys"),
    (sft(messages=[TURN, {"role": "bot", "content": "y"}]), "sft.messages: unknown role"),
    (sft(messages=[]), "sft.messages: must not be empty"),
    (sft(conversation_type="monologue"), "sft.conversation_type: unknown value"),
    (sft(data_type="essay"), "data_type: unknown value"),
    (reasoning(reasoning=["a", " "]), "reasoning.reasoning: steps must not be blank"),
    (reasoning(reasoning=[]), "reasoning.reasoning: must not be empty"),
    (preference(chosen=[TURN]), "preference.chosen: turns must all be assistant"),
    (preference(prompt=[{"role": "system", "content": "x"}]),
     "preference.prompt: needs a user turn"),
    ("{not json", "invalid JSON"), ('{"id": 1} trailing', "invalid JSON"), ("[1]", "invalid JSON"),
]


def test_contract(spark, tmp_path):
    path = write_lines(tmp_path / "mixed.jsonl", [c for c, _ in CASES] + ["   "])
    rows = R.read_records(spark, path)
    got = {r.value: r.first_error for r in rows.select("value", "first_error").collect()}
    assert len(got) == len(CASES)
    for line, error in CASES:
        assert got[line if isinstance(line, str) else json.dumps(line)] == error, line


def test_validation_stats_of_a_mixed_file(spark, tmp_path):
    lines = [sft(1), sft(2), sft(3, mode="nope"), "{broken", ""]
    rows = R.read_records(spark, write_lines(tmp_path / "m.jsonl", lines))
    stats = V.validation_stats(rows).first()
    assert (stats.total, stats.valid, stats.invalid) == (4, 2, 2)
    assert rows.where("NOT valid").count() == 2
    dist = {(r.dimension, r.value): r.n for r in V.valid_distribution(rows).collect()}
    assert dist == {("data_type", "sft"): 2, ("mode", MODE): 2}


def test_load_split(spark, tmp_path):
    write_lines(tmp_path / "sft" / "a.jsonl", [sft(1), sft(2), sft(3, audit_status="pending")])
    write_lines(tmp_path / "sft" / "b.jsonl", [sft(4, mode="nope")])
    kept, stats = R.load_split(spark, str(tmp_path))
    assert kept.count() == 2
    by_type = {r.data_type: r for r in stats.collect()}
    row = by_type["sft"]
    assert (row.total, row.valid, row.invalid, row.kept, row.filtered_out) == (4, 3, 1, 2, 1)
    assert R.load_split(spark, str(tmp_path), keep=None)[0].count() == 3
    empty, _ = R.load_split(spark, str(tmp_path), ("reasoning",))
    assert empty.count() == 0
    write_lines(tmp_path / "sft" / "c.jsonl", ["{broken"])
    with pytest.raises(Exception, match="invalid JSON"):
        R.load_split(spark, str(tmp_path))[0].collect()
    assert R.load_split(spark, str(tmp_path), on_error="quarantine")[0].count() == 2


def test_record_file_must_exist(spark, tmp_path):
    path = write_lines(tmp_path / "train.jsonl", [sft(1), "{x", sft(2, mode="nope")])
    assert R.load_record_file(spark, path).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.load_record_file(spark, str(tmp_path / "none.jsonl")).count()


def strata(spark, sizes):
    rows = [(f"{m}-{i}", m) for m, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id STRING, mode STRING")


def counts(split):
    return {(r.mode, r.split): r.n for r in split.groupBy("mode", "split").agg(
        F.count("*").alias("n")).collect()}


def test_stratified_holdout(spark):
    df = strata(spark, {f"m{i}": 40 for i in range(7)})
    first = S.stratified_holdout(df, "mode", "id", 0.10, 200, 42)
    val = {m: n for (m, s), n in counts(first).items() if s == "val"}
    assert len(val) == 7 and sum(val.values()) >= 200 and max(val.values()) - min(val.values()) <= 1
    assert first.count() == 280 and S.split_overlap(first, "id").isEmpty()
    one = S.stratified_holdout(df.repartition(1), "mode", "id", 0.10, 200, 42)
    many = S.stratified_holdout(df.repartition(64), "mode", "id", 0.10, 200, 42)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    other = S.stratified_holdout(df, "mode", "id", 0.10, 200, 43)
    assert not other.exceptAll(first).isEmpty()


def test_stratified_holdout_edges(spark):
    big = S.stratified_holdout(strata(spark, {f"m{i}": 100 for i in range(7)}), "mode", "id", 0.1, 50, 1)
    assert big.where("split = 'val'").count() >= 70
    lone = counts(S.stratified_holdout(strata(spark, {"a": 50, "b": 1, "c": 3}), "mode", "id", 0.1, 12, 1))
    assert lone[("b", "val")] == 1 and ("b", "train") not in lone
    assert lone[("c", "val")] == 2 and lone[("c", "train")] == 1 and lone[("a", "val")] == 4
    with pytest.raises(Exception, match="validation target"):
        S.stratified_holdout(strata(spark, {f"m{i}": 5 for i in range(7)}), "mode", "id", 0.1, 200, 1).count()
    with pytest.raises(ValueError, match="empty"):
        S.stratified_holdout(strata(spark, {}), "mode", "id", 0.1, 2, 1)


def test_hot_stratum_and_copies(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 7)).alias("mode"),
        F.when(F.col("id") < 9_000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("id"))
    out = S.stratified_holdout(rows, "mode", "id", 0.05, 10, 3)
    assert out.count() == 30_000
    sides = out.where("id = 'same'").groupBy("mode").agg(F.count_distinct("split").alias("n"))
    assert sides.where("n > 1").isEmpty()


@pytest.mark.parametrize(("n", "fraction", "val"), [(100, 0.1, 10), (100, 0.0, 0), (10, 0.05, 0), (10, 0.15, 2), (1, 0.5, 0)])
def test_flat_holdout(spark, n, fraction, val):
    out = S.flat_holdout(spark.range(n), "id", fraction, 5)
    assert (out.count(), out.where("split = 'val'").count()) == (n, val)


def test_preference_holdout(spark):
    assert S.preference_holdout(spark.range(19), "id", 1).where("split = 'val'").count() == 0
    assert S.preference_holdout(spark.range(20), "id", 1).where("split = 'val'").count() == 2


def test_mix():
    assert S.scaled_mix({"a": 900, "b": 100}, None) == {"a": 900, "b": 100}
    assert S.scaled_mix({"a": 900, "b": 1}, 9) == {"a": 9, "b": 1}


def test_curate_plan(spark, tmp_path):
    lines = [sft(i, mode=("eligibility", "cache_stale")[i % 2]) for i in range(40)]
    write_lines(tmp_path / "data" / "sft" / "a.jsonl", lines)
    args = (spark, str(tmp_path / "data"), "sft", str(tmp_path / "out"), 0.1, 6, 42)
    first = curate.split_pool(*args)
    assert first.where("split = 'val'").count() == 6
    write_lines(tmp_path / "data" / "sft" / "b.jsonl", lines)  # a stored split is reused
    assert curate.split_pool(*args).count() == 40
    curate.export_lines(first, str(tmp_path / "lines"))
    back = spark.read.text(str(tmp_path / "lines" / "val"))
    assert {json.loads(r.value)["id"] for r in back.collect()} == {
        r.id for r in first.where("split = 'val'").select("id").collect()}
    assert curate.uncovered_modes(first, ("eligibility", "knowledge")).first().mode == "knowledge"


def frame(spark, record):
    return spark.createDataFrame([record], RECORD)


def test_formatting(spark):
    messages = sft()["messages"]
    row = frame(spark, sft()).select(
        C.render(F.col("messages")).alias("t"), C.assistant_spans(F.col("messages")).alias("s"),
        C.assistant_turns(F.col("messages")).alias("n")).first()
    assert row.t == "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages)
    assert [row.t[s.start:s.end] for s in row.s] == ["hi", "sure"] and row.n == 2
    think = T.training_rows(frame(spark, reasoning()), thinking=True).first()
    assert think.messages[1].content == "<think>\na\nb\n</think>\nr" and "audit" not in think.text
    plain = T.training_rows(frame(spark, reasoning())).first()
    assert plain.messages[1].content == "r"
    with pytest.raises(Exception, match="no training messages"):
        T.training_rows(frame(spark, preference())).collect()


def test_long_spans_of_a_large_conversation(spark):
    turns = spark.range(5_000).select(
        F.lit(1).alias("conv"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.repeat(F.lit("é"), (F.col("id") % 7).cast("int")).alias("text"))
    rows = T.turn_segments(turns, "conv").orderBy("turn").collect()
    text = "".join(r.segment for r in rows)
    assert all(text[r.start:r.end] == "é" * (r.turn % 7) for r in rows)


GOLDS = [
    ({"id": "a", "mode": MODE, "reference": "R", "messages": [TURN, {"role": "assistant", "content": "A"}]},
     ["user"], "R"),
    ({"id": "b", "mode": MODE, "prompt": "q", "response": "A"}, ["user"], "A"),
    ({"id": "c", "mode": MODE, "reference": "R", "messages": [
        {"role": "system", "content": "s"}, TURN, {"role": "assistant", "content": "A"}, TURN]},
     ["system", "user", "assistant", "user"], "R"),
    ({"id": "d", "mode": MODE, "messages": [TURN, {"role": "assistant", "content": "A"}, TURN,
                                            {"role": "assistant", "content": "B"}, TURN]},
     ["user", "assistant", "user"], "B"),
    ({"id": "e", "mode": MODE, "messages": [{"role": "assistant", "content": "A"}]}, ["assistant"], "A"),
    ({"id": "f", "mode": MODE, "question": [TURN, TURN], "gold": "G"}, ["user", "user"], "G"),
]


def test_gold(spark, tmp_path):
    path = write_lines(tmp_path / "gold.jsonl", [g for g, _, _ in GOLDS])
    rows = {r.id: r for r in T.gold_cases(R.read_gold(spark, path)).collect()}
    for gold, roles, reference in GOLDS:
        row = rows[gold["id"]]
        assert ([m.role for m in row.messages], row.reference) == (roles, reference), gold


def test_labelled_gold(spark):
    rows = spark.createDataFrame(
        [{"messages": [TURN, {"role": "assistant", "content": "A"}, TURN]}, {"id": "z", "prompt": "only"}],
        GOLD).withColumn("pos", F.lit(7))
    got = sorted(tuple(r) for r in T.labelled_gold(rows, "NONE").collect())
    assert got == [("case-7", "unknown", "x\nx", "NONE", ""), ("z", "unknown", "only", "NONE", "")]


def test_mixed_text_lines(spark, tmp_path):
    path = write_lines(tmp_path / "calib.jsonl", [
        {"text": "one"}, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        '"three"', "plain four", "", {"reference": "five"}, {"other": 1}, "12"])
    assert [r.text for r in R.read_texts(spark, path).collect()] == ["one", "a\nb", "three", "plain four", "five"]


def test_reports_and_logs(spark, tmp_path):
    for run, body in {"r1": {"n": 3, "rc_accuracy": 0.5}, "r2": {"n": 1, "rc_accuracy": 1.0}}.items():
        (tmp_path / "eval" / run).mkdir(parents=True)
        (tmp_path / "eval" / run / "report.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "eval" / "r3").mkdir()
    (tmp_path / "eval" / "r3" / "report.json").write_text("{oops")
    got = {r.run: (r.n, r.rc_accuracy) for r in R.read_reports(spark, str(tmp_path / "eval")).collect()}
    assert got == {"r1": (3, 0.5), "r2": (1, 1.0)}
    for path, loss in {"a/checkpoint-10": 9, "a/checkpoint-20": 8, "b": 7, "b/checkpoint-99": 6}.items():
        (tmp_path / "runs" / path).mkdir(parents=True, exist_ok=True)
        state = {"log_history": [{"step": 1, "loss": loss, "done": True, "note": "text"}]}
        (tmp_path / "runs" / path / "trainer_state.json").write_text(json.dumps(state, indent=1))
    logs = R.read_training_logs(spark, str(tmp_path / "runs"))
    assert {(r.run, r.value) for r in logs.where("key = 'loss'").collect()} == {("a", 8.0), ("b", 7.0)}
    assert logs.where("key IN ('done', 'note') AND value IS NOT NULL").isEmpty()


def test_answer_csv(spark, tmp_path):
    path = tmp_path / "per_sample.csv"
    path.write_text('id,mode,prompt,answer,reference\n1,m,"a\nb","say ""x"", y",r\n2,m,p,old,r\n2,m,p,new,r\n,m,p,lost,r\n')
    rows = {r.id: r for r in R.read_answer_csv(spark, str(path)).collect()}
    assert set(rows) == {"1", "2"} and rows["2"].answer == "new"
    assert rows["1"].prompt == "a\nb" and rows["1"].answer == 'say "x", y'
    (tmp_path / "kpi.csv").write_text("id,slice\n1,x\n")
    with pytest.raises(ValueError, match="columns missing"):
        R.read_answer_csv(spark, str(tmp_path / "kpi.csv"))


def test_products_latency_dimension(spark, tmp_path):
    path = write_lines(tmp_path / "p.jsonl", [{"series": "X", "price": 5}, "{bad", ""])
    assert [(r.series, r.price) for r in R.read_products(spark, path).collect()] == [("X", 5)]
    assert R.read_products(spark, str(tmp_path / "none.jsonl")).isEmpty()
    line = "2024-05-01 10:00:00\tadapter=a/b\t4bit=True\ttokens=12\tttft=0.250s\ttok_per_s=8.50\tdecode_tok_per_s=9.00\tprompt='x'"
    (tmp_path / "lat.tsv").write_text(line + "\nnot a line\n")
    row = R.read_latency_log(spark, str(tmp_path / "lat.tsv")).collect()
    assert len(row) == 1 and (row[0].tokens, row[0].ttft, row[0].adapter) == (12, 0.25, "a/b")
    path = write_lines(tmp_path / "dim.jsonl", [{"label": "A", "sig_id": 1, "phrases": ["x"]}])
    dim = R.read_dimension(spark, path, "label STRING, sig_id INT, phrases ARRAY<STRING>")
    assert dim.first().phrases == ["x"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q"x', "train"), ("b", None, "val")], "id STRING, t STRING, split STRING")
    W.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    W.write_table(df, str(tmp_path / "p"), ("split",))
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'val'").first().id == "b"
    W.write_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"')
    assert {r.t for r in back.collect()} == {'q"x', None}
    W.append_runs(df.select("id"), str(tmp_path / "runs"))
    W.append_runs(df.select("id"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4
    assert W.ordered(df, ("split",)).columns == ["split", "id", "t"]
    assert [r.id for r in W.shuffled_order(df, "id", 1).collect()] == [
        r.id for r in W.shuffled_order(df.repartition(3), "id", 1).collect()]


def test_raw_lines_may_be_compressed(spark, tmp_path):
    from sparkcurate.sources import writers

    lines = ["{}", '{"a": "ü"}', ""]
    writers.write_raw_lines(spark.createDataFrame([(x,) for x in lines], "value string"), str(tmp_path / "raw"), compression="gzip")
    assert list((tmp_path / "raw").glob("*.txt.gz"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "raw" / "*.txt.gz")).collect()) == sorted(lines)
