"""Text and answer expressions on literal inputs."""

import pytest
from pyspark.sql import functions as F

from sparkcurate.functions import answers as A
from sparkcurate.functions import text as X

L = F.lit


def test_whitespace_list_is_complete():
    assert set(X.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_claim_patterns(one):
    row = one(
        a=X.pattern_hits(L("webhook delivered at T+28s"), X.CLAIM_PATTERNS),
        b=X.pattern_hits(L("the record was not found"), X.CLAIM_PATTERNS),
        c=X.pattern_hits(L("I cannot see the TCU last_seen from the ticket"), X.CLAIM_PATTERNS),
        d=X.pattern_hits(L("seen 2024-01-02 03:04 and 3:15 pm"), X.CLAIM_PATTERNS),
        e=X.pattern_hits(L(None).cast("string"), X.CLAIM_PATTERNS),
        f=X.pattern_hits(L("a Full refund, 2 years free, guaranteed"), X.PROMISE_PATTERNS),
    )
    assert row.a == ["T+28s", "delivered at", "webhook delivered"]
    assert row.b == ["record was not found"]
    assert row.c == [] and row.e == []
    assert row.d == ["2024-01-02 03:04", "3:15 pm"]
    assert row.f == ["Full refund", "years free", "guaranteed"]


def test_grounding(one):
    ticket = X.content_tokens(L("My car is parked in the underground garage all week"))
    row = one(
        a=X.is_grounded(L("parked in underground garage"), ticket),
        b=X.is_grounded(L("the webhook was delivered at T+28s"), ticket),
        c=X.is_grounded(L("the and of"), ticket),
        d=X.is_grounded(L("garage"), ticket),
        e=X.is_grounded(L("parked garage roof"), ticket),
    )
    assert (row.a, row.b, row.c, row.d, row.e) == (True, False, False, True, False)


def test_signatures_are_substrings(spark):
    rows = spark.createDataFrame([
        (1, "parked in an underground garage, remote start TIMES-OUT"), (2, "I subscribed"),
        (3, "the grand total"), (4, ""),
    ], "id INT, text STRING").withColumn("n", X.normalise(F.col("text")))
    signatures = {"OFFLINE": [["garage"], ["times out"]], "RULE": [["asks", "subscribe"]],
                  "OTA": [["ota"]]}
    got = {r.id: r.d for r in rows.select("id", X.detect_labels(F.col("n"), signatures).alias("d")).collect()}
    assert got == {1: ["OFFLINE"], 2: [], 3: ["OTA"], 4: []}


@pytest.mark.parametrize(("text", "think", "rest"), [
    ("<think>a\nb</think>{}", "a\nb", "{}"),
    ("x <THINK> a </Think> y <think>z</think>", "a", "y <think>z</think>"),
    (" no block ", "", "no block"), ("<think>open", "", "<think>open"),
])
def test_split_think(one, text, think, rest):
    row = one(t=A.think_text(L(text)), r=A.after_think(L(text)))
    assert (row.t, row.r) == (think, rest)


@pytest.mark.parametrize(("text", "parsed"), [
    ('noise {"a": 1} tail }', {"a": "1"}), ("{}", {}), ('{"a": 1', None), ("{a: 1}", None),
    ("{'a': 1}", None), ("no object", None), ('{"a": "}{"}', {"a": "}{"}),
    ('{"a": {"b": [1]}}', {"a": '{"b":[1]}'}),
])
def test_first_json_object(one, text, parsed):
    assert one(j=A.loose_json(L(text))).j == parsed


@pytest.mark.parametrize(("text", "tone", "winner"), [
    ('ok {"tone": 4, "winner": "b"} end', 4.0, "B"), ("{}", 3.0, "tie"),
    ('{"tone": "9"}', 5.0, "tie"), ('{"tone": -1, "winner": "A "}', 1.0, "A"),
    ("garbage", 3.0, "tie"), ('{"tone": null}', 3.0, "tie"), ('{"tone": true}', 1.0, "tie"),
    ('{"tone": 5} x {"tone": 5}', 3.0, "tie"),
])
def test_judge_reply(one, text, tone, winner):
    row = one(s=A.judge_score(A.judge_json(L(text)), "tone"), w=A.judge_winner(A.judge_json(L(text))))
    assert (row.s, row.w) == (tone, winner)


def test_tool_calls(one):
    text = ('<tool_call>\n{"name": "look", "arguments": {"gb": 512}}\n</tool_call> and '
            "<tool_call><function=look><parameter=gb> 0512 </parameter><parameter=series>\nX 1\n"
            "</parameter><parameter=gb>64</parameter></function></tool_call>"
            "<tool_call>{bad</tool_call><tool_call>plain</tool_call>"
            '<tool_call>{"name": "s", "arguments": "{\\"k\\": 1}"}</tool_call>')
    calls = one(c=A.tool_calls(L(text))).c
    assert [(c.name, c.arguments) for c in calls] == [
        ("look", {"gb": "512"}), ("look", {"series": "X 1", "gb": "64"}), ("s", {"k": "1"})]
    assert one(c=A.tool_calls(L("nothing"))).c == []


def test_overlap_and_proxy(one):
    row = one(a=X.overlap_f1(L("a b c"), L("A  b\tc")), b=X.overlap_f1(L(""), L("x")),
              c=X.proxy_score(L("a b"), L("b a")), d=X.proxy_score(L("a"), L("b")),
              e=X.overlap_f1(L("a b"), L("a c c")), f=X.overlap_f1(L(None).cast("string"), L("x")))
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (1.0, 0.0, 5.0, 1.0, 0.5, 0.0)


def test_clean_answer(one):
    row = one(a=X.clean_answer(L("hi <think>x</think>there<|im_end|>user")),
              b=X.clean_answer(L("done <think>next turn")), c=X.answer_part(L("r</think> so</think>")),
              d=X.think_part(L(" <think> why\n</think>so")))
    assert (row.a, row.b, row.c, row.d) == ("hi there", "done", "so", "why")


def test_fragments_and_sentences(one):
    row = one(a=X.short_fragment(L("Error 403 after refund")), b=X.short_fragment(L("It's all, just odd")),
              c=X.cue_sentences(L("All fine. The garage is dark! Why? In the garage."), [["garage"]]),
              d=X.cue_sentences(L("Nothing here..."), [["garage"]]))
    assert (row.a, row.b) == ("403", "it s all")
    assert row.c == ["The garage is dark", "In the garage"]
    assert row.d == ["Nothing here"]
