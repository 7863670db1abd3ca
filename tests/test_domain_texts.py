"""Facts, pages and cases from templates of a domain; the mixture with seeds; stock."""

import pytest
from pyspark.sql import functions as F

from sparkcurate.operators import catalog, lookup
from sparkcurate.operators import generate as G
from sparkcurate.plans.example_domain import ABSTAIN, KIT

BOOKS = ("label string, runbook_id string, title string, fix_steps array<string>, "
         "churn_risk struct<level: string, why: string>, compensation_policy struct<offer: string, when_proactive: boolean>")


@pytest.fixture
def books(spark):
    return spark.createDataFrame([
        ("A", "RB-A", "no sync", ["wait", "ask {title}"], ("low", "calm"), ("tea", True)),
        ("B", "RB-B", None, [], None, ("cake", False)), ("C", "RB-C", "gone", None, ("high", None), None)], BOOKS)


def test_pages_follow_the_template_of_the_domain(spark, books):
    page = "{runbook_id}: {title}\n{fix_steps}\n{fix_steps_prose} {churn_risk_level}/{churn_risk_why} {compensation_policy_offer} {offered}"
    got = {r.label: r.document for r in lookup.runbook_document(books, page, "first", "later").collect()}
    assert got == {"A": "RB-A: no sync\n1. wait\n2. ask {title}\nwait; ask {title}. low/calm tea first",
                   "B": "RB-B: \n\n. / cake later", "C": "RB-C: gone\n\n high/  later"}
    with pytest.raises(ValueError, match="unknown fields.*review"):
        lookup.runbook_document(books, "{review}")
    assert lookup.runbook_document(books.limit(0), page).count() == 0


def test_facts_ask_for_incidents_only_where_there_are_some(spark, books):
    incidents = spark.createDataFrame(
        [("A", 2, "late", "cue2", 7), ("A", 1, "first", "cue1", 4), ("A", 3, "x", "y", 10), ("A", 4, "x", "y", 6), ("Z", 1, "no book", "", 1)],
        "label string, id long, complaint string, key_cue string, ttr_min long")
    templates = {"id": ("Which page is {title}?", "{runbook_id}"), "before": ("Before {title}?", "{incident_id} {incident_complaint} {incident_cue} {incident_ttr}"),
                 "median": ("How long?", "{median_ttr} of {incidents}")}
    rows = {(r.label, r.fact): (r.question, r.answer) for r in G.templated_facts(books, templates, incidents).collect()}
    assert rows == {("A", "id"): ("Which page is no sync?", "RB-A"), ("B", "id"): ("Which page is ?", "RB-B"), ("C", "id"): ("Which page is gone?", "RB-C"),
                    ("A", "before"): ("Before no sync?", "1 first cue1 4"), ("A", "median"): ("How long?", "6 of 4")}
    with pytest.raises(ValueError, match="before asks for unknown fields"):
        G.templated_facts(books, templates)
    assert G.templated_facts(books, {"id": templates["id"]}).count() == 3
    assert G.knowledge_pairs(G.templated_facts(books, {"id": templates["id"]}), KIT.paraphrases).count() == 12


def test_first_incident_does_not_depend_on_the_order_of_rows(spark, books):
    rows = [("A", 1, "b", "z", 9), ("A", 1, "a", "y", 4), ("A", 1, "c", "x", 2), ("A", None, "0", "0", 0)]
    templates = {"before": ("Before?", "{incident_id} {incident_complaint} {incident_cue} {incident_ttr}")}
    for some in (rows, rows[::-1], rows[1:] + rows[:1]):
        incidents = spark.createDataFrame(some, "label string, id long, complaint string, key_cue string, ttr_min long").coalesce(1)
        assert [r.answer for r in G.templated_facts(books, templates, incidents).collect()] == ["1 a y 4"]


def test_hard_cases_keep_their_label(spark):
    rows = [(70, "it blinks", KIT.book.labels[0]), (5, "it hums", ABSTAIN), (9, "odd", "ELSEWHERE"), (1_000_000_007, None, None)]
    made = G.hard_records(spark.createDataFrame(rows, "case long, complaint string, label string"), KIT).collect()
    got = {r.id: (r.messages[0].content, r.leading_root_cause, r.mode, r.reference) for r in made}
    assert got == {"hard-00000": ("it hums", ABSTAIN, "abstention", ""), "hard-00001": ("odd", "ELSEWHERE", "abstention", ""),
                   "hard-00002": ("it blinks", KIT.book.labels[0], KIT.slices[KIT.book.labels[0]], ""),
                   "hard-00003": (None, None, "abstention", "")}


def test_only_groups_in_stock(spark):
    rows = [("X", 64, "còn hàng"), ("X", 64, "hết"), ("X", 128, "hết"), ("Y", None, " CÒN ít"), ("Z", 1, None)]
    products = spark.createDataFrame([(s, f"{s} phone", g, a, i) for i, (s, g, a) in enumerate(rows)],
                                     "series string, name string, storage_gb long, availability string, pos long").withColumns(
        {"price": F.lit(5).cast("long"), "color": F.lit("red"), "crawl_note": F.lit(None).cast("string"), "chip": F.lit("c")})
    groups = catalog.stocked(catalog.catalog_groups(products, ("chip",)))
    assert {(r.series, r.storage_gb) for r in groups.collect()} == {("X", 64), ("Y", None)}
