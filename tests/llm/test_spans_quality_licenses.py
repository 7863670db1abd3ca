"""Span operators, the rule ledger and licence scans against brute force, and at the edges."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from sparkcurate.llm import licenses, pii, quality, secrets
from sparkcurate.llm.spans import joined


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        value = int(c) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
)
SECRET = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda m: len(m[1]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
)

PIECES = (
    "a@b.c+d@e.f", "a@b.c.@d.e", "x..@y.z-1..", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "0001.2.3.4", "+1 (555) 123-4567-",
    "+49-30-1234567890123", "4111 1111 1111 1111", "4111-1111-1111-1111", "4" * 40, "+1+2 (212) 5551234", "é😀 a@é.c",
    "password=token=abcdef", "secret: api token=abcdefgh", "secret:token:abcdefgh", "API_KEY = 'zzzzzz'", "ApiKey:short",
    "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 8, "AKIA", "ab" * 12, "ab" * 11 + "c", "passwd\"=\"aaaaaa", "ghp_" + "x" * 40,
)


def brute(kinds, text):
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, pattern, keep) in enumerate(kinds)
             for m in re.finditer(pattern, text or "", re.ASCII) if keep(m)]
    return ",".join(s for *_, s in sorted(found))


def samples():
    rows = [(i, f"{a} {b}x {c}") for i, (a, b, c) in enumerate(zip(PIECES, PIECES[3:] + PIECES[:3], PIECES[7:] + PIECES[:7],
                                                                   strict=True))]
    return rows + [(100, None), (101, ""), (102, " ".join(PIECES) * 30), (102, " ".join(PIECES) * 30), (None, "me@a.b")]


def test_personal_data_equals_brute_force(spark):
    rows = samples()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit("clash"))
    found = pii.personal_data(docs).select("doc_id", joined(F.col("base"))).collect()
    assert Counter(map(tuple, found)) == Counter((i, brute(PII, t)) for i, t in rows)


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"foo{i} bar passport: 1{i}.2.3.{i} x the 7{i}.1.1.1 end") for i in range(10, 30)]
    rows += [(90, "qq passport: AB-12345 zz"), (91, "the B-777777 and the dog and the cat")]
    rows += [(200 + i, "the cat sat on the mat " * 5) for i in range(20)]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    more = dict(found.select("doc_id", joined(F.col("more"))).where("size(more) > 0").collect())
    assert more == {90: "ip:13:21"}


def test_long_runs_cost_linear_time(spark):
    text = "a" * 200_000 + " " + "1." * 50_000 + " " + "7" * 200_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.n for r in pii.personal_data(docs).select(F.size("base").alias("n")).collect()] == [12_500]


def test_secrets_equal_brute_force(spark):
    rows = samples()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rules", F.lit("clash"))
    base = F.filter("found", lambda s: s["rank"] < 3)
    found = secrets.find_secrets(docs)
    assert Counter(map(tuple, found.select("doc_id", joined(base)).collect())) == Counter(
        (i, brute(SECRET, t)) for i, t in rows)
    kinds = {k for r in found.collect() for k in [s.kind for s in r.found]}
    assert "github" in kinds


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.EVERYTHING
    assert secrets.trigram_query("AKIA[A-Z0-9]{16,}") == frozenset([frozenset(["aki", "kia"])])
    assert secrets.trigram_query("(abcd|xyz)+q?") == frozenset([frozenset(["abc", "bcd"]), frozenset(["xyz"])])
    assert secrets.trigram_query("a?b?") == secrets.EVERYTHING
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for text in PIECES:
            if re.search(rule.pattern, text):
                assert any(all(t in text.lower() for t in one) for one in query), (rule.kind, text)


def test_span_operators_at_the_edges(edge_docs, edge_rows, no_docs):
    for found in (pii.personal_data(edge_docs), secrets.find_secrets(edge_docs)):
        assert Counter(r.doc_id for r in found.collect()) == Counter(i for i, _, _ in edge_rows)
    assert pii.personal_data(no_docs).count() == 0 == secrets.find_secrets(no_docs).count()


def test_digest_of_no_span(spark):
    empty = spark.createDataFrame([(1, "")], "doc_id long, text string")
    row = pii.personal_data(empty).select(F.sha2(joined(F.col("base")), 256)).first()
    assert row[0] == hashlib.sha256(b"").hexdigest()


def brute_measures(text):
    words, text = (text or "").encode().split(), text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_ledger_equals_brute_force(spark, edge_docs, edge_rows, no_docs):
    texts = ["a b c d e f g h " * 3, "a b c d e f g h x a b c d e f g h", "l1 w\nl1 w\n\n \nl2\nl1 w", "# | < > a$b",
             " ".join(str(i % 13) for i in range(100)), "a b c d e f g", "a b c d e f g h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for frame, rows in ((docs, list(enumerate(texts))), (edge_docs, [(i, t) for i, t, _ in edge_rows])):
        found = Counter((r.doc_id, *(r[n] for n in names)) for r in quality.ledger(frame).collect())
        assert found == Counter((i, *brute_measures(t)) for i, t in rows)
    assert quality.ledger(no_docs).count() == 0


def test_policies_and_ablations_read_the_mask(spark):
    masks = [0, 1, 2, 3, 4, 8, 24, 88, 36]
    book = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "doc_id long, mask long")
    policy = quality.POLICIES[-1]

    def rejects(mask, gone=0):
        mask &= ~gone
        return bool(mask & quality.mask_of(policy.hard)) or bin(mask & quality.mask_of(policy.soft)).count("1") >= 2

    found = [r.r for r in book.select(quality.rejected(F.col("mask"), policy).alias("r")).orderBy("doc_id").collect()]
    assert found == [rejects(m) for m in masks]
    for r in quality.ablations(book, policy).collect():
        bit = quality.mask_of((r.rule,))
        assert (r.failed, r.only) == (sum(bool(m & bit) for m in masks),
                                      sum(rejects(m) and not rejects(m, bit) for m in masks))
        assert (r.rejected, r.documents) == (sum(map(rejects, masks)), len(masks))


def brute_license(lines, templates, frequency, n, threshold):
    idf, vectors, unknown = licenses.template_vectors(templates, frequency, n)
    best = None
    for line in lines:
        counts = Counter(re.findall(licenses.TERM, line.lower()))
        norm = math.sqrt(sum((k * idf.get(t, unknown)) ** 2 for t, k in counts.items())) or 1.0
        for name, vector in vectors:
            score = sum(k * idf.get(t, unknown) * vector.get(t, 0) for t, k in counts.items()) / norm
            if score >= threshold and (best is None or (-round(score, 9), name) < best):
                best = (-round(score, 9), name)
    return best


def test_licenses_equal_brute_force_and_are_inherited(spark):
    body = "some code line with the usual words of a file\n" * 5
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "p/LICENSE", mit), (2, "p/a/x.py", body), (3, "p/a/b/y.py", body + apache), (4, "p/a/b/c/z.py", body),
        (5, "p/a/b/COPYING", "Licensed under CC BY-NC 4.0."), (6, "q/x.py", body), (7, "q/y.py", body + "license of the thing"),
        (8, "top.py", body), (9, None, None), (10, "p/a/b/c/LICENSE.txt", "nothing known"), (None, "p/w.py", ""),
        (11, "p/a/x.py", body + "see MIT license notes released under water"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("row", F.lit("clash"))
    found = {r.doc_id: r for r in licenses.scan_licenses(files).collect()}
    vocabulary = sorted({t for _, x in licenses.TEMPLATES for t in re.findall(licenses.TERM, x.lower())})
    frequency = {t: sum(t in re.findall(licenses.TERM, (x or "").lower()) for *_, x in rows) for t in vocabulary}
    for i, _, text in rows:
        want = brute_license((text or "").split("\n"), licenses.TEMPLATES, frequency, len(rows), 0.7)
        r = found[i]
        if want:
            assert r.origin in ("header", "file") and (r.license, r.score) == (want[1], -want[0]), i
        else:
            assert r.origin in ("inherited", "none"), i
    assert [(found[i].license, found[i].origin) for i in (1, 2, 3, 4, 6, 8)] == [
        ("MIT", "file"), ("MIT", "inherited"), ("Apache-2.0", "header"), ("CC-BY-NC-4.0", "inherited"),
        (None, "none"), (None, "none")]
    assert found[4].from_dir == "p/a/b" and found[None].license == "MIT" and found[9].origin == "none"


def test_licenses_at_the_edges(edge_docs, edge_rows, no_docs):
    found = licenses.scan_licenses(edge_docs, path_col="source").collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _, _ in edge_rows)
    assert licenses.scan_licenses(no_docs, path_col="source").count() == 0


def planted():
    """Identifiers of four kinds of notices: only the first introduces addresses that the base patterns know."""
    known, first, second, third = ([f"{name}{i}-{i * 37 % 91}q" for i in range(n)]
                                   for name, n in (("none", 0), ("usr", 12), ("acc", 9), ("ref", 6)))
    rows = [f"please write mailbox: someone{i}@host{i}.org today" for i in range(30)]
    rows += [f"please write mailbox: {x} today" for x in first]
    rows += [f"then login= {x} works" for x in first * 2 + second]
    rows += [f"see ticket# {x} here" for x in second * 2 + third]
    rows += [f"about the {x} of the {x} or the end" for x in ("n1-x", "n2-x", "n3-x", "n4-x")] + ["the word the word the word"] * 40
    return [(i, text) for i, text in enumerate(rows)], first, second, third


def test_each_round_adds_identifiers_behind_new_patterns(spark):
    rows, *groups = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for rounds in (1, 2, 3, 4, 6):
        spans = pii.personal_data(docs, rounds=rounds).select(F.explode("more").alias("s")).select("s.kind", "s.value").collect()
        assert {r.kind for r in spans} == {"email"}
        found[rounds] = {r.value for r in spans}
    assert found[1] <= found[2] <= found[3] <= found[4] <= found[6]
    sizes = [len(found[r]) for r in (1, 2, 3, 6)]
    assert sizes[0] < sizes[-1] and len(set(sizes)) >= 3, sizes
    assert found[1] == set(groups[0])
    assert found[6] == {x for some in groups for x in some}


def test_support_does_not_grow_with_the_corpus(spark):
    rows, *groups = planted()
    noise = [(1000 + i, f"w{i % 50} other{i}@else{i}.net") for i in range(3000)]
    docs = spark.createDataFrame(rows + noise, "doc_id long, text string")
    spans = pii.personal_data(docs, rounds=6).select(F.explode("more").alias("s")).select("s.value").collect()
    assert {r.value for r in spans} >= set(groups[0])


def test_patterns_too_many_for_a_broadcast_are_counted_alike(spark, monkeypatch):
    rows, *groups = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ("doc_id", joined(F.concat("base", "more")).alias("spans"))
    one = sorted(map(tuple, pii.personal_data(docs).select(*columns).collect()))
    monkeypatch.setattr(pii, "broadcast_below", lambda df: df)
    assert sorted(map(tuple, pii.personal_data(docs).select(*columns).collect())) == one
