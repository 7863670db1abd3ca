import hashlib
import random
import zlib

import pytest
from checks.compare import duck, rows_of

from sparkcurate.llm import prefix_trie
from sparkcurate.llm.prefix_trie import ORACLES, conversation_trie, op13_prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, a string, block string, n string"


def ordered(rows):
    """conv_id: its turns (role, text) in order."""
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0,
                                                           r[2] or "", r[3] or "")):
        if c is not None:
            out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, inside in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = sorted(c for c in inside if len(convs[c]) == len(node))
        childless = [m for m in below if not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in members)]
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside),
                    sum(len(m) == len(node) + 1 for m in below), len(childless),
                    sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(frame):
    return sorted((tuple(r) for r in frame.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def drawn(rng, convs, longest):
    rows = []
    for c in range(convs):
        for turn in range(rng.randrange(1, longest + 1)):
            rows.append((c * rng.choice([1, 1, 3]), rng.choice([turn, turn, turn, None]), rng.choice(["user", "bot", None]),
                         rng.choice(["hi", "hé 😀", "", None])))
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize("longest", [4, 30])
def test_rebuilt_trie_equals_brute_force_and_sql(spark, tmp_path, longest):
    rows = drawn(random.Random(longest), 60, longest)
    rows += [(None, 1, "user", "hi")] * 3 + [(-7, 2, None, None), (-7, None, "bot", "x"), (1003, 5, "user", "hi")] + [rows[0]] * 4
    frame_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_prefix_trie(spark, str(tmp_path))
    assert digest(got) == brute(rebuilt(ordered(rows)))
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    result = con.execute(ORACLES["op13_prefix_trie"])
    columns = [d[0] for d in result.description]
    assert rows_of(columns, result.fetchall()) == rows_of(got.columns, got.collect())


def test_deep_trie_needs_a_few_levels_of_bands(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HEIGHT", 3)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(c, turn, "user", "hi" if turn < stop else f"t{c}") for c, stop in enumerate([150, 150, 149, 60, 30, 7, 1, 0])
            for turn in range(stop + rng.randrange(1, 4))]
    rows += [(20, turn, "user", rng.choice("ab")) for turn in range(200)] + [(21, 0, "user", "hi")]
    assert digest(conversation_trie(frame_of(spark, rows))) == brute(ordered(rows))


def test_many_ends_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 200)
    rows = [(c, 0, "user", "same") for c in range(-50, 3000)] + [(c, 1, "bot", "more") for c in range(100)]
    got = digest(conversation_trie(frame_of(spark, rows)))
    ids = ",".join(str(c) for c in range(-50, 3000) if not 0 <= c < 100)
    assert (-50, 1, -50, 3050, 1, 1, 3049 * 4 + 99 * 4, hashlib.sha256(ids.encode()).hexdigest()) in got
    assert len(got) == 3


def test_hot_parents_and_others_name_their_children_alike(spark, monkeypatch):
    rows = drawn(random.Random(9), 40, 6)
    want = brute(ordered(rows))
    for share in (1, 20, 10_000):
        monkeypatch.setattr(prefix_trie, "HOT_SHARE", share)
        assert digest(conversation_trie(frame_of(spark, rows))) == want


def test_empty_table_and_null_ids_only(spark):
    assert conversation_trie(frame_of(spark, [])).count() == 0
    assert conversation_trie(frame_of(spark, [(None, 1, "user", "x")])).count() == 0


def test_given_table_equals_sql(spark):
    small = "/root/testdata/sf0.001"
    got = op13_prefix_trie(spark, small)
    result = duck(small).execute(ORACLES["op13_prefix_trie"])
    assert rows_of([d[0] for d in result.description], result.fetchall()) == rows_of(got.columns, got.collect())
