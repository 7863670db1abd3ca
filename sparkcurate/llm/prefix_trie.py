"""Conversation prefix trie: nodes and their subtree totals by a depth-band rollup.

A node is a distinct sequence of first turns. Its key is the XOR of 128-bit hashes of (place, role, text) of its
turns, so keys of all prefixes are a running XOR and a parent's key is one XOR away. Subtree totals climb the trie
in bands of ``HEIGHT`` depths: a node is handed to its ancestors within its band only, along any
conversation that goes through it; that completes the lowest band. The tops of all bands form a smaller trie,
whose totals come from the same rollup; a completed top is then handed to the ``HEIGHT`` nodes of the
band above it. So a node is copied ``HEIGHT`` times at most per level, and a trie of depth n has log n
levels.

Scale: conversations of any length are ordered and numbered by ranges of all rows, not by conversation; running
XORs work in blocks. Node totals combine before their shuffle. A parent's name reaches its children by a
broadcast where it has over a ten-thousandth of all nodes as children (so there are fewer than 10,000 of
those), by a join elsewhere. Digests read ids in ranges first and then stream over their joined texts, so that
a node where a third of all conversations end is a few rows in no memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurate.llm.common import small_batches, stored

#: Depths of a band, and turns in a block of running XORs.
HEIGHT, BLOCK = 8, 1024
#: Nodes with more than this share of all nodes as children are broadcast.
HOT_SHARE = 10_000
#: Bytes of joined ids in one piece of a digest's input.
PIECE_BYTES = 1 << 16


def numbered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, turn, role, text) as (conv_id, block, i, x, y, bytes), and blocks (conv_id, block, n, before).

    i counts a conversation's turns from 1 by turn, null first, ties by role and text. x and y are hashes of
    role and text, ``bytes`` the length of the text. A block is what one range of the sorted rows holds of a
    conversation, with ``before`` rows in earlier blocks.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")] + [F.col("arrival")]
    rows = turns.withColumn("arrival", F.monotonically_increasing_id()).repartitionByRange(*order)
    rows = stored(rows.sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.octet_length("text").cast("long").alias("bytes"),
        F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "text", "role").alias("y"),
    ).withColumn("block", F.shiftright("at", 33)))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    blocks = stored(blocks)
    made = rows.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "block", (F.col("at") - F.col("first") + F.col("before") + 1).alias("i"), "x", "y", "bytes")
    return made, blocks.select("conv_id", "block", "n", "before")


def prefix_keys(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, depth from 1, x, y, bytes) with the key (a, b) of their prefix and that of its parent (pa, pb)."""
    mine = rows.select(
        "conv_id", "depth", "bytes", F.xxhash64(F.lit(3), "depth", "x", "y").alias("x"),
        F.xxhash64(F.lit(4), "depth", "y", "x").alias("y"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = mine.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty")).select(
        "conv_id", "block", F.coalesce(F.bit_xor("tx").over(earlier), F.lit(0)).alias("tx"),
        F.coalesce(F.bit_xor("ty").over(earlier), F.lit(0)).alias("ty"))
    within = mine.withColumns({"a": F.bit_xor("x").over(inside), "b": F.bit_xor("y").over(inside)})
    made = within.join(totals, ["conv_id", "block"])
    a, b = F.col("a").bitwiseXOR(F.col("tx")), F.col("b").bitwiseXOR(F.col("ty"))
    return made.select("conv_id", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"),
                       b.bitwiseXOR(F.col("y")).alias("pb"), "bytes")


def subtree_totals(nodes: DataFrame, rows: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """(a, b, values): the sums of ``values`` over each node's subtree, the node included.

    ``nodes``: a, b, conv_id (a conversation through the node), depth from 0, values. ``rows``: conv_id, depth, a,
    b of every prefix of those conversations.
    """
    path = rows.select(F.col("conv_id").alias("c"), F.floor(F.col("depth") / HEIGHT).alias("band"),
                       F.col("depth").alias("d"), "a", "b")
    placed = nodes.select("conv_id", "depth", *values, F.floor(F.col("depth") / HEIGHT).alias("of"),
                          F.col("a").alias("na"), F.col("b").alias("nb"))
    sums = [F.sum(v).alias(v) for v in values]
    met = placed.join(path, (F.col("conv_id") == F.col("c")) & (F.col("of") == F.col("band"))
                      & (F.col("d") <= F.col("depth")))
    within = met.groupBy("a", "b").agg(*sums)
    if deepest < HEIGHT:
        return within
    within = stored(within)
    tops = nodes.where(F.col("depth") % HEIGHT == 0).select("a", "b", "conv_id", "depth").join(within, ["a", "b"])
    tops = tops.withColumn("depth", F.floor(F.col("depth") / HEIGHT))
    above = rows.where(F.col("depth") % HEIGHT == 0).withColumn("depth", F.floor(F.col("depth") / HEIGHT))
    done = subtree_totals(tops, above, values, deepest // HEIGHT)
    handed = tops.where("depth > 0").select("a", "b", "conv_id", (F.col("depth") - 1).alias("of")).join(
        done, ["a", "b"]).drop("a", "b")
    met = handed.join(path, (F.col("conv_id") == F.col("c")) & (F.col("of") == F.col("band")))
    return stored(within.unionByName(met.select("a", "b", *values)).groupBy("a", "b").agg(*sums))


def _joined_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, b, conv_id), sorted, as (a, b, first, ids): stretches of one node's ids, comma-joined."""
    for rows in batches:
        new = (rows["a"].diff().ne(0) | rows["b"].diff().ne(0)).cumsum()
        size = rows.groupby(new).cumcount() // (PIECE_BYTES // 20)
        parts = rows.assign(text=rows["conv_id"].astype(str)).groupby([new, size], sort=False)
        yield pd.DataFrame({"a": parts["a"].first(), "b": parts["b"].first(), "first": parts["conv_id"].first(),
                            "ids": parts["text"].agg(",".join)})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, b, first, ids), sorted, as (a, b, ends_sha256); holds one digest at a time."""
    key, state = None, None
    for rows in batches:
        out = []
        for a, b, ids in zip(rows["a"].tolist(), rows["b"].tolist(), rows["ids"], strict=True):
            if (a, b) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
    if key:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["a", "b", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): the digest of the ids that end at each node, ascending, from rows (conv_id, a, b)."""
    ranged = small_batches(ends).repartitionByRange("conv_id").sortWithinPartitions("a", "b", "conv_id")
    parts = ranged.select("a", "b", "conv_id").mapInPandas(_joined_ids, "a long, b long, first long, ids string")
    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInPandas(
        _digests, "a long, b long, ends_sha256 string")


def _parents(nodes: DataFrame, children: DataFrame, total: int) -> DataFrame:
    """``nodes`` with parent_conv_id, null for the root."""
    names = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    often = children.where(F.col("n_children") > total // HOT_SHARE).select("pa", "pb")
    hot = names.join(often, ["pa", "pb"])
    marked = nodes.join(F.broadcast(hot), ["pa", "pb"], "left")
    known = (F.col("depth") == 0) | F.col("parent_conv_id").isNotNull()
    rest = marked.where(~known).drop("parent_conv_id").join(names, ["pa", "pb"])
    return marked.where(known).unionByName(rest)


def trie(prefixes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations.

    ``prefixes``: rows of :func:`prefix_keys`. ``conversations``: conv_id, n (turns, 0 or more), one row each. One
    row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes
    of last texts, counted once per member but the first, over the subtree), ends_sha256, and its key (a, b).
    Without a conversation there is no node, not even the root.
    """
    roots = conversations.select("conv_id", *[
        F.lit(None if c in ("pa", "pb") else 0).cast("long").alias(c) for c in ("depth", "a", "b", "pa", "pb", "bytes")])
    rows = stored(prefixes.unionByName(roots))
    nodes = rows.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("pa").alias("pa"),
        F.min("pb").alias("pb"), F.min("bytes").alias("bytes"))
    nodes = stored(nodes)
    total, deepest = nodes.agg(F.count(F.lit(1)), F.max("depth")).first()
    children = nodes.where("depth > 0").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"))
    children = stored(children)
    counted = stored(nodes.join(children.toDF("a", "b", "n_children"), ["a", "b"], "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.col("n_children").isNull().cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))
    sums = subtree_totals(counted, rows.select("conv_id", "depth", "a", "b"), ["n_leaves", "saved_tokens"], deepest or 0)
    ends = rows.join(conversations, "conv_id").where(F.col("depth") == F.col("n")).select("conv_id", "a", "b")
    named = _parents(counted.drop("n_leaves", "saved_tokens", "bytes"), children, total)
    return named.join(sums, ["a", "b"]).join(ends_digests(ends), ["a", "b"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))).drop("pa", "pb")


def turns_of(table: DataFrame) -> DataFrame:
    """Columns conv_id, turn, role and text of the rows with a conv_id; null roles and texts are empty ones."""
    return table.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]).where(
        "conv_id IS NOT NULL")


def conversation_trie(table: DataFrame) -> DataFrame:
    """The trie of a table's conversations as they are; see :func:`trie`.

    Turns are ordered by turn, null first, ties by role and text; repeated rows are turns of their own. Null
    roles and texts are empty. Rows without a conv_id belong to no conversation. Extra columns are ignored.
    """
    turns, blocks = numbered_turns(turns_of(table))
    prefixes = prefix_keys(turns.select("conv_id", F.col("i").alias("depth"), "x", "y", "bytes"))
    return trie(prefixes, blocks.groupBy("conv_id").agg(F.sum("n").alias("n")))


def rebuilt_trie(table: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations: first turns from conversation c - c % 5, the rest their own.

    h = crc32(c) % 9 turns come from there, all it has if fewer, none without it; a conversation's own turns
    follow after its first h. Order, ties and nulls as in :func:`conversation_trie`.
    """
    turns, blocks = numbered_turns(turns_of(table))
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % 9
    sizes = blocks.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumns(
        {"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5})
    sizes = sizes.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    sizes = stored(sizes.withColumn("m", F.least("h", F.coalesce("there", F.lit(0)))))
    heads = turns.where("i <= 8").select(F.col("conv_id").alias("base"), F.col("i").alias("depth"), "x", "y", "bytes")
    taken = sizes.where("m > 0").select("conv_id", "base", "m").join(heads, "base").where("depth <= m").drop("base", "m")
    # Turns meet their conversation's numbers block by block: no conversation is one task's work.
    placed = blocks.join(sizes.select("conv_id", "h", "m"), "conv_id").select("conv_id", "block", "h", "m")
    rest = turns.join(placed, ["conv_id", "block"]).where("i > h").select(
        "conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("depth"), "x", "y", "bytes")
    lengths = sizes.select("conv_id", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return trie(prefix_keys(taken.unionByName(rest)), lengths)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select(*[
        F.col(c) if c == "ends_sha256" else F.col(c).cast("long") for c in columns])


#: crc32 by its definition, bit by bit: 3988292384 is the fixed polynomial in reversed order.
SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT)))) % 9 AS h
  FROM turns GROUP BY conv_id),
taken AS (SELECT s.*, least(s.h, coalesce(b.own, 0)) AS m FROM sizes s LEFT JOIN sizes b ON s.base = b.conv_id),
rebuilt AS (
  SELECT s.conv_id, t.i AS d, t.role, t.text FROM taken s JOIN turns t ON t.conv_id = s.base AND t.i <= s.m
  UNION ALL
  SELECT s.conv_id, s.m + t.i - s.h, t.role, t.text FROM taken s JOIN turns t ON t.conv_id = s.conv_id AND t.i > s.h),
lengths AS (SELECT conv_id, m + greatest(own - h, 0) AS n FROM taken),
rows_ AS (
  SELECT conv_id, d, octet_length(encode(text)) AS bytes, to_json(list(struct_pack(r := role, t := text)) OVER (
    PARTITION BY conv_id ORDER BY d))::VARCHAR AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '[]' FROM taken),
named AS (SELECT r.conv_id, r.d, r.bytes, md5(r.key) AS key, md5(p.key) AS parent
  FROM rows_ r LEFT JOIN rows_ p ON p.conv_id = r.conv_id AND p.d = r.d - 1),
nodes AS (SELECT key, min(conv_id) AS conv_id, min(d) AS d, count(*) AS n_convs, min(bytes) AS bytes, min(parent) AS parent
  FROM named GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM named JOIN lengths USING (conv_id) WHERE d = n GROUP BY key),
sums AS (
  SELECT a.key, count(*) FILTER (WHERE c.n IS NULL) AS leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM nodes x JOIN named a ON a.conv_id = x.conv_id AND a.d <= x.d LEFT JOIN children c ON c.key = x.key
  GROUP BY a.key)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children,
  s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes x JOIN sums s ON s.key = x.key LEFT JOIN nodes p ON p.key = x.parent
LEFT JOIN children c ON c.key = x.key LEFT JOIN ends e ON e.key = x.key
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": SQL}
