"""SimHash near-duplicates: fuzzy keys from Golay codewords, joined, verified, and linked to groups.

A 64-bit fingerprint is cut into ``segments``; two fingerprints that differ in at most ``radius`` bits
differ in at most one bit in at least ``segments - radius // 2`` of them, because a segment with two
or more takes two of the ``radius``. Such a segment is decoded in the perfect binary Golay code of
length 23: a word has exactly one codeword within three bits, and words one bit apart share a codeword
if one side brings its nearest and the other brings all within four bits (six of them at most). Keys
are the codeword indices of every choice of that many segments, so no pair within the radius is lost.

Scale: equal fingerprints are one node before anything is joined, so copies cost nothing. A node has
6 keys on one side and 190 at most on the other. Candidates of unrelated fingerprints
are about 1e-5 of all ordered pairs with four segments and are dropped inside the join; five segments
make that about 2e-9 at ten times the keys, for corpora of billions of documents. The component
search moves edges between distinct fingerprints only, each round written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import documents, own, small_batches, stored

#: Generator polynomial of the binary Golay code of length 23, and the hash seed.
GOLAY_POLYNOMIAL = 0xC75
SEED = 42

#: Bits of every byte value, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")

#: Shingles hashed at a time: bounds the memory for one very long text.
STEP = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """Signed 64-bit SimHash of a text; 0 for a text without words and for null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - words_per_shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, count, STEP):
        part = words[start : start + STEP + words_per_shingle - 1]
        shifted = [part[i:] for i in range(min(words_per_shingle, len(part)))]
        hashes = np.array(
            [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*shifted, strict=False)],
            dtype="<u8",
        )
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ BYTE_BITS
    value = sum(1 << i for i in np.flatnonzero(2 * ones > count).tolist())
    return value - (1 << 64) if value >> 63 else value


def _remainder(word: int) -> int:
    """The syndrome of a 23-bit word: its remainder by the generator polynomial."""
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY_POLYNOMIAL << (bit - 11)
    return word


#: Tables of :func:`segment_keys` by width; a task builds each once.
TABLES: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}


def segment_keys(width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every value of a segment: the index of its nearest codeword, and all it must answer to.

    A segment fills the leading bits of the 23. The index of a codeword is its first twelve bits.
    """
    if width in TABLES:
        return TABLES[width]
    single = [_remainder(1 << i) for i in range(23)]
    leader = np.full(2048, -1, dtype=np.int64)
    fours: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(23), weight):
            pattern = syndrome = 0
            for i in bits:
                pattern |= 1 << i
                syndrome ^= single[i]
            if weight < 4:
                leader[syndrome] = pattern
            elif bin(int(leader[syndrome])).count("1") == 3:
                fours.setdefault(syndrome, []).append(pattern)
    words = np.arange(1 << width, dtype=np.int64) << (23 - width)
    syndromes = np.zeros(len(words), dtype=np.int64)
    for i in range(23):
        syndromes ^= np.where(words >> i & 1, single[i], 0)
    nearest = (words ^ leader[syndromes]) >> 11
    near = {s: np.array([int(leader[s]), *fours.get(s, [])]) for s in range(2048)}
    answers = [(w ^ near[s]) >> 11 for w, s in zip(words.tolist(), syndromes.tolist(), strict=True)]
    TABLES[width] = nearest, answers
    return TABLES[width]


def widths(segments: int) -> list[int]:
    """Bits of each segment; they cover all 64."""
    return [64 // segments + (i < 64 % segments) for i in range(segments)]


def fuzzy_keys(value: int, segments: int, radius: int, wide: bool) -> list[int]:
    """Join keys of a fingerprint: one per choice of segments, or all it answers to if ``wide``."""
    value &= (1 << 64) - 1
    options = []
    for width in widths(segments):
        nearest, answers = segment_keys(width)
        part = value & ((1 << width) - 1)
        value >>= width
        options.append(answers[part].tolist() if wide else [int(nearest[part])])
    keys = []
    for number, chosen in enumerate(combinations(options, segments - radius // 2)):
        for indexes in product(*chosen):
            key = number
            for index in indexes:
                key = key << 12 | index
            keys.append(key)
    return keys


def fingerprint_links(nodes: DataFrame, segments: int = 4, radius: int = 4) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct ``fp`` in ``nodes`` within ``radius`` bits."""

    def keys_of(wide: bool):
        @F.pandas_udf("array<bigint>")
        def keys(values: pd.Series) -> pd.Series:
            return pd.Series([fuzzy_keys(v, segments, radius, wide) for v in values.tolist()])

        return keys

    left = nodes.select(F.col("fp").alias("a"), F.explode(keys_of(False)("fp")).alias("key"))
    right = nodes.select(F.col("fp").alias("b"), F.explode(keys_of(True)("fp")).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # Spark takes the keys for no larger than the nodes they come from and would broadcast all of them.
    return left.join(right.hint("merge"), "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node and root, its smallest node.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest
    it knows, until every node hangs on a root; about log2(longest path) rounds. A node of any degree is only
    ever reduced to a minimum, which combines before the shuffle.
    """

    def settled(pairs: DataFrame) -> bool:
        """Whether each larger end has one smaller one, which is itself no larger end."""
        ends = pairs.selectExpr("a AS node", "1 AS up", "0 AS down").unionByName(
            pairs.selectExpr("b AS node", "0 AS up", "1 AS down"))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return nodes.where("up > 1 OR (up > 0 AND down > 0)").count() == 0

    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .where("a <> b").distinct())
    while not settled(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(small.where("a <> b").unionByName(least.toDF("a", "b")).distinct())
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_of(text: Column) -> Column:
    """The fingerprint of a text column."""
    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return simhash(text)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    segments: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and group of every row: the id, ``fingerprint`` (16 hex digits), ``component_id``.

    One row per input row, repeated rows included. ``component_id`` is the smallest id that is
    reachable over links of at most ``radius`` bits, the row's own included. A null or wordless text
    has fingerprint zero and links like any other. A null id never is a group's name: a group without
    any id has the name null. An empty table gives an empty result. Extra columns are ignored.
    """
    docs = small_batches(docs)
    rows = stored(docs.select(F.col(id_col).alias("id"), simhash_of(F.col(text_col)).alias("fp")))
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(fingerprint_links(nodes, segments, radius))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root"))
    names = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    # A file of rows with few fingerprints says little of their number: neither side is broadcast by it.
    named = grouped.join(names, "root").select(F.col("fp").alias("of"), "component_id").hint("merge")
    return rows.join(named, rows["fp"] == named["of"]).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def least_rows(rows: DataFrame, roots: DataFrame, row: str, node: str) -> DataFrame:
    """Of each group one of ``rows``: that with the least (doc_id, text hash, row number), null ids last.

    ``row`` and ``node`` name the columns of the row number and of the node of the row's text; ``roots``
    (node, root) has the nodes that are linked. A group is its root, whatever ids its rows carry. Minima
    combine before the shuffle, so a node or group of any size is reduced where its rows lie.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"),
                     F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"), F.col(row).alias("row"))
    nodes = rows.groupBy(F.col(node).alias("of")).agg(F.min(order).alias("best"))
    linked = nodes.join(roots, nodes["of"] == roots["node"], "left").select(
        F.coalesce("root", "of").alias("root"), "best")
    kept = linked.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return rows.join(kept, row, "left_semi")


def one_per_group(docs: DataFrame) -> DataFrame:
    """Documents without their near-duplicates: of each group the row with the least id, null ids last.

    Columns as given. A group is its linked fingerprints: rows without an id, or with the same one,
    share a group only if their texts do. Of rows with the least id the one with the smallest text hash
    stays, and of repeated ones the first.
    """
    row, node = own("row"), own("fp")
    marked = stored(small_batches(docs).withColumn(node, simhash_of(F.col("text"))).withColumn(
        row, F.monotonically_increasing_id()))
    roots = components(fingerprint_links(marked.select(F.col(node).alias("fp")).distinct()))
    return least_rows(marked, roots, row, node).select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
