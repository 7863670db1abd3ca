"""Near copies by similarity: binary fingerprints, Golay keys of their segments, exact Jaccard, linked groups.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at least ``LEAST``.
A fingerprint has ``LANES`` times 64 bits. Bits of a SimHash differ with a chance of 0.15 at 0.8, and Golay keys then
find 0.86 of the pairs between 0.8 and 0.85 only. So a bit here is one of the least shingle of its bin, which
differs with a chance of (1 - similarity) / 2, 0.1 at 0.8. 460 of the bits form ``SEGMENTS`` words of the
binary Golay code of length 23. A word has one nearest codeword and up to six within four bits; words meet if one
brings its nearest codeword and the other all six. Two neighbouring segments together make a key, the codeword indices
of both: a text has ten keys on one side and 360 at most on the other, and two texts are candidates if any
key meets in either direction. That finds 0.996 of pairs at exactly 0.8; unlike texts meet four times in 100,000
pairs, and 256 bits, compared inside the join, drop all of those. Candidates within the bits that differ
at 0.8 are compared by their whole shingle sets.

Scale: equal texts are one node. Large groups of near copies are found first, by comparing each node with one leader of
its bucket, in rounds that cost the nodes in open buckets; the full search then drops pairs of one group inside the
join, since pairs within a group need no comparison. The wide keys of the full search are sent only if some text has
that key on the other side, as a bitmap of all keys tells (21 MB at most, packed; exact). Groups that were found stay; what
a round adds links whole groups, so that only those are searched for components. Families of texts alike at 0.5 to 0.79 crowd buckets without ever
becoming a group. Of their texts the shingles that no other crowded text has are counted: two of them can share at
most the rest, and a pair for which that is too little is dropped inside the join, without loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.common import own, small_batches, stored
from sparkcurate.llm.simhash import GOLAY_POLYNOMIAL, components, least_rows
from sparkcurate.session import broadcast_below

#: Words per shingle, similarity of near copies.
SHINGLE, LEAST = 5, 0.8
#: Words of 64 bits in a fingerprint, and segments of 23 bits.
LANES, SEGMENTS = 8, 20
#: Words that are compared inside the join, and bits in which near copies may differ in them and in the whole
#: fingerprint: at a similarity of 0.8 one pair in 1,000 differs in more of either.
COMPARED, RADIUS, WHOLE_RADIUS = 4, 41, 73
#: Texts on either side of the pairs that are compared in one place, and nodes from which on a bucket is crowded.
SIDE, CROWD = 128, 4
#: Bytes of a bitmap of all keys, and of one page of it as Spark makes them.
BITMAP, PAGE = SEGMENTS // 2 << 21, 4096
#: Roots and links below so many bytes are broadcast.
SMALL = 8 << 20
#: Pairs of segments whose keys the rounds with leaders use; see ``near_copies``.
LEADER_ROUNDS = ((0,), (1, 2), tuple(range(3, SEGMENTS // 2)))

BINS = 64 * LANES
_DRAWN = np.random.Generator(np.random.PCG64(42))
#: For each bin the order in which it asks others if it is empty, and what makes its bit its own.
PROBES = np.argsort(_DRAWN.random((BINS, BINS)), axis=1)
MARKS = _DRAWN.integers(0, 1 << 64, BINS, dtype=np.uint64)


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word; by syndrome what to flip to reach each codeword
    within four bits, the nearest first, and how many there are."""
    single = []
    for i in range(23):
        word = 1 << i
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - 11)
        single.append(word)
    near: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            flip = syndrome = 0
            for i in bits:
                flip, syndrome = flip | 1 << i, syndrome ^ single[i]
            if weight < 4 or near[syndrome][0].bit_count() == 3:
                near[syndrome].append(flip)
    halves = [np.zeros(1 << width, dtype=np.int64) for width in (12, 11)]
    for half, start in zip(halves, (0, 12), strict=True):
        for i in range(half.size.bit_length() - 1):
            half ^= np.where(np.arange(half.size) >> i & 1, single[start + i], 0)
    flips = np.array([some + some[:1] * (6 - len(some)) for some in near], dtype=np.int64)
    return *halves, flips, np.array([len(some) for some in near])


LOW, HIGH, FLIPS, CODEWORDS = _golay()


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's shingles in ascending order; a shorter text is one, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(SHINGLE, len(words))
    grams = zip(*[words[i:] for i in range(size)], strict=False)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams)), dtype=np.uint64))


def fingerprints(found: np.ndarray) -> list[int]:
    """``LANES`` signed 64-bit words of a set of shingles in ascending order; zeros for none.

    The leading bits of a hash name its bin. An empty bin borrows from the first one of its order that is
    not. A bit mixes the bin's least hash with the bin's mark, so that borrowed hashes give bits of their own.
    """
    if not len(found):
        return [0] * LANES
    least = np.searchsorted(found, np.arange(BINS, dtype=np.uint64) << np.uint64(65 - BINS.bit_length()))
    empty = least == np.append(least[1:], len(found))
    place, start = np.arange(BINS), 0
    open_ = np.flatnonzero(empty)
    while len(open_):
        asked = PROBES[open_, start : start + 16]
        full = ~empty[asked]
        some = full.any(axis=1)
        place[open_[some]] = asked[some, full[some].argmax(axis=1)]
        open_, start = open_[~some], start + 16
    with np.errstate(over="ignore"):
        mixed = (found[least[place]] ^ MARKS) * np.uint64(0xBF58476D1CE4E5B9)
    return np.packbits((mixed >> np.uint64(63)).astype(bool), bitorder="little").view("<i8").tolist()


def golay_keys(prints: np.ndarray, wide: bool, pairs: tuple[int, ...]) -> list[np.ndarray]:
    """Keys of fingerprints (a row of ``LANES`` each): of each pair of segments, the indices of the nearest codewords, or
    of all choices of codewords within four bits if ``wide``."""
    bits = np.unpackbits(prints.astype("<i8").view(np.uint8), axis=1, bitorder="little")
    words = bits[:, : 23 * SEGMENTS].reshape(-1, SEGMENTS, 23) @ (1 << np.arange(23))
    syndromes = LOW[words & 4095] ^ HIGH[words >> 12]
    indexes = (words[:, :, None] ^ FLIPS[syndromes][:, :, : 6 if wide else 1]) >> 11
    used = np.arange(indexes.shape[2]) < CODEWORDS[syndromes][:, :, None]
    keys, valid = [], []
    for t in pairs:
        one, two = 2 * t, 2 * t + 1
        keys.append((t << 24 | indexes[:, one, :, None] << 12 | indexes[:, two, None, :]).reshape(len(words), -1))
        valid.append((used[:, one, :, None] & used[:, two, None, :]).reshape(len(words), -1))
    keys, valid = np.concatenate(keys, axis=1), np.concatenate(valid, axis=1)
    return np.split(keys[valid], np.cumsum(valid.sum(axis=1))[:-1])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def with_prints(docs: DataFrame, text: Column, row: str, node: str, size: str, prints: str) -> DataFrame:
    """``docs``, stored, with number of the row, hash of the text, number of its shingles, and its fingerprints."""
    @F.pandas_udf("size int, prints array<bigint>")
    def described(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame({"size": [len(s) for s in sets], "prints": [fingerprints(s) for s in sets]})

    made = small_batches(docs).withColumn(prints, described(text))
    return stored(made.withColumn(size, F.col(prints)["size"]).withColumn(prints, F.col(prints)["prints"]).withColumn(
        node, F.xxhash64(F.coalesce(text, F.lit("")))).withColumn(row, F.monotonically_increasing_id()))


def used_keys(keys: DataFrame) -> dict[int, bytes]:
    """Bitmap of the values in ``key`` by page, packed in the tasks; its size depends on the number of possible keys alone."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(bits=[zlib.compress(bits, 1) for bits in batch["bits"]])

    made = small_batches(keys).groupBy(F.shiftright("key", 15).cast("int").alias("page")).agg(
        F.bitmap_construct_agg(F.col("key").bitwiseAND(F.lit(8 * PAGE - 1))).alias("bits"))
    return {r.page: bytes(r.bits) for r in made.mapInPandas(packed, "page int, bits binary").collect()}


def whole_bitmap(used: dict[int, bytes]) -> np.ndarray:
    """The pages of ``used_keys`` as one array of bytes."""
    bitmap = np.zeros((BITMAP // PAGE, PAGE), dtype=np.uint8)
    for page, bits in used.items():
        bitmap[page] = np.frombuffer(zlib.decompress(bits), dtype=np.uint8)
    return bitmap.reshape(-1)


def entries(nodes: DataFrame, wide: bool, pairs: tuple[int, ...], used: dict[int, bytes] | None = None) -> DataFrame:
    """(key, node, size, shared, root, l0, l1, ...): a row for each key of each node; ``shared`` is -1 where not known.

    Only keys of the bitmap ``used`` (see ``used_keys``) if there is one.
    """
    sent = None if used is None else nodes.sparkSession.sparkContext.broadcast(used)

    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bitmap = None if sent is None else whole_bitmap(sent.value)
        for prints in batches:
            found = golay_keys(np.stack(prints.to_list()), wide, pairs) if len(prints) else []
            if bitmap is not None:
                found = [some[bitmap.take(some >> 3) >> (some & 7) & 1 > 0] for some in found]
            yield pd.Series(found, dtype=object)

    shared = F.col("shared") if "shared" in nodes.columns else F.lit(-1)
    return nodes.select("node", "size", shared.alias("shared"), "root",
                        *[F.get("prints", F.lit(LANES - 1 - i)).alias(f"l{i}") for i in range(COMPARED)], F.explode(keys("prints")).alias("key"))


def differing(*words: tuple[Column, Column]) -> Column:
    """Number of bits in which pairs of words differ."""
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in words[1:]), F.bit_count(words[0][0].bitwiseXOR(words[0][1])))


def shared_shingles(crowded: DataFrame) -> DataFrame:
    """(node, shared): how many shingles of each text (node, text) occur in another of them too."""
    @F.pandas_udf("array<bigint>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)

    found = stored(small_batches(crowded).select("node", F.explode(hashes("text")).alias("h")))
    common = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    counted = found.join(common, "h").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("shared"))
    return crowded.select("node").join(counted, "node", "left").select("node", F.coalesce("shared", F.lit(0)).alias("shared"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The different pairs (a, b) whose texts (node, text) are similar enough.

    Pairs of one family lie in cells of about ``SIDE`` texts on either side, so that a text is sent once a cell and not once a
    pair. A family are the texts whose least partner is the same.
    """
    family = pairs.groupBy("b").agg(F.min("a").alias("family"))
    dealt = stored(pairs.join(family, "b"))
    ones = dealt.select("family", "a").distinct().groupBy("family").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("ones"))
    twos = dealt.select("family", "b").distinct().groupBy("family").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("twos"))
    large = broadcast_below(stored(ones.join(twos, "family").where("ones > 1 OR twos > 1")))
    part = [F.pmod(F.xxhash64(side), F.coalesce(parts, F.lit(1))) for side, parts in (("a", "ones"), ("b", "twos"))]
    cells = stored(dealt.join(large, "family", "left").select("a", "b", F.xxhash64("family", *part).alias("cell")))
    wanted = cells.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    met = wanted.join(texts.select("node", "text"), "node").groupBy("cell").agg(F.collect_list(F.struct("node", "text")).alias("said"))
    asked = cells.groupBy("cell").agg(F.collect_list(F.struct("a", "b")).alias("asked"))
    rows = asked.join(met, "cell").select(F.col("asked.a").alias("a"), F.col("asked.b").alias("b"), "said.node", "said.text")

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ones, twos, nodes, said in batch.itertuples(index=False):
                held = {n: shingles(t) for n, t in zip(nodes.tolist(), said, strict=True)}
                out += [(a, b) for a, b in zip(ones.tolist(), twos.tolist(), strict=True) if similarity(held[a], held[b]) >= LEAST]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return stored(small_batches(rows).mapInPandas(similar, "a long, b long"))


def near_copies(rows: DataFrame) -> DataFrame:
    """Groups of ``rows`` (row, node, text, size, prints): node and root, for nodes with any near copy."""
    first = rows.groupBy("node").agg(F.min("row").alias("row"))
    nodes = stored(rows.join(first.select("row"), "row", "left_semi").select("row", "node", "size", "prints"))
    texts = rows.select("row", "node", "text")
    grouped = nodes.withColumn("root", F.col("node"))

    def close(a: str, b: str) -> Column:
        return F.least(f"{a}.size", f"{b}.size") >= LEAST * F.greatest(f"{a}.size", f"{b}.size")

    def alike(a: str, b: str) -> Column:
        near = differing(*[(F.col(f"{a}.l{i}"), F.col(f"{b}.l{i}")) for i in range(COMPARED)]) <= RADIUS
        # Shared shingles of a pair: at least this many at a similarity of LEAST, at most what both share with others.
        needed = F.floor(LEAST / (1 + LEAST) * (F.col(f"{a}.size") + F.col(f"{b}.size")))
        least, unknown = F.least(f"{a}.shared", f"{b}.shared"), F.lit(-1)
        return (F.col(f"{a}.root") != F.col(f"{b}.root")) & near & close(a, b) & ((least == unknown) | (least >= needed))

    def texts_of(some: DataFrame) -> DataFrame:
        """(row, node, text) of some nodes; only their row numbers meet all texts."""
        wanted = nodes.select("row", "node").join(some, "node", "left_semi").select("row")
        return texts.join(broadcast_below(stored(wanted)), "row", "left_semi")

    def linked(pairs: DataFrame) -> DataFrame:
        """``grouped`` with the roots it has now that ``pairs`` (a, b) were compared too."""
        one, two = (nodes.select(F.col("node").alias(n), F.col("prints").alias(f"p{n}")) for n in "ab")
        words = [(F.get("pa", F.lit(i)), F.get("pb", F.lit(i))) for i in range(LANES)]
        pairs = stored(pairs.distinct().join(one, "a").join(two, "b").where(
            differing(*words) <= WHOLE_RADIUS).select("a", "b"))
        chosen = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        found = verified(pairs, texts_of(chosen))
        for end in "ab":
            found = stored(grouped.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}")).join(
                broadcast_below(found, SMALL), end).drop(end))
        moved = components(found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
        moved = broadcast_below(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), SMALL)
        return stored(grouped.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to"))

    lanes = [f"l{i}" for i in range(COMPARED)]
    for number, pairs in enumerate(LEADER_ROUNDS):
        # Other texts lead in each round: one that is unlike the rest must not decide alone.
        mine = stored(entries(grouped, False, pairs))
        order = F.xxhash64("node", F.lit(number))
        heads = mine.groupBy("key").agg(F.min(F.struct(order, "node", "size", "shared", "root", *lanes)).alias("h"),
                                        F.min("root").alias("low"), F.max("root").alias("high"))
        heads = heads.where("low < high").select("key", "h.*")
        grouped = linked(mine.alias("m").join(heads.alias("h"), "key").where(alike("m", "h")).select(
            F.col("h.node").alias("a"), F.col("m.node").alias("b")))
    every = tuple(range(SEGMENTS // 2))
    mine = stored(entries(grouped, False, every).select("key", "node", "root"))
    full = mine.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    members = mine.join(full.where(F.expr(f"n >= {CROWD} AND low < high")).select("key"), "key", "left_semi").select("node").distinct()
    known = shared_shingles(stored(texts_of(members).select("node", "text")))
    grouped = stored(grouped.join(known, "node", "left").withColumn("shared", F.coalesce("shared", F.lit(-1))))
    wide = entries(grouped, True, every, used_keys(mine.select("key")))
    met = entries(grouped, False, every).alias("n").join(wide.alias("w"), "key").where(alike("n", "w"))
    pairs = met.select(F.least("n.node", "w.node").alias("a"), F.greatest("n.node", "w.node").alias("b"))
    return linked(pairs).where("root <> node").select("node", "root")


def one_per_group(docs: DataFrame) -> DataFrame:
    """Documents without their near copies: of each group the row with the least id, null ids last.

    Columns as given. Texts without words are copies of each other. Of rows with that id the one with
    the smallest text hash stays, and of repeated ones the first.
    """
    row, node, size, prints = (own(name) for name in ("row", "node", "size", "prints"))
    marked = with_prints(docs, F.col("text"), row, node, size, prints)
    roots = near_copies(marked.select(F.col(row).alias("row"), F.col(node).alias("node"), "text",
                                      F.col(size).alias("size"), F.col(prints).alias("prints")))
    return least_rows(marked, roots, row, node).select(*docs.columns)
