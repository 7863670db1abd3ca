"""Sharding by bytes: the smallest capacity with which contiguous groups fit into the shards.

Groups of equal texts are atomic and ordered by the hash of their text. The capacity is found by binary
search with a greedy check, and the order is cut where the greedy walk cuts.

The walk needs the sizes in order, but never all of them: they are first summed over 4,096 equal ranges
of the hash. A range that holds several groups is taken once as one block and once as fluid, which
bounds the capacity and each cut from both sides; only ranges where a cut can lie are split into 256,
again and again, until they hold single groups. What reaches the driver is bounded by the number of
shards, not of groups, and the result is the same as that of a walk over every group.

Slots are dense numbers in a shard: rows are counted per (shard, salt) and numbered within it, so
neither a shard nor a hot text is sorted in one task. The texts themselves are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurate.llm.common import documents, stored

#: Leading bits of the hash in the first histogram, further bits in each refinement, slots' salts.
FIRST_BITS, STEP_BITS, SALTS = 12, 8, 1024


@dataclass(frozen=True)
class Atom:
    """A range of the hash: all keys whose bits above ``shift`` are ``prefix``."""

    shift: int
    prefix: int
    size: int
    largest: int
    groups: int

    @property
    def first_key(self) -> int:
        return self.prefix << self.shift


def walk(edges: np.ndarray, solid: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Where greedy shards of ``capacity`` end. Atom i fills edges[i]:edges[i + 1] and is split only
    if not ``solid``; the walk ends early if an atom doesn't fit or the shards are used up."""
    ends, at, total = [], 0, int(edges[-1])
    while at < total and len(ends) < shards:
        reach = min(at + capacity, total)
        i = int(np.searchsorted(edges, reach, "right")) - 1
        if i < len(solid) and solid[i]:
            reach = int(edges[i])
        if reach <= at:
            break
        ends.append(reach)
        at = reach
    return ends


def least_capacity(edges: np.ndarray, solid: np.ndarray, shards: int, floor: int) -> int:
    """The smallest capacity, at least ``floor``, with which the walk reaches the end."""
    total = int(edges[-1])
    low, high = max(floor, -(-total // shards)), max(floor, total)
    while low < high:
        middle = (low + high) // 2
        ends = walk(edges, solid, middle, shards)
        if ends and ends[-1] == total:
            high = middle
        else:
            low = middle + 1
    return low


def open_atoms(atoms: list[Atom], shards: int) -> tuple[list[int], list[int]]:
    """Atoms in which a cut may lie and that hold several groups; else none, and the final ends."""
    edges = np.concatenate([[0], np.cumsum([a.size for a in atoms])])
    single = np.array([a.groups == 1 for a in atoms])
    whole = np.ones(len(atoms), dtype=bool)
    low = least_capacity(edges, single, shards, max(a.largest for a in atoms))
    high = least_capacity(edges, whole, shards, low)
    earliest, latest = walk(edges, whole, low, shards), walk(edges, single, high, shards)
    chosen: set[int] = set()
    for k in range(shards):
        start = earliest[k] if k < len(earliest) else (earliest[-1] if earliest else 0)
        stop = latest[k] if k < len(latest) else int(edges[-1])
        first = int(np.searchsorted(edges, start, "right")) - 1
        last = int(np.searchsorted(edges, stop, "left"))
        chosen.update(i for i in range(max(first, 0), min(last, len(atoms))) if not single[i])
    return sorted(chosen), walk(edges, whole, high, shards)


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First keys of shards 1, 2, ... for ``groups`` (key: distinct long, size: long above zero)."""
    def histogram(df: DataFrame, shift: int) -> list[Atom]:
        found = df.groupBy(F.shiftright("key", shift).alias("p")).agg(
            F.sum("size").alias("s"), F.max("size").alias("m"), F.count(F.lit(1)).alias("n"))
        return [Atom(shift, r.p, r.s, r.m, r.n) for r in found.collect()]

    atoms = sorted(histogram(groups, 64 - FIRST_BITS), key=lambda a: a.first_key)
    while atoms:
        chosen, ends = open_atoms(atoms, shards)
        if not chosen:
            edges = np.cumsum([a.size for a in atoms])
            starts = [int(np.searchsorted(edges, end, "right")) for end in ends[:-1]]
            return [atoms[i].first_key for i in starts]
        by_shift: dict[int, list[Atom]] = {}
        for i in chosen:
            by_shift.setdefault(atoms[i].shift, []).append(atoms[i])
        gone = set(chosen)
        atoms = [a for i, a in enumerate(atoms) if i not in gone]
        for shift, coarse in by_shift.items():
            inside = F.shiftright("key", shift).isin([a.prefix for a in coarse])
            atoms += histogram(groups.where(inside), max(0, shift - STEP_BITS))
        atoms.sort(key=lambda a: a.first_key)
    return []


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Assign every row to one of ``shards`` contiguous shards of nearly equal bytes.

    Returns the id, size (UTF-8 bytes plus 1), text_crc32, law (``bytes``), shard, slot (dense from 0
    within the shard), grown_shard (null: only a key law defines it). One row per input row. A null
    text counts as an empty one; equal texts, and so all null and empty ones, share a shard. Shards may
    stay empty if there are fewer groups. Repeated rows get slots of their own. Extra columns are
    ignored, an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.xxhash64(text).alias("key"),
    ))
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("size")))
    cuts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("key") >= cut).cast("int")
    placed = rows.withColumns({
        "shard": shard, "salt": F.pmod(F.xxhash64("id", "crc"), F.lit(SALTS)).cast("int")})
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "salt").orderBy("id", "crc", "key")
    # One row per shard and salt at most: shards * SALTS rows bound what is broadcast.
    numbered = placed.withColumn("rank", F.row_number().over(inside)).join(
        F.broadcast(offsets), ["shard", "salt"])
    return numbered.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return shard_by_bytes(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
