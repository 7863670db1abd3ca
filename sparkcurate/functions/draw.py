"""Deterministic draws: every number depends on (seed, row key, draw name) and nothing else.

The same row therefore gets the same draw in any partitioning, after a retry, and in any engine
that has md5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, key: Column, name: str = "") -> Column:
    """Hex md5 of ``seed:key`` or ``seed:key:name``."""
    parts = [F.lit(str(seed)), key.cast("string")]
    if name:
        parts.append(F.lit(name))
    return F.md5(F.concat_ws(":", *parts))


def uniform(seed: int, key: Column, name: str = "") -> Column:
    """A double in [0, 1) from the first 32 bits of the digest."""
    head = F.conv(F.substring(digest(seed, key, name), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def pick_index(seed: int, key: Column, name: str, size: Column | int) -> Column:
    """A position in ``0 .. size-1``."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.floor(uniform(seed, key, name) * n).cast("int")


def pick(seed: int, key: Column, name: str, options: Column) -> Column:
    """One element of an array."""
    return F.get(options, pick_index(seed, key, name, F.size(options)))


def weighted(seed: int, key: Column, name: str, choices: Sequence[tuple[str, float]]) -> Column:
    """One of the weighted choices, by cumulative weight."""
    total = sum(weight for _, weight in choices)
    u = uniform(seed, key, name)
    edge, out = 0.0, None
    for value, weight in choices[:-1]:
        edge += weight / total
        test = u < F.lit(edge)
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    last = F.lit(choices[-1][0])
    return last if out is None else out.otherwise(last)


def shuffled(seed: int, key: Column, name: str, options: Column) -> Column:
    """The array in an order fixed by the digests of its positions."""
    tagged = F.transform(
        options,
        lambda x, i: F.struct(
            F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(name),
                              i.cast("string"))).alias("d"),
            x.alias("v"),
        ),
    )
    return F.transform(F.array_sort(tagged), lambda t: t["v"])
