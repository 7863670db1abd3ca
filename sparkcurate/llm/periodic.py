"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of consecutive words with smallest period q, of at least max(6, 4q) words, that no
neighbour extends. Each of its words therefore occurs four times or more within it. A word that occurs
less often in a segment can be in no run of that segment, so it splits the segment; the pieces are counted
anew until no piece has such a word. Ordinary prose falls apart after one or two counts.

Surviving segments are scanned lag by lag. A run of lag p holds three aligned blocks of p words that are
equal, so a lag costs one comparison of block sums a block, and all lags together cost n log n. Block sums
only propose; every run is confirmed and extended word by word. A stretch found at a lag whose
divisor already explains it is the same run and is skipped.

Scale: a row-local projection without a shuffle; the largest unit of work is one text, at n log n of
its words. Splitting counts the smaller pieces only, so no text makes it quadratic.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import WORD, documents, small_batches

#: Fewest words of a run, fewest periods of a run.
LEAST_WORDS, LEAST_PERIODS = 6, 4

#: Block sums are taken modulo this prime, with this base: products stay below 2**63.
PRIME, BASE = (1 << 31) - 1, 1_190_494_759


def _pieces(start: int, end: int, cuts: np.ndarray) -> list[tuple[int, int]]:
    """The stretches between ``cuts`` in [start, end) that are long enough for a run."""
    lows, highs = np.append(start, cuts + 1), np.append(cuts, end)
    long = highs - lows >= LEAST_WORDS
    return list(zip(lows[long].tolist(), highs[long].tolist(), strict=True))


def surviving_segments(codes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [start, end) of ``codes`` in which every code occurs ``LEAST_PERIODS`` times or more."""
    found: list[tuple[int, int]] = []
    cuts = np.flatnonzero(np.bincount(codes, minlength=1)[codes] < LEAST_PERIODS)
    work = [(a, b, Counter(codes[a:b].tolist()), None) for a, b in _pieces(0, len(codes), cuts)]
    if not work:
        return found
    order = np.argsort(codes, kind="stable")
    firsts = np.searchsorted(codes[order], np.arange(int(codes.max()) + 2))
    while work:
        start, end, known, suspects = work.pop()
        rare = [c for c in (known if suspects is None else suspects) if 0 < known[c] < LEAST_PERIODS]
        if not rare:
            found.append((start, end))
            continue
        cuts = []
        for code in rare:
            places = order[firsts[code] : firsts[code + 1]]
            cuts.append(places[np.searchsorted(places, start) : np.searchsorted(places, end)])
        for low, high in _pieces(start, end, np.sort(np.concatenate(cuts))):
            if 2 * (high - low) <= end - start:
                work.append((low, high, Counter(codes[low:high].tolist()), None))
            else:  # the one large piece keeps the counts, less those of what was cut off
                gone = Counter(codes[start:low].tolist())
                gone.update(codes[high:end].tolist())
                for code, n in gone.items():
                    known[code] -= n
                work.append((low, high, known, list(gone)))
    return sorted(found)


def _extent(x: np.ndarray, low: int, high: int, lag: int) -> tuple[int, int] | None:
    """The maximal stretch of period ``lag`` around [low, high); None if that stretch has not the period."""
    if not np.array_equal(x[low : high - lag], x[low + lag : high]):
        return None
    back = max(0, low - lag)
    differ = np.flatnonzero(x[back:low] != x[back + lag : low + lag])
    first = back + int(differ[-1]) + 1 if len(differ) else back
    ahead = min(len(x), high + lag)
    differ = np.flatnonzero(x[high:ahead] != x[high - lag : ahead - lag])
    return first, high + int(differ[0]) if len(differ) else ahead


def _equal_stretches(x: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """All maximal stretches of period ``lag``, by comparing every word."""
    same = np.concatenate(([False], x[:-lag] == x[lag:], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(a, b + lag) for a, b in edges.reshape(-1, 2).tolist()]


def lag_scan(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, smallest period) of ``x``, by start and period."""
    n, runs = len(x), []
    drawn = np.random.Generator(np.random.PCG64(7)).integers(1, PRIME, int(x.max()) + 1 if n else 1)
    power = np.ones(n + 1, dtype=np.int64)
    filled = 1
    while filled <= n:  # powers of the base, doubling the known part
        part = min(filled, n + 1 - filled)
        power[filled : filled + part] = power[:part] * (int(power[filled - 1]) * BASE % PRIME) % PRIME
        filled += part
    sums = np.concatenate(([0], np.cumsum(drawn[x] * power[:n] % PRIME)))
    explained: dict[int, tuple[list[int], list[int]]] = {}  # lag: starts and ends of runs whose period divides it
    for lag in range(1, n // LEAST_PERIODS + 1):
        least = max(LEAST_WORDS, LEAST_PERIODS * lag)
        if least > n:
            break
        blocks = np.diff(sums[::lag]) % PRIME
        same = blocks[:-1] * power[lag] % PRIME == blocks[1:]
        if not (same[:-1] & same[1:]).any():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8))).reshape(-1, 2)
        starts, ends = explained.pop(lag, ([], []))
        stretches = []
        for a, b in edges[edges[:, 1] - edges[:, 0] >= 2].tolist():
            low, high = a * lag, (b + 1) * lag
            at = bisect_right(starts, low) - 1
            if at >= 0 and ends[at] >= high:
                continue
            stretch = _extent(x, low, high, lag)
            if stretch is None:  # unlike words of equal sums: this lag is compared in full
                stretches = _equal_stretches(x, lag)
                break
            stretches.append(stretch)
        whole = set(zip(starts, ends, strict=True))
        for low, high in stretches:
            if high - low < least or (low, high) in whole:
                continue
            runs.append((low, high - low, lag))
            for multiple in range(2 * lag, (high - low) // 3 + 1, lag):
                held = explained.setdefault(multiple, ([], []))
                at = bisect_right(held[0], low)
                held[0].insert(at, low)
                held[1].insert(at, high)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of codes 0, 1, ..., by start and period."""
    out = []
    for start, end in surviving_segments(codes):
        inside = pd.factorize(codes[start:end])[0]
        out += [(start + a, length, period) for a, length, period in lag_scan(inside)]
    return out


def described(text: str | None) -> tuple[list[tuple[int, int, int]], str]:
    """The runs of a text's words, and the text without the repetitions: its kept words, space-joined."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return [], ""
    runs = runs_of(pd.factorize(np.array(words, dtype=object))[0])
    kept = words
    if runs:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        kept = [words[i] for i in np.flatnonzero(keep).tolist()]
    return runs, b" ".join(kept).decode("utf-8", "surrogatepass")


def with_runs(docs: DataFrame, text: Column, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of ``text`` (array of start, length, period) and the text without repetitions.

    One row per input row, in any order; repeated rows and null ids stay. A null, empty or blank text has no
    run and collapses to an empty one. Of overlapping runs each drops its own words. Extra columns pass
    through; ``runs`` and ``collapsed`` replace columns of that name.
    """
    @F.pandas_udf("runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    def found(texts: pd.Series) -> pd.DataFrame:
        made = [described(t) for t in texts]
        return pd.DataFrame({"runs": [m[0] for m in made], "collapsed": [m[1] for m in made]}, index=texts.index)

    made = small_batches(docs).withColumn("__found", found(text))
    return made.withColumns({runs: F.col("__found.runs"), collapsed: F.col("__found.collapsed")}).drop("__found")


def _by_exponent(a: Column, b: Column) -> Column:
    """Order of runs: greatest length / period by exact products, then smallest start, then period."""
    left, right = a["length"] * b["period"], b["length"] * a["period"]
    return (F.when(left != right, F.when(left > right, -1).otherwise(1))
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))


def with_repeated_tail(text: Column, doc_id: Column) -> Column:
    """The query's test material: in a tenth of the documents the words from a drawn one on repeat."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def rebuilt(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        tail = F.slice(w, a.cast("int") + 1, p.cast("int"))
        times = F.ceil((n - a) / p).cast("int")
        repeated = F.slice(F.flatten(F.array_repeat(tail, times)), F.lit(1), (n - a).cast("int"))
        return F.when(n == 0, F.lit("")).otherwise(F.concat_ws(
            " ", F.slice(w, F.lit(1), a.cast("int")), repeated))

    return F.when(h % 10 == 0, F.transform(F.array(words), rebuilt)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document: their number, the one of greatest exponent, and digests of all and of the rest."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    made = with_runs(docs, with_repeated_tail(F.coalesce("text", F.lit("")), F.col("doc_id"))).withColumn(
        "best", F.get(F.array_sort("runs", _by_exponent), F.lit(0)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
