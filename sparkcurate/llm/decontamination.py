"""Benchmark decontamination: BM25 search of every training passage, block-max WAND, overlap check.

The benchmark is the indexed side: its items are cut into chunks of at most ``chunk`` words, and an
inverted index maps each term to blocks of postings with the largest impact of each block. Every passage
of every document (windows of ``4 * chunk`` words, half overlapping, so each possible occurrence of a
chunk lies whole in one) is a query that retrieves all chunks scoring above ``share`` of what the chunk
scores on itself. Retrieved chunks are verified: at least ``overlap`` of the five-word shingles of its
question part and of its answer part stand in the passage.

Documents are read once per block of the benchmark and never shuffled; matches leave the task as rows.
A block holds at most ``block_chars`` characters, which bounds the broadcast index; a larger benchmark
is searched block by block, with document frequencies of the whole benchmark in each, so that results
do not depend on the blocks.

Before passages are searched, upper bounds are taken from rare terms alone: common terms together cannot
lift a chunk over its threshold, so what is missing must come from rare ones, in the document first and
then in the passage. Most clean documents end there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import documents, own, small_batches, stored

#: BM25 constants, postings per block, and words per shingle.
K1, B, BLOCK, SHINGLE = 1.2, 0.75, 16, 5

#: ASCII letters to lower case, ASCII letters and digits kept, other ASCII to a blank; the rest is kept.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: runs of letters and digits (and of anything beyond ASCII)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Index:
    """Chunks of benchmark items, postings in blocks, thresholds, and what verification needs."""

    def __init__(self, chunks: list[tuple], frequency: dict[bytes, int], total: int, average: float,
                 chunk: int, share: float, overlap: float):
        self.ids = [item for item, _, _ in chunks]
        self.words = [words for _, words, _ in chunks]
        self.answers = [answer for _, _, answer in chunks]
        self.window, self.overlap = 4 * chunk, overlap
        self.terms: dict[bytes, int] = {}
        found: list[list[tuple[int, float]]] = []
        own_score = np.zeros(len(chunks))
        for number, words in enumerate(self.words):
            norm = K1 * (1 - B + B * len(words) / average)
            for term, n in Counter(words).items():
                df = frequency[term]
                idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
                impact = float(idf * n * (K1 + 1) / (n + norm))
                t = self.terms.setdefault(term, len(self.terms))
                if t == len(found):
                    found.append([])
                found[t].append((number, impact))
                own_score[number] += impact
        self.thresholds = share * own_score
        self.postings = found
        self.blocks = [
            [(p[i : i + BLOCK][-1][0], max(x for _, x in p[i : i + BLOCK])) for i in range(0, len(p), BLOCK)]
            for p in found]
        self.best = np.array([max(x for _, x in p) for p in found]) if found else np.zeros(0)
        self.floor = float(self.thresholds.min()) if len(chunks) else 0.0
        # Rare terms: without them no chunk reaches its threshold. Common ones are added while that holds.
        left = self.thresholds.copy()
        self.rare = np.ones(len(found), dtype=bool)
        for t in sorted(range(len(found)), key=lambda t: (-len(found[t]), t)):
            if len(found[t]) <= 2:
                break
            after = left.copy()
            for number, impact in found[t]:
                after[number] -= impact
            if (after < 0.5 * self.thresholds).any():
                continue
            left, self.rare[t] = after, False
        self.left = left
        self.rare_floor = float(left.min()) if len(chunks) else 0.0
        self.common: list[dict[int, float]] = [{} for _ in chunks]
        for t in np.flatnonzero(~self.rare).tolist():
            for number, impact in found[t]:
                self.common[number][t] = impact
        self.rare_terms = frozenset(w for w, t in self.terms.items() if self.rare[t])

    def search(self, query: set[int]) -> list[tuple[int, float]]:
        """All chunks that reach their threshold for a set of terms, by block-max WAND.

        Cursors walk the postings of the rare terms in chunk order. The pivot is the first chunk at
        which the largest impacts of the lists so far add up to the lowest bound; if the impacts of the
        blocks it lies in cannot reach the bound, everything up to the nearest block end is skipped at
        once. A chunk whose rare terms reach its bound is scored in full.
        """
        floor, end, hits = self.rare_floor - 1e-9, len(self.ids), []
        cursors = [[self.postings[t][0][0], t, 0] for t in query if self.rare[t]]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursors):
                bound += self.best[t]
                if bound >= floor:
                    pivot = i
                    break
            if pivot < 0:
                break
            chunk = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == chunk:
                pivot += 1
            limit, stop = 0.0, end
            for _, t, at in cursors[: pivot + 1]:
                b = at // BLOCK
                while b < len(self.blocks[t]) and self.blocks[t][b][0] < chunk:
                    b += 1
                if b < len(self.blocks[t]):
                    limit += self.blocks[t][b][1]
                    stop = min(stop, self.blocks[t][b][0] + 1)
            if limit >= floor:
                target = chunk + 1
                if limit >= self.left[chunk] - 1e-9:
                    score = self._score(cursors[: pivot + 1], chunk, query)
                    if score >= self.thresholds[chunk]:
                        hits.append((chunk, score))
            else:
                following = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
                target = max(chunk + 1, min(stop, following))
            for cursor in cursors[: pivot + 1]:
                self._advance(cursor, target)
            cursors = [c for c in cursors if c[0] < end]
        return hits

    def _score(self, cursors: list[list], chunk: int, query: set[int]) -> float:
        """The score of a chunk; 0 if its rare terms alone rule it out."""
        score = 0.0
        for cursor in cursors:
            self._advance(cursor, chunk)
            if cursor[0] == chunk:
                score += self.postings[cursor[1]][cursor[2]][1]
        if score < self.left[chunk] - 1e-9:
            return 0.0
        return score + sum(x for t, x in self.common[chunk].items() if t in query)

    def _advance(self, cursor: list, target: int) -> None:
        """Move a cursor to the first posting at or after ``target``, by whole blocks first."""
        _, t, at = cursor
        postings, blocks = self.postings[t], self.blocks[t]
        while at < len(postings) and postings[at][0] < target:
            at = (at // BLOCK + 1) * BLOCK if blocks[at // BLOCK][0] < target else at + 1
        cursor[2] = at
        cursor[0] = postings[at][0] if at < len(postings) else len(self.ids)

    def shared(self, chunk: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of the shingles of a chunk's question and answer part that stand in the passage."""
        words, answer = self.words[chunk], self.answers[chunk]
        size = min(SHINGLE, len(words))
        grams = {b" ".join(passage[i : i + size]) for i in range(len(passage) - size + 1)}
        hits = [b" ".join(words[i : i + size]) in grams for i in range(len(words) - size + 1)]
        # The answer part takes every shingle that touches it.
        cut = min(max(0, answer - size + 1), len(hits) - 1)
        asked, answered = hits[:cut], hits[cut:]
        return (sum(asked) / len(asked) if asked else 1.0), sum(answered) / len(answered)

    def possible(self, words: list[bytes]) -> bool:
        """Whether rare terms of a whole document could lift any chunk over its threshold."""
        sums: dict[int, float] = {}
        for term in self.rare_terms.intersection(words):
            for chunk, impact in self.postings[self.terms[term]]:
                sums[chunk] = sums.get(chunk, 0.0) + impact
        return any(total >= self.left[chunk] - 1e-9 for chunk, total in sums.items())

    def matches(self, text: str | None) -> dict[int, tuple]:
        """Verified items of a text: item number to (score, question share, answer share, word)."""
        words = terms_of(text)
        if not self.possible(words):
            return {}
        found: dict[int, tuple] = {}
        step = self.window // 2
        for start in range(0, max(1, len(words) - step), step):
            passage = words[start : start + self.window]
            if not self.possible(passage):
                continue
            query = {self.terms[w] for w in self.terms.keys() & set(passage)}
            for chunk, score in self.search(query):
                asked, answered = self.shared(chunk, passage)
                if asked >= self.overlap and answered >= self.overlap:
                    best = found.get(chunk)
                    if best is None or score > best[0]:
                        found[chunk] = (score, asked, answered, start)
        return found


def split_item(item: int, text: str | None, chunk: int) -> list[tuple]:
    """Chunks of an item: (item, words, first word of the answer part).

    The answer is what follows the last question mark or the last line break; without either, the last
    quarter. An item longer than ``chunk`` words is cut evenly; each part verifies on its own.
    """
    raw = (text or "").strip()
    at = max(raw.rfind("?"), raw.rfind("\n"))
    words = terms_of(raw)
    asked = len(terms_of(raw[: at + 1])) if at >= 0 else 0
    if not 0 < asked < len(words):
        asked = len(words) - max(1, len(words) // 4)
    parts = -(-len(words) // chunk) if words else 0
    cuts = [len(words) * i // parts for i in range(parts + 1)] if parts else []
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        inner = asked - a if a < asked < b else (b - a) - max(1, (b - a) // 4)
        out.append((item, words[a:b], inner))
    return out


def build_indexes(benchmark: DataFrame, chunk: int = 100, share: float = 0.6, overlap: float = 0.8,
                  block_chars: int = 32_000_000) -> list[Index]:
    """Indexes of the benchmark, one per block of at most about ``block_chars`` characters.

    Items with equal ids or texts are indexed once per distinct (id, text). Empty items are left out.
    """
    items = stored(small_batches(benchmark).select("item_id", "text").where("text is not null").distinct())

    def term_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms, sizes = [], []
            for text in batch["text"]:
                for _, words, _ in split_item(0, text, chunk):
                    once = sorted(set(words))
                    terms.extend(once)
                    sizes.extend([len(words)] + [0] * (len(once) - 1))
            yield pd.DataFrame({"term": terms, "size": np.array(sizes, dtype="int64")})

    counted = stored(items.select("text").mapInPandas(term_rows, "term binary, size bigint"))
    totals = counted.agg(F.sum(F.when(F.col("size") > 0, 1)).alias("n"), F.sum("size").alias("words")).first()
    if not totals.n:
        return []
    frequency = stored(counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    indexes = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        # About block_chars characters: the bound of what the driver and the tasks hold.
        rows = part.orderBy("item_id", "text").collect()
        chunks = [c for r in rows for c in split_item(r.item_id, r.text, chunk)]
        if blocks == 1:
            known = frequency
        else:
            known = frequency.join(part.select("text").mapInPandas(term_rows, "term binary, size bigint")
                                   .select("term").distinct(), "term")
        df = {bytes(r.term): r.df for r in known.collect()}
        indexes.append(Index(chunks, df, totals.n, totals.words / totals.n, chunk, share, overlap))
    return indexes


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """Every document and benchmark item it contains: id, item_id, bm25, question_overlap,
    answer_overlap, word (where the best passage starts).

    One row per input row and item with a verified chunk, its best passage; repeated documents repeat.
    Null, empty and clean texts give no row, as do empty tables on either side. Ties go to the first
    passage, then the first chunk. Extra columns are ignored.
    """
    schema = (f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id bigint, bm25 double, "
              "question_overlap double, answer_overlap double, word bigint")
    columns = [part.split()[0] for part in schema.split(", ")]
    results = None
    for index in build_indexes(benchmark, **options):
        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc_id, text in zip(batch[id_col], batch[text_col], strict=True):
                    best: dict[int, tuple] = {}
                    for chunk, match in sorted(index.matches(text).items()):
                        item = index.ids[chunk]
                        if item not in best or match[0] > best[item][0]:
                            best[item] = match
                    missing = pd.isna(doc_id)
                    out.extend((None if missing else doc_id, item, *m) for item, m in best.items())
                frame = pd.DataFrame(out, columns=columns)
                yield frame.astype({id_col: "Int64"}) if len(out) and frame[id_col].isna().any() else frame

        part = docs.select(id_col, text_col).mapInPandas(search, schema)
        results = part if results is None else results.unionByName(part)
    if results is None:
        return docs.sparkSession.createDataFrame([], schema)
    return results


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no benchmark item, columns as given."""
    def leaking(index: Index):
        @F.pandas_udf("boolean")
        def found(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(index.matches(t)) for t in texts], dtype="bool")

        return found(F.col("text"))

    for index in build_indexes(benchmark, **options):
        leaks = own("leaks")
        docs = docs.withColumn(leaks, leaking(index)).where(~F.col(leaks)).drop(leaks)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items found in documents, one row per pair."""
    return find_leaks(documents(spark, sf_dir, "doc_id", "text"),
                      spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
