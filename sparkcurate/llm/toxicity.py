"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are tagged clean (0) or toxic (1). Their features are the word and its leading four to eight
letters. Training learns from a bounded sample of labelled documents (``per_class`` of each label, those
with the smallest hash of their id): features that mark toxic documents are counted on Spark, tokens of
toxic documents that carry one are labelled toxic, all tokens of clean documents clean, and the field is
fitted to these tags by gradient ascent. Only tokens with a known feature differ from each other; a run
of k other tokens is the k-th power of one 2 by 2 matrix, so forward and backward sums over a whole
text cost time in its known tokens only and are exact. The document score is a logistic function of the
marginals: expected toxic tokens, the largest marginal, and their share of the text.

Scoring is a projection: one model of bounded size (``max_features``) goes to every task, no text moves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm.common import documents, fold, own, small_batches, stored

#: A token: letters only.
TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the leading letters that are features of their own, if the word is longer.
PREFIXES = (4, 5, 6, 7, 8)
#: Words whose features are remembered in a task before it forgets them all.
CACHE = 100_000


@dataclass
class Model:
    """A fitted field and the scale of its document scores."""

    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: State bias of toxic, transition clean-toxic, toxic-clean, toxic-toxic (clean-clean is 0).
    chain: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, 0.0, 0.0]))
    #: Constant and slopes of the document score.
    scale: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))


def features(word: str) -> list[str]:
    """Feature names of a lower-case word."""
    return ["=" + word, *[word[:k] for k in PREFIXES if len(word) > k]]


def known(words: list[str], names: dict[str, int], cache: dict) -> list[tuple[int, tuple[int, ...]]]:
    """Positions and feature numbers of the words with a known feature."""
    found = []
    for at, word in enumerate(words):
        ids = cache.get(word)
        if ids is None:
            if len(cache) > CACHE:
                cache.clear()
            low = word.lower()
            ids = cache[word] = tuple(names[f] for f in features(low) if f in names)
        if ids:
            found.append((at, ids))
    return found


#: Documents whose chains advance together.
LANES = 1024


class Chain:
    """Sums over all taggings, many documents at a time; runs of unknown tokens are matrix powers."""

    def __init__(self, chain: np.ndarray):
        self.bias, up, down, stay = chain
        self.move = np.exp(np.array([[0.0, up], [down, stay]]))
        step = self.move * np.exp([0.0, self.bias])
        # A positive 2 by 2 matrix: step ** k = large ** k * (first + ratio ** k * second).
        half, det = np.trace(step) / 2, np.linalg.det(step)
        root = np.sqrt(max(half * half - det, 1e-300))
        large, small = half + root, half - root
        self.log_large, self.ratio = float(np.log(large)), small / large
        self.first = (step - small * np.eye(2)) / (large - small)
        self.second = np.eye(2) - self.first

    def marginals(self, positions: list[np.ndarray], scores: list[np.ndarray],
                  lengths: np.ndarray, backward: bool = True) -> tuple[list[np.ndarray], np.ndarray]:
        """Per document P(toxic) at its known positions (``scores``: what features add), and log Z."""
        counts = np.array([len(p) for p in positions], dtype=np.int64)
        order = np.argsort(-counts, kind="stable")
        found: list[np.ndarray] = [np.zeros(0)] * len(positions)
        logs = np.zeros(len(positions))
        for begin in range(0, len(order), LANES):
            lane = order[begin : begin + LANES]
            p, logs[lane] = self._lanes([positions[i] for i in lane], [scores[i] for i in lane],
                                        lengths[lane], counts[lane], backward)
            for k, i in enumerate(lane):
                found[i] = p[: counts[i], k]
        return found, logs

    def _lanes(self, positions, scores, lengths, counts, backward):
        """As :meth:`marginals` for documents in falling order of ``counts``; P as a matrix."""
        steps, n = int(counts[0]) if len(counts) else 0, len(counts)
        gap, odds = np.zeros((steps, n)), np.zeros((steps, n))
        last = np.full(n, -1)
        for k in range(n):
            if counts[k]:
                at = np.asarray(positions[k])
                gap[: counts[k], k] = np.diff(at, prepend=-1) - 1
                odds[: counts[k], k] = scores[k]
                last[k] = at[-1]
        # Clipped so that no weight overflows.
        odds = np.exp(np.clip(odds + self.bias, -60.0, 60.0))
        powers = self.ratio**gap
        state, log = np.tile([1.0, 0.0], (n, 1)), gap.sum(axis=0) * self.log_large
        forward = np.zeros((steps, n, 2))
        active = [int(np.searchsorted(-counts, -j)) for j in range(steps)]
        for j, m in enumerate(active):
            now = state[:m]
            now = (now @ self.first + powers[j, :m, None] * (now @ self.second)) @ self.move
            now[:, 1] *= odds[j, :m]
            top = now.sum(axis=1)
            state[:m] = forward[j, :m] = now / top[:, None]
            log[:m] += np.log(top)
        tail = lengths - last - 1
        back = self.first.sum(axis=1) + (self.ratio**tail)[:, None] * self.second.sum(axis=1)
        log += tail * self.log_large + np.log((state * back).sum(axis=1))
        p = np.zeros((steps, n))
        if backward:
            for j, m in reversed(list(enumerate(active))):
                both = forward[j, :m] * back[:m]
                p[j, :m] = both[:, 1] / both.sum(axis=1)
                now = back[:m].copy()
                now[:, 1] *= odds[j, :m]
                now = now @ self.move.T
                now = now @ self.first.T + powers[j, :m, None] * (now @ self.second.T)
                back[:m] = now / now.max(axis=1)[:, None]
        return p, log


def summary(marginals: np.ndarray, length: int) -> np.ndarray:
    """What the document score depends on."""
    total = float(marginals.sum())
    top = float(marginals.max()) if len(marginals) else 0.0
    return np.array([1.0, np.log1p(total), top, min(1.0, 20 * total / max(length, 1))])


def summaries(found: list[list], lengths: np.ndarray, model: Model) -> tuple[np.ndarray, list]:
    """:func:`summary` of every document, and its marginals."""
    positions = [np.array([at for at, _ in tokens], dtype=np.int64) for tokens in found]
    scores = [np.array([model.weights[list(ids)].sum() for _, ids in tokens]) for tokens in found]
    p, _ = Chain(model.chain).marginals(positions, scores, lengths)
    rows = [summary(q, n) for q, n in zip(p, lengths.tolist(), strict=True)]
    return np.array(rows).reshape(-1, 4), p


def fit_chain(samples: list[tuple[int, list, int]], n_features: int, positive: set[int],
              rounds: int = 40, decay: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights and chain of the field from (label, known tokens, length) by gradient ascent.

    The gradient is that of the log-likelihood: what the tags use less what the field expects. Expected
    uses of the four chain parameters are differences of log Z.
    """
    weights, chain = np.zeros(n_features), np.array([-5.0, 0.0, 0.0, 0.5])
    weights[list(positive)] = 1.0
    positions = [np.array([at for at, _ in found], dtype=np.int64) for _, found, _ in samples]
    lengths = np.array([length for _, _, length in samples])
    counts = np.array([len(p) for p in positions])
    flat = [ids for _, found, _ in samples for _, ids in found]
    # One entry per (token, feature): the token's number and the feature's.
    token = np.repeat(np.arange(len(flat)), [len(ids) for ids in flat])
    feature = np.array([i for ids in flat for i in ids], dtype=np.int64)
    owner = np.repeat(np.arange(len(samples)), counts)
    label = np.array([t for t, _, _ in samples])
    marked = np.zeros(n_features, dtype=bool)
    marked[list(positive)] = True
    tags = np.zeros(len(flat))
    np.maximum.at(tags, token, marked[feature].astype(float))
    tags *= label[owner]
    seen = 1.0 + np.bincount(feature, minlength=n_features)
    at = np.concatenate(positions) if len(flat) else np.zeros(0, dtype=np.int64)
    joined = np.zeros(len(flat), dtype=bool)
    joined[1:] = (owner[1:] == owner[:-1]) & (at[1:] == at[:-1] + 1)
    from_toxic = np.zeros(len(flat), dtype=bool)
    from_toxic[1:] = joined[1:] & (tags[:-1] > 0)
    to_toxic = np.zeros(len(flat), dtype=bool)
    to_toxic[:-1] = joined[1:] & (tags[1:] > 0)
    ends = np.zeros(len(flat), dtype=bool)
    if len(flat):
        ends = at == lengths[owner] - 1
    # How often the tags use the bias and each transition: their part of the gradient.
    used = np.array([tags.sum(), (tags * ~from_toxic).sum(), (tags * ~to_toxic * ~ends).sum(),
                     (tags * from_toxic).sum()])

    def by_document(values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum(counts)[:-1])

    for number in range(rounds):
        rate = 1.0 if number < rounds // 2 else 0.4
        scores = by_document(np.bincount(token, weights[feature], len(flat)))
        p, log = Chain(chain).marginals(positions, scores, lengths)
        wrong = tags - (np.concatenate(p) if len(flat) else np.zeros(0))
        slope = np.bincount(feature, wrong[token], n_features)
        expected = np.zeros(4)
        for i in range(4):
            nudged = chain.copy()
            nudged[i] += 1e-4
            expected[i] = (Chain(nudged).marginals(positions, scores, lengths, False)[1] - log).sum() / 1e-4
        weights = weights + rate * (4 * slope / seen - decay * weights)
        chain = np.clip(chain + rate * np.clip(4 * (used - expected) / len(samples), -0.5, 0.5), -12.0, 4.0)
    return weights, chain


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + decay * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - decay * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, max_features: int = 4000,
          min_docs: int = 4, min_odds: float = 2.5) -> Model:
    """Fit the field on labelled documents outside the held-out fold.

    ``per_class`` bounds the labelled documents per label, ``max_features`` the model. A document whose
    label rows disagree is toxic. Rows with a null id or label are not used. Without documents of both
    labels the model knows no feature and gives every document the same low score.
    """
    spark = small_batches(docs).sparkSession
    truth = stored(
        labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    counts = {r.toxic: r["count"] for r in truth.groupBy("toxic").count().collect()}
    # per_class bounds both parts, and so what is broadcast.
    picked = [truth.where(f"toxic = {t}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
              for t in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "_id")
    sample = stored(
        docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    )

    def feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, marks = [], []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = {w.lower() for w in TOKEN.findall(text)}
                found = {f for w in words for f in features(w)}
                names.extend(found)
                marks.extend([int(toxic)] * len(found))
            yield pd.DataFrame({"name": names, "toxic": np.array(marks, dtype="int64")})

    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model()
    n1, n0 = sizes[1], sizes[0]
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    best = (
        sample.select("text", "toxic").mapInPandas(feature_rows, "name string, toxic bigint")
        .groupBy("name").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where(f"t >= {min_docs}").withColumn("odds", odds).where("odds >= 1.0")
        .orderBy(F.desc(F.col("odds") * F.log1p("t")), "name").limit(max_features).collect()
    )
    names = {r.name: i for i, r in enumerate(best)}
    positive = {i for i, r in enumerate(best) if r.odds >= min_odds}

    def known_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            out = []
            for doc_id, text, toxic in zip(batch["doc_id"], batch["text"], batch["toxic"], strict=True):
                words = TOKEN.findall(text)
                found = known(words, names, cache)
                flat = [x for at, ids in found for x in (at, len(ids), *ids)]
                out.append((doc_id, int(toxic), len(words), flat))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "length", "flat"])

    rows = sample.mapInPandas(
        known_rows, "doc_id bigint, toxic int, length bigint, flat array<bigint>"
    ).orderBy("doc_id", "length").collect()
    samples = []
    for r in rows:
        flat, i, found = r.flat, 0, []
        while i < len(flat):
            found.append((flat[i], tuple(flat[i + 2 : i + 2 + flat[i + 1]])))
            i += 2 + flat[i + 1]
        samples.append((r.toxic, found, r.length))
    weights, chain = fit_chain(samples, len(names), positive)
    model = Model(names, weights, chain)
    x = summaries([found for _, found, _ in samples], np.array([n for _, _, n in samples]), model)[0]
    y = np.array([label for label, _, _ in samples], dtype=float)
    share = {t: counts[t] / sum(counts.values()) / (sizes[t] / sum(sizes.values())) for t in (0, 1)}
    scale = fit_logistic(x, y, np.where(y == 1, share[1], share[0]))
    return Model(names, weights, chain, scale)


def score_texts(texts: pd.Series, model: Model, spans: bool) -> list[tuple]:
    """Score and, if wanted, toxic spans (start:end in code points, comma-joined) of each text."""
    cache: dict = {}
    found, lengths = [], []
    for text in texts:
        words = TOKEN.findall(text or "")
        found.append(known(words, model.names, cache))
        lengths.append(len(words))
    x, marginals = summaries(found, np.array(lengths, dtype=np.int64), model)
    scores = 1 / (1 + np.exp(-np.clip(x @ model.scale, -40.0, 40.0)))
    out = []
    for text, tokens, p, score in zip(texts, found, marginals, scores.tolist(), strict=True):
        marked = {at for (at, _), q in zip(tokens, p, strict=True) if q >= 0.5}
        offsets = ""
        if spans and marked:
            offsets = ",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(TOKEN.finditer(text))
                               if i in marked)
        out.append((score, offsets))
    return out


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Toxicity of every row: id, score (0 to 1), predicted (1 from 0.5), spans of toxic words.

    One row per input row, repeated ones included. Only the text counts. Null, empty and letterless
    texts get the score of no evidence. Extra columns are ignored; an empty table gives an empty result.
    """
    @F.pandas_udf("score double, spans string")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(score_texts(texts, model, True), columns=["score", "spans"])

    rows = docs.select(F.col(id_col), scored(F.col(text_col)).alias("_s"))
    return rows.select(id_col, F.col("_s.score").alias("score"),
                       (F.col("_s.score") >= 0.5).cast("int").alias("predicted"),
                       F.col("_s.spans").alias("spans"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the model does not reject, columns as given."""
    model, score = train(docs, labels), own("score")

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([s for s, _ in score_texts(texts, model, False)], dtype="float64")

    return docs.withColumn(score, scored(F.col("text"))).where(F.col(score) < 0.5).drop(score)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the fold with remainder 0 is never learnt from.

    A null id counts as held out: it has no label.
    """
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    return score_documents(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
