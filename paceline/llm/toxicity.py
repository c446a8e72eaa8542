"""Toxicity by non-negative positive-unlabelled learning: linear models of words and their first letters, in numpy.

Confirmed toxic documents are the positives; unlabelled are training documents of any kind, toxic ones among them, whose
labels are not looked at. With the class prior p the risk of a model g is p * E+[l(g)] + max(0, E[l(-g)] - p * E+[l(-g)]):
what unlabelled text would cost as clean, less what the toxic share of it accounts for. Where that difference falls below
zero the model has begun to remember single documents, and its step is turned round. Where there are enough
positives several models learn from different documents, each in a task of its own; a score comes of their mean margin.
A word counts as itself and by its first STEM letters, so that families of rare words are learned as one. What selects
words is a penalty of SPARSE, or of a few standard errors of a word's own slope if that is less, so that rare words are
left out where chance would explain them, and not for being rare.

Learned from: up to POSITIVES and UNLABELLED documents (numbers of distinct doc_ids, those with the least hashes), a bound
on what is fitted; the prior is counted over all labelled training rows. Every whole text is scored.

Null and empty texts, and those without known words, get the score of no words at all. Training rows are those whose
crc32 of doc_id is not 1 modulo 3; rows without an id are scored, but never learned from. Rows may repeat: a doc_id counts
once in training, by its least text, and is toxic if any of its labels says so. Without a toxic label in training rows all
scores are 0. An empty table gives no rows. Other columns are left behind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.workers import portions, tidy

POSITIVES, UNLABELLED = 9_000, 18_000
#: Models at most, and positives that each needs.
MODELS, EACH = 3, 1_000
#: Words of a model: those in the most documents, if in at least so many.
VOCABULARY, LEAST_DOCS = 50_000, 8
STEPS, REFIT, RATE, SPARSE = 120, 120, 0.3, 4e-4
#: Letters by which longer words are also known, and standard errors of its slope that a word must exceed.
STEM, STRICT = 4, 4.0
THRESHOLD = 0.7
PORTION = 1 << 23

_WORD = re.compile(r"[^\W\d_]+")


def counts_of(text: str | None) -> tuple[list[str], np.ndarray]:
    """Distinct words in lower case, beginnings of words with a hyphen behind, and their weights: 1 + ln of the count,
    scaled to unit length."""
    n = Counter(_WORD.findall(text.lower()) if text else ())
    for w, k in list(n.items()):
        if len(w) > STEM:
            n[w[:STEM] + "-"] += k
    x = 1 + np.log(np.fromiter(n.values(), np.float64, len(n)))
    return list(n), x / max(np.sqrt((x * x).sum()), 1.0)


class Bags:
    """Documents as sparse rows over a vocabulary."""

    def __init__(self, texts: list[str | None], vocabulary: dict[str, int]):
        ids, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for t in texts:
            words, x = counts_of(t)
            found = np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))
            ids.append(found[found >= 0])
            values.append(x[found >= 0])
        self.ids, self.values, self.n = np.concatenate(ids), np.concatenate(values), len(texts)
        self.row = np.repeat(np.arange(self.n), np.array([len(i) for i in ids[1:]], np.int64))

    def only(self, kept: np.ndarray) -> Bags:
        """The same documents over the words that are kept."""
        out, some = copy(self), kept[self.ids]
        out.ids, out.values, out.row = (np.cumsum(kept) - 1)[self.ids[some]], self.values[some], self.row[some]
        return out

    def squares(self, size: int) -> np.ndarray:
        """The mean square of each word's weight over the documents, over their number."""
        return np.bincount(self.ids, self.values**2, size) / self.n**2

    def margins(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.ids], self.n) + bias

    def gradient(self, slope: np.ndarray, size: int) -> np.ndarray:
        """Of the weights and, last, the bias, from the slope of each document."""
        return np.append(np.bincount(self.ids, self.values * slope[self.row], size), slope.sum())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def train(positive: list[str], unlabelled: list[str], prior: float) -> tuple[dict[str, float], float]:
    """Weights of words and the bias that make the least non-negative risk, by Adam over all documents in each step: STEPS
    that select words, REFIT that fit those alone."""
    docs = Counter(w for t in positive + unlabelled for w in counts_of(t)[0])
    words = sorted((w for w, n in docs.items() if n >= LEAST_DOCS), key=lambda w: (-docs[w], w))[:VOCABULARY]
    vocabulary = {w: i for i, w in enumerate(words)}
    pos, unl, size = Bags(positive, vocabulary), Bags(unlabelled, vocabulary), len(words)
    w = np.append(np.zeros(size), np.log(prior / (1 - prior)))
    # of the slope at the start, which is prior * (mean of the unlabelled - mean of the positives)
    error = prior * np.sqrt(pos.squares(size) + unl.squares(size))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + REFIT + 1):
        if step == STEPS + 1:  # words that say too little have no weight at all; the others are fitted without a penalty
            kept = w[:-1] != 0
            words, some = [words[i] for i in np.flatnonzero(kept)], np.append(kept, True)
            pos, unl, size = pos.only(kept), unl.only(kept), len(words)
            w, first, second = w[some], first[some], second[some]
        g, u = pos.margins(w[:-1], w[-1]), unl.margins(w[:-1], w[-1])
        clean = softplus(u).mean() - prior * softplus(g).mean()
        # slopes of the toxic part, and of the clean part
        toxic = pos.gradient(-prior * sigmoid(-g) / pos.n, size)
        other = unl.gradient(sigmoid(u) / unl.n, size) - pos.gradient(prior * sigmoid(g) / pos.n, size)
        slope = toxic + other if clean >= 0 else -other
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        pace = RATE / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
        w -= pace * first / (1 - 0.9**step)
        if step <= STEPS:
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - pace[:-1] * np.minimum(SPARSE, STRICT * error), 0)
    return dict(zip(words, w[:-1].tolist(), strict=True)), float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, ids: DataFrame, most: int, models: int) -> DataFrame:
    """(model, text) of at most `most` of the ids, those with the least hashes; the hash deals them to models."""
    h = F.xxhash64(F.lit(12), "doc_id")
    chosen = ids.select("doc_id").distinct().orderBy(h).limit(most)
    d = docs.join(F.broadcast(chosen), "doc_id")  # as many ids as `most`, whatever the table
    return d.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select(F.pmod(h, F.lit(models)).cast("int").alias("model"), "text")


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> list[tuple[dict[str, float], float]]:
    """The models: (weights of words, bias) of each. At most VOCABULARY words a model come to the driver."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    n, toxic = known.join(learn.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not toxic:
        return []
    prior = min(max(toxic / n, 0.001), 0.999)
    models = max(1, min(MODELS, toxic // EACH))
    yes = _sample(learn, learn.select("doc_id").join(known.filter("toxic = 1"), "doc_id", "left_semi"), positives, models)
    both = yes.withColumn("positive", F.lit(True)).unionByName(_sample(learn, learn, unlabelled, models).withColumn("positive", F.lit(False)))

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("text")
        yes, any_ = (frame["text"][frame["positive"] == side].tolist() for side in (True, False))
        if not yes or not any_:
            return pd.DataFrame({"words": [], "weights": [], "bias": []})
        weights, bias = train(yes, any_, prior)
        return pd.DataFrame({"words": [list(weights)], "weights": [list(weights.values())], "bias": [bias]})

    rows = both.groupBy("model").applyInPandas(of, "words array<string>, weights array<double>, bias double").collect()
    return [(dict(zip(r.words, r.weights, strict=True)), r.bias) for r in sorted(rows, key=lambda r: (r.bias, len(r.words)))]


def scored(docs: DataFrame, models: list[tuple[dict[str, float], float]]) -> DataFrame:
    """(doc_id, score) of each document, 0 to 1."""
    total: dict[str, float] = {}
    for weights, _ in models:
        for word, x in weights.items():
            total[word] = total.get(word, 0.0) + x / len(models)
    held = docs.sparkSession.sparkContext.broadcast((total, sum(b for _, b in models) / max(len(models), 1), bool(models)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, some = held.value
        for batch in portions(batches, "text", PORTION):
            margin = []
            for t in batch.column("text").to_pylist():
                words, x = counts_of(t)
                margin.append(float(np.fromiter((weights.get(w, 0.0) for w in words), np.float64, len(words)) @ x) + bias)
            score = sigmoid(np.array(margin)) * some
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(apply), "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = scored(docs, fit(docs, labels))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
