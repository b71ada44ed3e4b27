"""Toxicity scores from averaged subword embeddings and a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, own_names, within_budget

#: Character n-grams of these lengths, a word's ends included, share the rows of the embedding.
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIM = 4
#: The average is scaled up, as a few words decide among hundreds.
SCALE = 300.0
EPOCHS = 6
#: The classifier is fitted on at most so many labelled documents of each class, whose whole
#: texts have at most so many characters together.  Scores use whole texts of any length.
MAX_TOXIC, MAX_CLEAN = 2000, 4000
TOXIC_CHARS, CLEAN_CHARS = 4_000_000, 8_000_000
FOLDS = 5

_BASE, _SPREAD, _SHIFT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 17)


def subword_buckets(text: str) -> np.ndarray:
    """The bucket of each character n-gram of the words of ``text``, repeats kept.

    Words are in lower case with a space at both ends; an n-gram lies inside one such
    word.  A misspelling keeps most n-grams of the word that it comes from.
    """
    points = f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass")
    data = np.frombuffer(points, dtype=np.uint32).astype(np.uint64)
    spaces = np.concatenate(([0], np.cumsum(data == 32, dtype=np.int32)))
    found, value = [], data
    for n in range(2, max(GRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        value = value[:m] * _BASE + data[n - 1 :]
        if n in GRAMS:
            inside = spaces[n - 1 : n - 1 + m] == spaces[1 : m + 1]
            found.append(((value[inside] * _SPREAD) >> _SHIFT).view(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Softmax:
    """An embedding row for each bucket, a linear layer over their average, and class biases."""

    rows: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self) -> tuple[np.ndarray, float]:
        """The layers are linear up to the softmax: each bucket's part in the margin of class 1, and the rest."""
        w = self.weights[:, 1] - self.weights[:, 0]
        return (self.rows @ w).astype(np.float32), float(self.bias[1] - self.bias[0])


def bags(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets and counts of all texts, one after another, and where each text begins."""
    ids, counts, ends = [], [], [0]
    for t in texts:
        own, n = np.unique(subword_buckets(t), return_counts=True)
        ids.append(own.astype(np.int32))
        counts.append(n.astype(np.int32))
        ends.append(ends[-1] + len(own))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (ids, counts)]
    return *joined, np.array(ends)


def loss_and_gradients(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray, ids: np.ndarray, part: np.ndarray, sizes: np.ndarray, y: np.ndarray):
    """The mean cross entropy of a batch, the rows that it touches, and the gradients of these, of weights and of bias.

    ``ids`` are the buckets of its texts one after another, ``sizes`` how many each has, and
    ``part`` the share of a bucket in its text.
    """
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    mean = np.add.reduceat(rows[ids] * part[:, None], starts) * SCALE
    z = mean @ weights + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(p[np.arange(len(y)), y] + 1e-30).mean()
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = p @ weights.T * SCALE
    by_id, place = np.unique(ids, return_inverse=True)
    each = np.repeat(back, sizes, axis=0) * part[:, None]
    grad = np.stack([np.bincount(place, each[:, k], len(by_id)) for k in range(rows.shape[1])], axis=1).astype(rows.dtype)
    return loss, by_id, grad, mean.T @ p, p.sum(axis=0)


def train(texts: list[str], labels: list[int], prior: float, seed: int = 0) -> Softmax:
    """Fit embedding and softmax together by Adam steps on batches of documents.

    ``prior`` is the share of class 1 among all labelled rows; the biases undo the share
    of it in the sample.
    """
    rng = np.random.default_rng(seed)
    ids, counts, ends = bags(texts)
    sizes = np.diff(ends)
    y = np.array(labels)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    rows = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], dtype=np.float32))
    params = [rows, weights, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, batch = 0, 32
    for epoch in range(EPOCHS):
        order = rng.permutation(len(sizes))
        rate = 0.05 * (1 - epoch / EPOCHS)
        for at in range(0, len(order), batch):
            docs = [d for d in order[at : at + batch] if sizes[d]]
            if not docs:
                continue
            spans = [slice(ends[d], ends[d + 1]) for d in docs]
            part = np.concatenate([counts[s] / np.float32(counts[s].sum()) for s in spans]).astype(np.float32)
            _, by_id, *grads = loss_and_gradients(rows, weights, bias, np.concatenate([ids[s] for s in spans]), part, sizes[docs], y[docs])
            step += 1
            for i, (where, g) in enumerate(zip((by_id, slice(None), slice(None)), grads, strict=True)):
                first[i][where] = 0.9 * first[i][where] + 0.1 * g
                second[i][where] = 0.999 * second[i][where] + 0.001 * g * g
                params[i][where] -= rate * (first[i][where] / (1 - 0.9**step)) / (np.sqrt(second[i][where] / (1 - 0.999**step)) + 1e-8)
    shift = np.log(np.array([(1 - prior) / (1 - share), prior / share], dtype=np.float32))
    return Softmax(rows * SCALE, weights, bias + shift)


#: Words whose n-grams are looked up at a time.
SLICE = 50_000


def score_texts(texts: Iterable[str], margins: np.ndarray, rest: float) -> list[float]:
    """The probability of class 1 for each text: softmax over the average of its n-grams."""
    found = []
    for text in texts:
        words, total, n = text.split(), 0.0, 0
        for at in range(0, len(words), SLICE):
            ids = subword_buckets(" ".join(words[at : at + SLICE]))
            total, n = total + float(margins[ids].sum(dtype=np.float64)), n + len(ids)
        margin = rest + (total / n if n else 0.0)
        found.append(float(1 / (1 + np.exp(-min(max(margin, -50.0), 50.0)))))
    return found


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int], float]:
    """Texts and labels of a bounded sample of the rows outside the held-out fold, and the share of toxic ones.

    At most ``MAX_TOXIC`` and ``MAX_CLEAN`` documents in the order of a seeded hash; of rows
    that repeat a doc_id the one with the least hash of its text.  Texts are whole: of each
    class those are taken, in the same order, that fit into its budget of characters.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id")
    # The limits are the bound of the sample that the classifier is fitted on.
    chosen = known.where("toxic = 1").orderBy(order).limit(MAX_TOXIC).union(known.where("toxic = 0").orderBy(order).limit(MAX_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    held = texts.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    sizes = held.groupBy("doc_id", "toxic").agg(F.min(F.struct("h", F.length("text").alias("n"))).alias("x")).select("doc_id", "toxic", "x.*", order.alias("place")).collect()
    taken = {}
    for toxic, budget in ((1, TOXIC_CHARS), (0, CLEAN_CHARS)):
        rows = sorted((r["place"], r["doc_id"], r["h"], r["n"]) for r in sizes if r["toxic"] == toxic)
        taken |= dict(within_budget([((i, h), n) for _, i, h, n in rows], budget))
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.0
    if not taken:
        return [], [], prior
    picked = docs.sparkSession.createDataFrame(list(taken.items()), "doc_id long, h long")
    found = held.join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "toxic").agg(F.any_value("text").alias("text"))
    rows = sorted(found.collect())
    return [r["text"] for r in rows], [r["toxic"] for r in rows], prior


def _score_column(docs: DataFrame, labels: DataFrame) -> tuple[Column, bool]:
    """The score of ``text``, and whether there were rows of both classes to learn from.

    Only texts go to the Python workers, in batches of bounded bytes, and only numbers come back.
    """
    bound_batches(docs.sparkSession)
    texts, toxic, prior = _sample(docs, labels)
    learned = 0 < sum(toxic) < len(toxic)
    if learned:
        margins, rest = train(texts, toxic, prior).margins()
    else:
        margins, rest = np.zeros(BUCKETS, dtype=np.float32), (50.0 if prior == 1 else -50.0)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts, margins, rest), dtype=float)

    return score(F.coalesce(F.col("text").cast("string"), F.lit(""))), learned


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    The classifier is fitted on ``labels.toxic`` of rows whose crc32(doc_id) is not 0
    modulo ``FOLDS`` and on nothing else than their texts.  A null or empty text, or one
    without any n-gram, has the score of the biases alone.  Labels other than 0 and 1
    are ignored; a doc_id labelled twice is toxic if one label says so; without rows of
    both classes every score is their share.  Rows that repeat are scored alike; further
    columns are ignored.
    """
    score, _ = _score_column(docs, labels)
    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@own_names
def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns; all if nothing can be learned."""
    score, learned = _score_column(docs, labels)
    return docs.where(score < 0.5) if learned else docs
