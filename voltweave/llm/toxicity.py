"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character 3- to 5-grams (hashed to BUCKETS rows), so that unseen
misspellings and inflections share the vectors of what was seen. A document's vector is the average of its words' vectors and
of BLANKS zero vectors, a word that occurs c times weighing sqrt(min(c, REPEATS)); a linear softmax over it gives the two
classes. Embeddings and softmax are fitted together. The blanks keep a stray word of a very short text from deciding, the
damped weights a word that a text repeats dozens of times.

Because the softmax is linear, a word's share of the log odds is one number, which each worker keeps for the words it has
met: texts are scored whole, at the cost of a look-up per distinct word.

Defined cases: null and empty texts have no words and score as the bias alone. Without labelled rows of both classes all
scores are 0. Rows of `labels` without a document teach nothing; of labelled
texts longer than TRAIN_CHARS are scored but not learnt from; texts that repeat under one label are learnt from once. Other
columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.llm.common import bounded, bounded_batches, decode, fold, held_out, scored, stratified, utf8

#: Bounds of the fit: about so many labelled documents of each class, none longer than so many characters.
TRAIN_DOCS, TRAIN_CHARS = 2000, 100_000
BUCKETS, DIM = 1 << 16, 8
#: Zero vectors that every average holds, and occurrences of a word that count.
BLANKS, REPEATS = 100, 3
#: SCALE makes up for the smallness of an average of many words.
SCALE, STEPS, RATE, SHRINK = 100.0, 400, 0.05, 1e-4
CACHE_WORDS = 250_000
WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    margins: np.ndarray  #: of each subword: its vector's share of the log odds
    bias: float


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def subwords(word: str) -> list[int]:
    marked = f"<{word}>".encode()
    return [zlib.crc32(marked[i : i + n]) % BUCKETS for n in (3, 4, 5) for i in range(len(marked) - n + 1)]


class _Adam:
    def __init__(self, shape: tuple[int, ...]) -> None:
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        rate = RATE * (1 - 0.98 * self.t / STEPS)  # falls, lest the fit ends on a spike of the loss
        return rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-6)


def weights_of(counts: np.ndarray) -> np.ndarray:
    """What words weigh in their document's average, by how often they occur."""
    return np.sqrt(np.minimum(counts, REPEATS))


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """rows: text and class, 0 or 1. None if a class is missing."""
    y = np.array([c for _, c in rows], np.float32)
    if len(rows) == 0 or y.min() == y.max():
        return None
    vocabulary: dict[str, int] = {}
    doc_of, word_of, part_of = [], [], []
    for d, (text, _) in enumerate(rows):
        ids, counts = np.unique(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32), return_counts=True)
        weights = weights_of(counts)
        doc_of.append(np.full(len(ids), d, np.int32))
        word_of.append(ids)
        part_of.append((weights / (weights.sum() + BLANKS)).astype(np.float32))
    doc, word, part = np.concatenate(doc_of), np.concatenate(word_of), np.concatenate(part_of)
    if not vocabulary:
        return None
    subs = [subwords(w) for w in vocabulary]
    sizes = np.array([len(s) for s in subs], np.int32)
    sub = np.array([x for s in subs for x in s], np.int32)
    del subs, doc_of, word_of, part_of
    # sums over documents, words and subwords run over rows sorted by them
    docs, doc_start = np.unique(doc, return_index=True)
    by_word = np.argsort(word, kind="stable")
    word_doc, word_part, word_start = doc[by_word], part[by_word], np.searchsorted(word[by_word], np.arange(len(sizes)))
    sub_start = np.cumsum(sizes) - sizes
    by_bucket = np.argsort(sub, kind="stable")
    bucket_word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_bucket]
    buckets, bucket_start = np.unique(sub[by_bucket], return_index=True)
    rng = np.random.default_rng(7)
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
    out = (rng.standard_normal(DIM) * 0.5).astype(np.float32)  # the difference of the softmax's two rows
    bias = np.zeros(1, np.float32)
    steps = [_Adam(emb.shape), _Adam(out.shape), _Adam(bias.shape)]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
    for _ in range(STEPS):
        margin = (np.add.reduceat((emb @ out)[sub], sub_start) / sizes).astype(np.float32)
        z = np.full(len(rows), bias[0])
        z[docs] += SCALE * np.add.reduceat(part * margin[word], doc_start)
        slope = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32)
        of_word = (SCALE * np.add.reduceat(word_part * slope[word_doc], word_start) / sizes).astype(np.float32)
        of_bucket = np.zeros(BUCKETS, np.float32)
        of_bucket[buckets] = np.add.reduceat(of_word[bucket_word], bucket_start)
        grad_out = of_bucket @ emb
        emb -= steps[0].step(np.outer(of_bucket, out) + SHRINK * emb)
        out -= steps[1].step(grad_out)
        bias -= steps[2].step(slope.sum(keepdims=True))
    return Model((emb @ out).astype(np.float32), float(bias[0]))


class Margins(dict):
    """Word to its share of the log odds, computed when first met."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = float(self.model.margins[subwords(word)].mean())
        self[word] = value
        return value


def score(model: Model, margins: Margins, text: str) -> float:
    counts = Counter(words_of(text))
    weights = weights_of(np.fromiter(counts.values(), np.float64, len(counts)))
    total = float(weights @ np.fromiter(map(margins.__getitem__, counts), np.float64, len(counts)))
    return float(1 / (1 + np.exp(-np.clip(SCALE * total / (weights.sum() + BLANKS) + model.bias, -30, 30))))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on a bounded, hash-picked sample of the labelled documents outside fold 0."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", "toxic").distinct()
    sample = F.broadcast(bounded(stratified(known, "toxic", "doc_id", TRAIN_DOCS), 3 * TRAIN_DOCS))  # at most so many ids
    texts = docs.select("doc_id", "text").where(F.char_length(F.coalesce("text", F.lit(""))) <= TRAIN_CHARS)
    rows = bounded(texts.join(sample, "doc_id").select("text", "toxic").distinct(), 3 * TRAIN_DOCS).collect()
    return fit(sorted((r["text"] or "", int(r["toxic"])) for r in rows))


def toxicity(docs: DataFrame, model: Model | None) -> Column:
    """The score column for the text column of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)
    held: list[Margins] = []

    def run(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Margins(shared.value))
        return pd.Series([score(shared.value, held[0], decode(t)) for t in texts], dtype="float64")

    return scored("double", run)(utf8(F.col("text")))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    value = toxicity(docs, train(docs, labels))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
