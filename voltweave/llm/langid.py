"""Language identification by words first, backing off to ever shorter character n-grams.

A known word adds its log frequency in each language. A word outside the vocabulary adds the mean log frequency of
its known 5-grams; if none is known, of its 4-grams, and so on down to single letters. The language with the largest
sum wins; the score is its softmax share, with the sum scaled to the evidence of EVIDENCE_WORDS words at most.

Defined cases: null and empty texts, and texts without a letter, give `und` with score 0. Ties go to the language that
comes first by code point. Without training rows every text gives `und`. Repeated rows give repeated results. Other
columns are not looked at. Training texts that repeat within a language teach once; of a column with more languages than
MOST_LABELS the most frequent ones are learnt.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.llm.common import bounded, bounded_batches, decode, fold, fresh, held_out, scored, stratified, utf8

#: Bounds of the fit: about so many training documents of each language, none longer than so many characters.
TRAIN_DOCS, TRAIN_CHARS = 1500, 100_000
#: Sizes of the model: known words, and known n-grams of each length, the most frequent ones of the training documents that
#: occur at least LEAST_WORD or LEAST_GRAM times there. Rarer words back off to n-grams, as unseen ones do.
MAX_WORDS, MAX_GRAMS = 150_000, 40_000
LEAST_WORD, LEAST_GRAM = 2, 3
LENGTHS = (5, 4, 3, 2, 1)
EVIDENCE_WORDS = 20
#: Words kept with their scores in each Python worker, besides the vocabulary.
CACHE_WORDS = 250_000
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: list[dict[str, int]]
    gram_logs: list[np.ndarray]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() for w in words) or any(c.isalpha() for w in words for c in w)


def grams_of(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _logs(counts: list[Counter], limit: int, least: int) -> tuple[dict[str, int], np.ndarray]:
    total: Counter = Counter()
    for c in counts:
        total.update(c)
    kept = sorted((k for k, v in total.items() if v >= least), key=lambda k: (-total[k], k))[:limit]
    table = np.array([[c[k] for c in counts] for k in kept], dtype=np.float64).reshape(len(kept), len(counts))
    sums = np.array([sum(c.values()) for c in counts], dtype=np.float64)
    return {k: i for i, k in enumerate(kept)}, np.log((table + 0.5) / (sums + 0.5 * max(1, len(kept)))).astype(np.float32)


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: text and language."""
    langs = sorted({lang for _, lang in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    counts: list[Counter] = [Counter() for _ in langs]
    for text, lang in rows:
        counts[place[lang]].update(words_of(text))
    words, word_logs = _logs(counts, MAX_WORDS, LEAST_WORD)
    grams, gram_logs = [], []
    for n in LENGTHS:
        by_lang: list[Counter] = []
        for c in counts:
            g: Counter = Counter()
            for w, v in c.items():
                for x in grams_of(w, n):
                    g[x] += v
            by_lang.append(g)
        table, logs = _logs(by_lang, MAX_GRAMS, LEAST_GRAM)
        grams.append(table)
        gram_logs.append(logs)
    return Model(langs, words, word_logs, grams, gram_logs)


class Scores(dict):
    """Word to row of its log frequencies; rows of unseen words are computed when first met."""

    def __init__(self, model: Model) -> None:
        super().__init__(model.words)
        self.model, self.used = model, len(model.words)
        self.rows = np.zeros((self.used + CACHE_WORDS + 1, len(model.langs)), np.float32)
        self.rows[: self.used] = model.word_logs

    def __missing__(self, word: str) -> int:
        at = self.used
        self.rows[at] = self.backoff(word)
        self[word] = at
        self.used += 1
        return at

    def backoff(self, word: str) -> np.ndarray:
        for n, table, logs in zip(LENGTHS, self.model.grams, self.model.gram_logs, strict=True):
            found = [table[g] for g in grams_of(word, n) if g in table]
            if found:
                return logs[found].mean(axis=0)
        return np.zeros(len(self.model.langs), np.float32)

    def total(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(self.model.langs))
        for at in range(0, len(words), 50_000):  # no more new words at a time than there is room for
            part = words[at : at + 50_000]
            if self.used + len(part) > len(self.rows):
                self.clear()
                self.update(self.model.words)
                self.used = len(self.model.words)
            out += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
        return out


def predict(model: Model, scores: Scores, text: str) -> tuple[str, float]:
    words = words_of(text)
    if not model.langs or not words or not has_letter(words):
        return UNDETERMINED, 0.0
    z = scores.total(words) * min(1.0, EVIDENCE_WORDS / len(words))
    best = int(z.argmax())
    return model.langs[best], 1.0 / float(np.exp(np.clip(z - z[best], -700, 0)).sum())


def train(docs: DataFrame) -> Model:
    """Fits on a bounded, hash-picked sample of the documents outside fold 0 that carry a language."""
    known = docs.where(F.col("lang").isNotNull() & (F.char_length("text") <= TRAIN_CHARS) & (fold(F.col("doc_id")) != 0))
    sample = stratified(known.select("text", "lang"), "lang", "text", TRAIN_DOCS).distinct()
    langs = sample.select("lang").distinct().count()
    return fit(sorted((r["text"], r["lang"]) for r in bounded(sample, 2 * langs * TRAIN_DOCS).collect()))


def identify(docs: DataFrame, model: Model | None = None) -> tuple[Column, DataFrame]:
    """A struct column (lang_pred, score) for the text column of docs, and docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))
    held: dict[int, Scores] = {}

    def run(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        s = held.setdefault(0, None) or held.update({0: Scores(m)}) or held[0]
        out = [predict(m, s, decode(t)) for t in texts]
        return pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out]})

    return scored("lang_pred string, score double", run)(utf8(F.col("text"))), docs


def query(docs: DataFrame) -> DataFrame:
    found, docs = identify(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("_r")).select("doc_id", "held_out", "_r.lang_pred", "_r.score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is told with a score of at least `least`; 0.25 would be a blind guess among four."""
    found, docs = identify(docs)
    name = fresh(docs, "_lang_found")
    out = docs.withColumn(name, found)
    return out.where((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= least)).select(*docs.columns)


__all__ = ["Model", "fit", "identify", "keep_identified", "predict", "query", "train"]
