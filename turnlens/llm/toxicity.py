"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence is toxic with probability ``p = logistic(bias + sum of the
weights of its words)``; a document is toxic if any sentence is: ``1 - product(1 - p)``. Only whole
documents carry labels; the gradient of the noisy-or passes them on to the sentences that explain
them, so the trained model also locates the offending sentences.

A word contributes itself and its first letters, so inflected and compound forms share evidence.
Features are chosen by how differently they occur in labelled documents of the two classes. The fit
uses at most ``sample`` labelled training rows (those with the smallest hash of the id), ``MOST_CHARS``
characters and ``features`` features; every document is scored whole. Labels are read from training rows only; labels, language, source
and id are no inputs of a score.

Null and empty texts are one empty sentence: the model's base rate. Without labelled training rows
every score is 0. An id counts once: several labels are one, toxic if one says so, several documents one
text; null labels are ignored. Repeated rows are scored each for itself; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.llm.common import bounded_batches, stored, text_or_empty

#: Training rows, features, and characters of all training rows together, at most.
SAMPLE, FEATURES, MOST_CHARS = 20_000, 500, 400_000_000
#: A feature must occur in so many training documents.
LEAST_DOCS = 3
THRESHOLD = 0.3
#: Lengths of the first letters that longer words also stand for.
PREFIXES = (3, 4, 5, 6, 7)
ROUNDS, RATE, PENALTY = 300, 0.2, 1e-2
MEMORY = 200_000

SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def sentences_of(text: str) -> list[str]:
    """Sentences that have words; one empty sentence if there are none."""
    return [s for s in SENTENCE.split(text) if s and not s.isspace()] or [""]


@dataclass
class Model:
    """Weights of features, and the bias of a sentence."""
    weight: dict[str, float]
    bias: float
    memory: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"weight": self.weight, "bias": self.bias, "memory": {}}

    def of_word(self, word: str) -> float:
        value = self.memory.get(word)
        if value is None:
            if len(self.memory) > MEMORY:
                self.memory.clear()
            value = sum(self.weight.get(f, 0.0) for f in word_features(word))
            self.memory[word] = value
        return value

    def bag(self, text: str) -> tuple[float, list[str], np.ndarray]:
        """The document's score, its sentences and their scores."""
        parts = sentences_of(text)
        of_word = self.of_word
        z = np.array([sum(map(of_word, WORD.findall(s.lower()))) for s in parts]) + self.bias
        soft = np.logaddexp(0.0, z)
        return float(-np.expm1(-soft.sum())), parts, -np.expm1(-soft)


def training_rows(docs: DataFrame, labels: DataFrame, is_training: Column, sample: int,
                  most_chars: int = MOST_CHARS) -> DataFrame:
    """``text, toxic`` of the labelled training rows: one for each id that has both a label and a document.

    At most ``sample`` ids, those with the smallest hashes, and of these as many in that order as hold
    ``most_chars`` characters together. An id with several labels is toxic if one says so; of several
    documents with one id the smallest text counts. Ids meet as text, whatever their types.
    """
    name = F.col("doc_id").cast("string").alias("name")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(is_training) \
        .select(name, F.col("toxic").cast("int").alias("toxic")).groupBy("name").agg(F.max("toxic").alias("toxic"))
    there = known.join(docs.select(name).distinct(), "name", "left_semi")
    chosen = there.withColumn("place", F.xxhash64("name")).orderBy("place", "name").limit(sample)
    texts = stored(docs.select(name, text_or_empty().alias("text")).join(F.broadcast(chosen), "name")  # ``sample`` rows
                   .groupBy("name", "place", "toxic").agg(F.min("text").alias("text")), "labelled")
    sizes = texts.select("name", F.sum(F.length("text").cast("long")).over(  # of ``sample`` narrow rows
        Window.orderBy("place", "name").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"))
    kept = sizes.where(F.col("so_far") <= most_chars).select("name")
    return texts.join(F.broadcast(kept), "name", "left_semi").select("text", "toxic")


def chosen_features(rows: DataFrame, features: int) -> list[str]:
    """Features whose share of documents differs most between the classes (chi-square), best first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        sizes = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                seen[y].update({f for w in words for f in word_features(w)})
                sizes[y] += 1
        seen[0][""], seen[1][""] = sizes
        names = list(seen[0].keys() | seen[1].keys())
        for a in range(0, len(names), 50_000):
            part = names[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[0][n] for n in part], pa.int64()),
                                              pa.array([seen[1][n] for n in part], pa.int64())],
                                             names=["feature", "clean", "toxic"])

    counts = rows.mapInArrow(count, "feature string, clean bigint, toxic bigint").groupBy("feature") \
        .agg(F.sum("clean").cast("double").alias("c"), F.sum("toxic").cast("double").alias("t")) \
        .where((F.col("feature") == "") | (F.col("c") + F.col("t") >= LEAST_DOCS))
    total = counts.where("feature = ''").select("c", "t").first()
    if total is None or not total["c"] or not total["t"]:
        return []
    n_c, n_t = total["c"], total["t"]
    c, t = F.col("c"), F.col("t")
    gap = t * (n_c - c) - c * (n_t - t)
    chi = gap * gap * (n_c + n_t) / ((t + c) * (n_c + n_t - t - c + 0.5) * n_c * n_t)
    best = counts.where("feature != ''").select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature") \
        .limit(features).collect()
    return [r["feature"] for r in best]


def bags(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, ...]:
    """Training bags on the driver: labels, empty sentences of each, and (bag, sentence, feature, times) of the others.

    Sentences of a document with the same features are one row with the number of times, and only sentences that
    hold a chosen feature are listed. The sample's bound on rows and characters bounds them.
    """
    index = {n: i for i, n in enumerate(names)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, list[int]] = {}
        for b in batches:
            empty, groups, times = [], [], []
            for text in b.column(0).to_pylist():
                found: Counter = Counter()
                none = 0
                for s in sentences_of(text):
                    ids = []
                    for w in WORD.findall(s.lower()):
                        hit = memory.get(w)
                        if hit is None:
                            if len(memory) > MEMORY:
                                memory.clear()
                            hit = memory[w] = [index[f] for f in word_features(w) if f in index]
                        ids += hit
                    if ids:
                        found[tuple(sorted(ids))] += 1
                    else:
                        none += 1
                empty.append(none)
                groups.append(list(found))
                times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(empty, pa.int64()), pa.array(groups, pa.list_(pa.list_(pa.int32()))),
                                              pa.array(times, pa.list_(pa.int32()))], names=["toxic", "empty", "sentences", "times"])

    y, empty, bag, size, feats, times = [], [], [], [], [], []
    for r in rows.mapInArrow(read, "toxic int, empty bigint, sentences array<array<int>>, times array<int>").toLocalIterator():
        for ids in r["sentences"]:
            bag.append(len(y))
            size.append(len(ids))
            feats.append(np.array(ids, dtype=np.int32))
        times += r["times"]
        y.append(r["toxic"])
        empty.append(r["empty"])
    flat = np.concatenate(feats) if feats else np.zeros(0, np.int32)
    return np.array(y, float), np.array(empty, float), np.array(bag, np.int64), np.repeat(np.arange(len(size)), size), flat, \
        np.array(times, float)


def fit_noisy_or(y: np.ndarray, empty: np.ndarray, bag: np.ndarray, sentence: np.ndarray, feature: np.ndarray,
                 n_features: int, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the log loss of the noisy-or, by Adam steps over all bags.

    ``times`` says how often each sentence stands in its bag (once if not given).
    """
    times = np.ones(len(bag)) if times is None else times
    w, bias = np.zeros(n_features), -5.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(sentence, weights=w[feature], minlength=len(bag))
        total = np.bincount(bag, weights=times * np.logaddexp(0.0, z), minlength=len(y)) + empty * np.logaddexp(0.0, bias)
        total = np.maximum(total, 1e-9)
        slope = np.where(y > 0, -1.0 / np.expm1(np.minimum(total, 50.0)), 1.0) / len(y)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = slope[bag] * p * times
        base = (slope * empty).sum() / (1 + np.exp(-bias))
        g = np.r_[np.bincount(feature, weights=dz[sentence], minlength=n_features) + PENALTY * w / len(y), dz.sum() + base]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, is_training: Column, sample: int = SAMPLE,
          features: int = FEATURES) -> Model:
    """A model from the labelled rows for which ``is_training`` (over the columns of ``labels``) holds."""
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, is_training, sample)
    names = chosen_features(rows, features)
    if not names:
        return Model({}, -60.0)
    y, empty, bag, sentence, feature, times = bags(rows, names)
    w, bias = fit_noisy_or(y, empty, bag, sentence, feature, len(names), times)
    return Model(dict(zip(names, w.tolist())), bias)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                    locate: int = 3) -> DataFrame:
    """``id_col, score, sentences`` of every row: the ``locate`` worst sentences as (place, score, text)."""
    bounded_batches(docs.sparkSession)
    place = pa.list_(pa.struct([("place", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, worst = [], []
            for text in b.column(1).to_pylist():
                total, parts, own = model.bag(text)
                scores.append(total)
                top = np.argsort(-own, kind="stable")[:locate]
                worst.append([{"place": int(i), "score": float(own[i]), "text": parts[i].strip()}
                              for i in top if own[i] >= THRESHOLD])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(worst, place)],
                                             names=["id", "score", "sentences"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")) \
        .mapInArrow(run, f"id {kind}, score double, sentences array<struct<place:int,score:double,text:string>>") \
        .withColumnRenamed("id", id_col)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """All columns of every row and its score."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.bag(text or "")[0] for text in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())],
                                             names=[*b.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
