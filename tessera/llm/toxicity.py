"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, crc_remainder, labelled_sample, table

HELD_OUT, MODULUS = 2, 4
#: Bound of the fitting sample: about so many labelled texts of each class.
PER_CLASS = 6000
THRESHOLD = 0.3
BITS = 20
WORD = re.compile(r"[^\W\d_]+")
STEM = 4


class Features:
    """Hashed features of a text: its words, the words' first letters, pairs of neighbours, and pairs one word apart."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.words = BoundedCache(lambda w: xxhash.xxh64_intdigest(w, 1), 150_000)
        self.stems = BoundedCache(lambda w: xxhash.xxh64_intdigest(w[:STEM], 2), 150_000)

    def of(self, text: str) -> list[np.ndarray]:
        words = WORD.findall(text.lower())
        if not words:
            return []
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        s = np.fromiter(map(self.stems.__getitem__, words), np.uint64, len(words))
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = [h, s, h[:-1] * a ^ (h[1:] * b >> np.uint64(7)), h[:-2] * b ^ (h[2:] * a >> np.uint64(11))]
        return [((m ^ (m >> np.uint64(29))) & self.mask).astype(np.int64) for m in mixed if len(m)]


class FtrlProximal:
    """Per-coordinate learning rates and L1 sparsity (McMahan et al., 2013); features are binary."""

    def __init__(self, bits: int = BITS, alpha: float = 0.6, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weight(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, x: np.ndarray, y: float, importance: float) -> None:
        z, n = self.z[x], self.n[x]
        w = self.weight(z, n)
        b = self.bias()
        g = importance * (1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y)
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[x], self.n[x] = z + g - step * w, n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weight(self.z, self.n)
        at = np.flatnonzero(w)
        return at, w[at]


def fit(texts: list[str], y: list[int], weights: dict[int, float], epochs: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that aren't zero, and the bias. Texts are taken in the order of their hash."""
    features, model = Features(), FtrlProximal()
    order = sorted(range(len(texts)), key=lambda k: (xxhash.xxh64_intdigest(texts[k] or "", 3), y[k]))
    least = min(weights.values(), default=1.0)
    rows = []
    for k in order:
        x = features.of(texts[k] or "")
        # tied weights of the classes are kept, as odds, in the bias below
        rows.append((np.unique(np.concatenate(x)).astype(np.int32) if x else np.zeros(0, np.int32), y[k]))
    for _ in range(epochs):
        for x, label in rows:
            model.learn(x, label, 1.0)
    shift = float(np.log(weights.get(1, 1.0) / least) - np.log(weights.get(0, 1.0) / least))
    at, w = model.sparse()
    return at, w, model.bias() + shift


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on a bounded, stratified sample of labelled texts (PER_CLASS) in one task; the sample's odds are undone."""
    sample, weights = labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, PER_CLASS)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, y = [], []
        for b in batches:
            texts += list(b["text"])
            y += [int(v) for v in b["y"]]
        if texts:
            at, w, bias = fit(texts, y, weights)
            yield pd.DataFrame({"at": np.append(at, -1), "w": np.append(w, bias)})

    # one task, at most about 2 * PER_CLASS texts
    rows = sample.select("text", "y").repartition(1).mapInPandas(train, "at long, w double").collect()
    at = np.array([r["at"] for r in rows if r["at"] >= 0], dtype=np.int64)
    w = np.array([r["w"] for r in rows if r["at"] >= 0])
    return at, w, next((r["w"] for r in rows if r["at"] < 0), 0.0)


def scored(text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """The probability that a whole text is toxic, as a double column; null and empty texts get the bias alone."""
    at, w, bias = model

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, dense = Features(), np.zeros(1 << BITS)
        dense[at] = w
        for texts in batches:
            out = np.full(len(texts), bias)
            for k, t in enumerate(texts):
                x = features.of(t) if t else []
                if x:
                    x = np.concatenate(x)
                    out[k] += dense[np.unique(x[dense[x] != 0])].sum()
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return score(text)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Null and empty texts get the score of the bias; a null id
    counts as empty text in the split; repeated rows give repeated results; with no labels every score is 0.5.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (crc_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), scored(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
