"""Language identification with hyperdimensional profiles.

A letter's random bipolar vector is permuted by its place in the n-gram; the permuted vectors are bound by
multiplication, and the n-gram vectors of a text are bundled by addition. A language's prototype bundles all its training
texts; a document goes to the prototype of greatest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, fresh, table

SYMBOLS = 64  # 0 is the space between words, 1-26 are a-z, the rest is shared by all other letters
DIMENSIONS = 512
SEED = 20240607
HELD_OUT, MODULUS = 2, 4
UNDETERMINED = "und"
#: A document whose cosine with its best language is under this is like none of them; the filter rejects it.
MIN_COSINE = 0.1


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = 1 + c - 97 if 97 <= c <= 122 else 27 + (c * 2654435761 >> 9) % (SYMBOLS - 27)
    return out


class NgramSpace:
    """Trigram ids of texts and the trigrams' vectors. Vectors are made on first use; there are at most 64 ** 3."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions)).astype(np.float32) * 2 - 1
        # one permutation, a rotation, applied twice, once and not at all
        self.letters = [np.roll(letters, shift, axis=1) for shift in (2, 1, 0)]
        self.symbols = symbol_table()
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.vectors = np.zeros((1024, dimensions), np.float32)
        self.used = 0

    def ids(self, text: str) -> np.ndarray:
        s = self.symbols[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = s[keep]
        return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The vectors of some trigrams, one row each."""
        a, b, c = ids // SYMBOLS**2, ids // SYMBOLS % SYMBOLS, ids % SYMBOLS
        return self.letters[0][a] * self.letters[1][b] * self.letters[2][c]

    def rows(self, ids: np.ndarray) -> np.ndarray:
        at = self.row[ids]
        if (at < 0).any():
            new = np.unique(ids[at < 0])
            while self.used + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[self.used : self.used + len(new)] = self.of(new)
            self.row[new] = np.arange(self.used, self.used + len(new), dtype=np.int32)
            self.used += len(new)
            at = self.row[ids]
        return at

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector; None if it has no letter."""
        ids = self.ids(text)
        if not len(ids) or not ids.any():
            return None
        counts = np.bincount(self.rows(ids), minlength=1)
        there = np.flatnonzero(counts)
        return counts[there].astype(np.float32) @ self.vectors[there]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of all languages: bundles of every training text. Rows with null text or language teach nothing.

    A partition adds its counts up and sends one vector for each language, so what is shuffled doesn't grow with its texts.
    """

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = NgramSpace(), {}
        for b in batches:
            for name, part in b.groupby("lang"):
                ids = [space.ids(t) for t in part["text"]]
                at = sums.setdefault(name, np.zeros(SYMBOLS**3, np.int64))
                at += np.bincount(np.concatenate(ids), minlength=SYMBOLS**3)
        for name, counts in sums.items():
            total, there = np.zeros(DIMENSIONS, np.float64), np.flatnonzero(counts)
            for k in range(0, len(there), 4096):
                some = there[k : k + 4096]
                total += counts[some] @ space.of(some).astype(np.float64)
            yield pd.DataFrame({"lang": name, "dimension": np.arange(DIMENSIONS), "value": total})

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInPandas(bundles, "lang string, dimension int, value double").groupBy("lang", "dimension").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dimensions rows
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["dimension"]] = r["value"]
    return {k: (v / (np.linalg.norm(v) or 1.0)).astype(np.float32) for k, v in sorted(out.items())}


def identified(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """A struct column (lang_pred, score): the language of greatest cosine (ties: first by name), and that cosine."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS), np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        space = NgramSpace()
        for texts in batches:
            pred, score = [], []
            for t in texts:
                v = space.bundle(t) if t else None
                if v is None or not names:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                cos = matrix @ v / max(float(np.linalg.norm(v)), 1e-9)
                k = int(np.argmax(cos))
                pred.append(names[k])
                score.append(min(1.0, max(0.0, float(cos[k]))))
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return best(text)


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    return train(docs.where(crc_remainder("doc_id", MODULUS) != HELD_OUT))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. Null texts and texts without a letter are ``und`` with
    score 0; a null id counts as empty text in the split; repeated rows give repeated results; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = docs.select("doc_id", (crc_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), identified(F.col("text"), learn(docs)).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with their columns; those without a letter or like no language go, null and empty
    texts among them. Among equally near languages the first by name counts, so ties stay; repeated rows stay or go
    together; rows of a null language teach nothing; if no language is learned, or the table is empty, there are no rows.
    """
    found = fresh(docs, "language")
    kept = docs.withColumn(found, identified(F.col("text"), learn(docs)))
    return kept.where((F.col(f"{found}.lang_pred") != UNDETERMINED) & (F.col(f"{found}.score") >= MIN_COSINE)).select(docs.columns)
