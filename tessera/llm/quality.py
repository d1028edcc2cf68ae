"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, fresh, labelled_sample, table

HELD_OUT, MODULUS = 0, 5
#: Bound of the fitting sample: about so many labelled texts of each class.
PER_CLASS = 6000
THRESHOLD = 0.3
LOWER, UPPER, OTHER_LETTER, DIGIT, SPACE, NEWLINE, STOP, PUNCTUATION, SYMBOL = range(9)
FEATURES = (
    "log_chars", "log_words", "mean_word", "spread_word", "lower", "upper", "other_letter", "digit", "space", "stop", "punctuation", "symbol",
    "repeated_mark", "distinct_words", "top_word", "top_three_words", "short_words", "long_words", "letterless_words", "marked_words", "log_lines", "mean_line", "distinct_lines", "distinct_chars", "non_ascii",
)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Character class of every code point."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = LOWER if ch.islower() else UPPER if ch.isupper() else OTHER_LETTER
        elif ch.isdigit():
            out[c] = DIGIT
        elif ch == "\n":
            out[c] = NEWLINE
        elif ch.isspace():
            out[c] = SPACE
        elif ch in ".!?":
            out[c] = STOP
        elif ch in ",;:'\"()-":
            out[c] = PUNCTUATION
    return out


def statistics(text: str, classes: np.ndarray) -> list[float]:
    """The values of FEATURES for a whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes[codes]
    n = len(codes)
    share = np.bincount(kinds, minlength=9) / n
    mark = kinds >= STOP
    repeated = float(np.count_nonzero(mark[1:] & (codes[1:] == codes[:-1]))) / n
    words = text.split()
    count = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    often = Counter(words)
    top = sorted(often.values())[-3:] or [0]
    lines = [x for x in text.split("\n") if x]
    # a word's first and last characters tell letterless and marked words
    edge = np.flatnonzero((kinds[:-1] < SPACE) & ((kinds[1:] == SPACE) | (kinds[1:] == NEWLINE))).size + (kinds[-1] < SPACE)
    letters = (kinds < DIGIT).astype(np.int8)
    gaps = np.flatnonzero((kinds == SPACE) | (kinds == NEWLINE))
    per_word = np.add.reduceat(letters, np.concatenate(([0], gaps))) if n else np.zeros(1)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), share[LOWER], share[UPPER], share[OTHER_LETTER], share[DIGIT], share[SPACE] + share[NEWLINE], share[STOP], share[PUNCTUATION], share[SYMBOL],
        repeated, len(often) / count, top[-1] / count, sum(top) / count, float((lengths <= 3).mean()), float((lengths >= 12).mean()), float((per_word == 0).mean()), 1.0 - edge / count, float(np.log1p(len(lines))), n / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), float(np.log1p(len(np.unique(codes)))), float((codes > 127).mean()),
    ]


class BoostedTrees:
    """Complete trees of one depth, in three arrays: feature and threshold of each inner node, value of each leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 2.0, least: float = 8.0) -> BoostedTrees:
        """Logistic loss; a split is the best of all bins of all features by gain, and both sides hold ``least`` rows."""
        n, width = x.shape
        share = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)) if n else 0.5
        base = float(np.log(share / (1 - share)))
        feature, threshold = np.zeros((trees, 2**depth - 1), np.int32), np.full((trees, 2**depth - 1), np.inf)
        leaf = np.zeros((trees, 2**depth))
        if not n or len(np.unique(y)) < 2:
            return cls(base, feature, threshold, leaf)
        weight = weight / weight.mean()
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
        score = np.full(n, base)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                nodes = 2**level
                gain, cut, chosen = np.full(nodes, 1e-6), np.full(nodes, -1), np.zeros(nodes, np.int64)
                for f in range(width):
                    at = node * bins + binned[:, f]
                    sums = [np.bincount(at, w, nodes * bins).reshape(nodes, bins).cumsum(1) for w in (g, h, None)]
                    gl, hl, nl = (s[:, :-1] for s in sums)
                    gt, ht, nt = (s[:, -1:] for s in sums)
                    value = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                    value[(nl < least) | (nt - nl < least)] = -1
                    best = value.argmax(1)
                    top = value[np.arange(nodes), best]
                    better = (top > gain) & (best < len(edges[f]))
                    gain[better], cut[better], chosen[better] = top[better], best[better], f
                first = nodes - 1
                for k in np.flatnonzero(cut >= 0):
                    feature[t, first + k], threshold[t, first + k] = chosen[k], edges[chosen[k]][cut[k]]
                node = 2 * node + (x[np.arange(n), feature[t, first + node]] > threshold[t, first + node])
            gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            leaf[t] = -rate * gs / (hs + penalty)
            score += leaf[t][node]
        return cls(base, feature, threshold, leaf)

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows, every = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        while inner:
            node = 2 * node + 1 + (x[rows, self.feature[every, node]] > self.threshold[every, node])
            inner //= 2
        return 1 / (1 + np.exp(-(self.base + self.leaf[every, node - self.feature.shape[1]].sum(1))))


def statistics_of(text: Column) -> Column:
    """The statistics of a text column as array<double>."""

    @F.pandas_udf("array<double>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classes = class_table()
        for texts in batches:
            yield pd.Series([statistics(t or "", classes) for t in texts])

    return values(text)


def learn(docs: DataFrame, labels: DataFrame) -> BoostedTrees:
    """Fit on a bounded, stratified sample of labelled texts (PER_CLASS); weights undo the stratification."""
    sample, weights = labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, PER_CLASS)
    rows = sample.select("doc_id", "y", statistics_of(F.col("text")).alias("x")).collect()  # at most about 2 * PER_CLASS rows of 25 numbers
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    return BoostedTrees.fit(x, y, np.array([weights[r["y"]] for r in rows], dtype=np.float64))


def scored(text: Column, model: BoostedTrees) -> Column:
    """The probability that a whole text is of quality 1, as a double column; null text counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        classes = class_table()
        for texts in batches:
            x = np.array([statistics(t or "", classes) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    return score(text)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Null and empty texts are scored as texts of no words; a
    null id counts as empty text in the split; repeated rows give repeated results; with no labels every score is 0.5.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (crc_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"), scored(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored THRESHOLD or more, with their columns; the rest go. Null and empty texts are scored as texts of no
    words; ties at the threshold stay; repeated rows stay or go together; with no labels every score is 0.5, so all stay;
    an empty table gives no rows.
    """
    model = learn(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return docs.withColumn(score, scored(F.col("text"), model)).where(F.col(score) >= THRESHOLD).select(docs.columns)
