"""The best rows of each question, kept task by task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Questions that are scored at once against a batch, and those that one pass over the base takes.
BLOCK, PASS = 1024, 32_768


def top(rows: DataFrame, by: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1; the optimizer cuts each partition to ``k`` before it is shuffled."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def driven(rows: DataFrame, count: int) -> Iterator[Row]:
    """The rows of ``count`` questions on the driver: at once if one pass takes them, else a partition at a time."""
    return iter(rows.collect()) if count <= PASS else rows.toLocalIterator()


class Best:
    """The ``k`` least (score, id) of each question, over all batches met."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.score = np.full((questions, k), np.inf)
        self.id: np.ndarray | None = None

    def add(self, first: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores [questions, rows] of the questions from ``first`` on; a score of infinity is none."""
        order = np.argsort(ids, kind="stable")
        score, ids = score[:, order], ids[order]
        near = np.argsort(score, axis=1, kind="stable")[:, : self.k]  # ties go to the smaller id
        if self.id is None:
            self.id = np.zeros(self.score.shape, ids.dtype) if ids.dtype != object else np.full(self.score.shape, ids[0], object)
        own = slice(first, first + len(score))
        both_score = np.concatenate([self.score[own], np.take_along_axis(score, near, 1)], axis=1)
        both_id = np.concatenate([self.id[own], ids[near]], axis=1)
        place = np.unique(both_id, return_inverse=True)[1].reshape(both_id.shape)
        keep = np.lexsort((place, both_score), axis=1)[:, : self.k]
        self.score[own], self.id[own] = np.take_along_axis(both_score, keep, 1), np.take_along_axis(both_id, keep, 1)

    def rows(self, questions: np.ndarray) -> pd.DataFrame:
        q, at = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"query_id": questions[q], "id": self.id[q, at], "score": self.score[q, at]})


def best_rows(base: DataFrame, questions: list, kernel: Callable, k: int, query_type: str, id_type: str) -> DataFrame:
    """(query_id, id, score) of the least ``k`` scores of each question in each task. ``kernel(batch)`` gives ids and a
    function from a range of questions to their scores [questions, ids].
    """
    asked = np.array(questions) if questions else np.zeros(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(asked), k)
        for b in batches:
            ids, score = kernel(b)
            for first in range(0, len(asked) if len(ids) else 0, BLOCK):
                best.add(first, score(first, min(first + BLOCK, len(asked))), ids)
        if best.id is not None and len(asked):
            yield best.rows(asked)

    return base.mapInPandas(run, f"query_id {query_type}, id {id_type}, score double")
