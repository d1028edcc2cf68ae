"""Exact nearest neighbours, blocks of questions against batches of rows."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import PASS, best_rows, driven, top


def _kernel(vectors: list, metric: str):
    q = np.array(vectors, dtype=np.float64) if vectors else np.zeros((0, 1))
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def score(batch: pd.DataFrame):
        b = batch[batch["v"].map(lambda x: x is not None and len(x) == q.shape[1])]
        if not len(b):
            return b["id"].to_numpy(), None
        x = np.stack(b["v"].to_list()).astype(np.float64)
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        def of(first: int, last: int) -> np.ndarray:
            if metric == "cosine":
                return np.round(1 - q[first:last] @ x.T, 6) + 0.0
            return np.round(np.stack([np.sqrt(((x - row) ** 2).sum(1)) for row in q[first:last]]), 6)

        return b["id"].to_numpy(), of

    return score


def vector_topk(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int = 5, metric: str = "l2") -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` nearest rows of each question by Euclidean or cosine distance, rounded to
    6 digits, ties to the smaller id. Rows of a null id or vector, or of another width, are no neighbours.

    PASS questions at a time are sent to the rows' tasks. A task keeps the best ``k`` of all its rows for each question,
    and only these are shuffled, never all pairs.
    """
    asked = queries.select(id_col, vector).where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    asked = driven(asked, asked.count())
    kind = base.schema[id_col].dataType.simpleString()
    rows = base.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    found = None
    while (some := [(r[0], r[1]) for r in islice(asked, PASS)]) or found is None:
        part = best_rows(rows, [i for i, _ in some], _kernel([v for _, v in some], metric), k, kind, kind)
        found = part if found is None else found.unionByName(part)
        if not some:
            break
    return top(found.withColumnRenamed("score", "distance"), "query_id", [F.asc("distance"), F.asc("id")], k)
