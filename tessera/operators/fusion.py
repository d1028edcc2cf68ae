"""Rank fusion, merging of several questions' results, order-keeping deduplication and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topk import top

RRF_CONSTANT = 60


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows of one key the first by ``order``; unlike dropDuplicates the choice is fixed."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def reciprocal_rank_fusion(branches: list[DataFrame], weights: list[float], k: int | None = None, constant: int = RRF_CONSTANT) -> DataFrame:
    """(query_id, id, score, branch, rank) of ranked branches (query_id, id, rank): the sum of weight / (rank + constant).

    Equal scores keep the order of the branches, then of ranks, as a stable sort of the joined lists does.
    """
    parts = None
    for n, (df, w) in enumerate(zip(branches, weights)):
        part = df.select("query_id", "id", F.lit(n).alias("branch"), F.col("rank").alias("place"), (F.lit(float(w)) / (F.col("rank") + constant)).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("branch", "place")).alias("first"))
    fused = fused.select("query_id", "id", "score", F.col("first.branch").alias("branch"), F.col("first.place").alias("place"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "branch", "place")
    out = fused.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def hybrid(branches: list[DataFrame | None], weights: list[float], k: int | None = None) -> DataFrame:
    """Rank fusion of the branches (query_id, id, rank) that there are. A branch without an index is None, and one that
    found nothing for a question takes no part in it; with one branch left its own order holds.
    """
    there = [(b, w) for b, w in zip(branches, weights) if b is not None]
    if not there:
        raise ValueError("there is neither a vector nor a lexical index")
    return reciprocal_rank_fusion([b for b, _ in there], [w for _, w in there], k)


def merge_queries(results: DataFrame, content: str) -> DataFrame:
    """Results (query_id, sub_index, rank, ...) of a question's parts in order of the parts, each content once: the first."""
    keyed = results.withColumn("__key", F.regexp_replace(content, r"^\s+|\s+$", ""))
    kept = keep_first(keyed, ["query_id", "__key"], ["sub_index", "rank"]).drop("__key")
    w = Window.partitionBy("query_id").orderBy("sub_index", "rank")
    return kept.withColumn("position", F.row_number().over(w))


def rerank(candidates: DataFrame, score: Column | None, k: int = 10) -> DataFrame:
    """The best ``k`` candidates (query_id, position, ...) of each question by a model's score; without a score, or where
    it is null for all of a question, the first ``k`` in their own order.
    """
    scored = candidates.withColumn("rerank_score", score.cast("double") if score is not None else F.lit(None).cast("double"))
    return top(scored, "query_id", [F.desc_nulls_last("rerank_score"), F.asc("position")], k, "rerank_rank")


def first_filled(*columns: str) -> Column:
    """The first of some array columns that isn't empty."""
    return F.coalesce(*(F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.col(c)) for c in columns))
