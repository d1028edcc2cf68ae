"""A kept vector index: rows lie in folders by their nearest pivot, with their distance to it, and a question reads only the
folders and the span of distances in which, by the triangle inequality, one of its nearest rows can lie.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.topk import top
from ..session import shared_folder
from .files import exists
from .index import listed

#: Rows that the pivots are fitted on, at most; pivots, at least and at most; rounds of fitting.
SAMPLE, FEW, MANY, ROUNDS, SEED = 8_192, 16, 256, 8, 7
#: Numbers in the vectors of the questions that one pass takes.
PASS_NUMBERS = 4_000_000
#: Distances that a task holds at once, and rows that it keeps before it cuts them to the best of each question.
DISTANCES, HELD = 1_000_000, 1_000_000
#: Distances are rounded to 6 digits; two that round alike differ by less.
MARGIN = 2e-6
#: The folder of rows that no pivot bounds: vectors of another width, and zero vectors by cosine.
APART = -1


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def fitted_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Means of groups of near rows, by a few rounds of moving each mean to the middle of its rows."""
    r = np.random.default_rng(SEED)
    pivots = sample[r.choice(len(sample), min(number, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = distances(sample, pivots).argmin(1)
        counts = np.bincount(own, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return np.unique(pivots, axis=0)


@dataclass
class VectorIndex:
    """``rows`` is (id, v, far, cluster), ``clusters`` (cluster, n, near, far): how many rows a folder holds, and the least and
    greatest of their distances to its pivot.
    """

    rows: DataFrame
    clusters: pd.DataFrame
    pivots: np.ndarray
    metric: str

    def _bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distance [questions, clusters] to each folder's pivot, and how near one of its rows can be at least; zero for
        rows apart.
        """
        number = self.clusters["cluster"].to_numpy()
        far = distances(q, self.pivots)[:, np.maximum(number, 0)] if q.shape[1] == self.pivots.shape[1] else np.zeros((len(q), len(number)))
        least = np.maximum(np.maximum(far - self.clusters["far"].to_numpy(), self.clusters["near"].to_numpy() - far), 0)
        zero = (q * q).sum(1) < 0.25 if self.metric == "cosine" else np.zeros(len(q), bool)  # a zero question is at one distance from all
        least[zero] = 0
        least[:, number == APART] = 0
        if q.shape[1] != self.pivots.shape[1]:
            least[:, number != APART] = np.inf  # rows of another width are no neighbours
        return far, least

    def plan(self, q: np.ndarray, reach: np.ndarray | None, k: int) -> np.ndarray:
        """Which folders [questions, clusters] to read: the nearest that hold ``k`` rows, or, with a reach, all within it."""
        far, least = self._bounds(q)
        if reach is not None:
            return least <= reach[:, None] * (1 + 1e-9) + MARGIN
        order = np.argsort(np.where(np.isfinite(least), far, np.inf), axis=1, kind="stable")
        before = np.cumsum(self.clusters["n"].to_numpy()[order], axis=1) - self.clusters["n"].to_numpy()[order]
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & np.isfinite(least)

    def share(self, plans: list[np.ndarray]) -> float:
        """The share of all pairs of a question and a vector that plans read."""
        n = self.clusters["n"].to_numpy()
        return float(sum((p * n).sum() for p in plans) / max(1, n.sum() * len(plans[0])))

    def _read(self, questions: list, q: np.ndarray, plan: np.ndarray, reach: np.ndarray | None, k: int, kinds: tuple[str, str]) -> DataFrame:
        """(query_id, id, distance) of each task's best ``k`` rows of each question, from the folders of the plan."""
        number = self.clusters["cluster"].to_numpy()
        asked = {int(number[c]): np.flatnonzero(plan[:, c]) for c in np.flatnonzero(plan.any(0))}
        metric = self.metric
        rows = self.rows.where(F.col("cluster").isin([*asked]))
        if reach is not None:  # a row's distance to its pivot lies within the reach of a question's
            far, _ = self._bounds(q)
            span = [(int(number[c]), plan[:, c]) for c in np.flatnonzero(plan.any(0))]
            inside = F.lit(False)
            for c, own in span:
                at = np.flatnonzero(number == c)[0]
                low, high = (far[own, at] - reach[own]).min(), (far[own, at] + reach[own]).max()
                inside = inside | ((F.col("cluster") == c) & ((F.col("cluster") == APART) | F.col("far").between(float(low) - 1e-5, float(high) + 1e-5) | F.lit(metric == "cosine" and bool(((q[own] ** 2).sum(1) < 0.25).any()))))
            rows = rows.where(inside)
        names = np.array(questions)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts: list[tuple] = []
            held = kept = 0

            def best() -> tuple:
                who, ids, d = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((np.unique(ids, return_inverse=True)[1], d, who))
                who = who[order]
                order = order[np.arange(len(who)) - np.searchsorted(who, who) < k]
                return np.concatenate([p[0] for p in parts])[order], ids[order], d[order]

            for b in batches:
                width = b["v"].map(len)
                for (c, w), part in b.groupby(["cluster", width], sort=False):
                    own = asked.get(int(c), np.zeros(0, int))
                    if w != q.shape[1] or not len(own):
                        continue
                    x = np.stack(part["v"].to_list()).astype(np.float64)
                    x, ids = _scaled(x, metric), part["id"].to_numpy()
                    size = max(1, DISTANCES // len(x))
                    for some in (own[s : s + size] for s in range(0, len(own), size)):
                        if metric == "cosine":
                            d = np.round(1 - q[some] @ x.T, 6) + 0.0
                        else:
                            d = np.empty((len(some), len(x)))
                            for row, one in zip(d, q[some]):
                                row[:] = np.sqrt(((x - one) ** 2).sum(1))
                            d = np.round(d, 6)
                        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                        at, r = np.nonzero(d <= last[:, None])
                        parts.append((some[at], ids[r], d[at, r]))
                        held += len(at)
                        if held > max(HELD, 2 * kept):  # at most k of each question stay
                            parts[:] = [best()]
                            held = kept = len(parts[0][0])
            if parts:
                who, ids, d = best()
                yield pd.DataFrame({"query_id": names[who], "id": ids, "distance": d})

        return rows.mapInPandas(run, f"query_id {kinds[0]}, id {kinds[1]}, distance double")

    def search(self, queries: DataFrame, query_id: str, vector: str, k: int = 5, seen: list | None = None) -> DataFrame:
        """(query_id, id, distance, rank): the ``k`` nearest rows of each question, by distance rounded to 6 digits, then id.

        First the nearest folders that hold ``k`` rows are read: their k-th distance is a reach within which the others must
        come. Then the folders within reach are read, and in them rows at distances from the pivot that the reach allows.
        ``seen`` is given the share of vectors that each pass reads.
        """
        spark = queries.sparkSession
        kinds = queries.schema[query_id].dataType.simpleString(), self.rows.schema["id"].dataType.simpleString()
        asked = queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
        asked = asked.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        passes = math.ceil((asked.agg(F.sum(F.size("v"))).first()[0] or 0) / PASS_NUMBERS)
        found = spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, distance double")
        for p in range(passes if len(self.clusters) else 0):
            some = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
            rows = some.collect()  # a pass's questions
            for width in sorted({len(r["v"]) for r in rows}):
                own = [r for r in rows if len(r["v"]) == width]
                names = [r["query_id"] for r in own]
                q = _scaled(np.array([r["v"] for r in own], np.float64).reshape(len(own), width), self.metric)
                first = self.plan(q, None, k)
                near = top(self._read(names, q, first, None, k, kinds), "query_id", [F.asc("distance"), F.asc("id")], k)
                got = pd.DataFrame([tuple(r) for r in near.collect()], columns=near.columns)  # k rows of each question of a pass
                last = got[got["rank"] == k].set_index("query_id")["distance"]
                reach = np.array([last.get(n, np.inf) for n in names], np.float64)
                if self.metric == "cosine":  # unit vectors at cosine distance d are sqrt(2 d) apart
                    reach = np.sqrt(np.maximum(2 * (reach + MARGIN), 0))
                second = self.plan(q, reach, k) & ~first
                if seen is not None:
                    seen.append(self.share([first, second]))
                found = found.unionByName(spark.createDataFrame(got[["query_id", "id", "distance"]], found.schema)) if len(got) else found
                if second.any():
                    found = found.unionByName(self._read(names, q, second, reach, k, kinds))
        return top(found, "query_id", [F.asc("distance"), F.asc("id")], k)


def write_vectors(base: DataFrame, id_col: str, vector: str, root: str, metric: str = "l2") -> VectorIndex:
    """Build an index of the rows (id, vector) and write it. Rows of a null id, and vectors that are null or hold null or
    non-finite numbers, are no neighbours and are left out. Pivots are fitted on a bounded sample; every row is indexed.
    """
    spark = base.sparkSession
    rows = base.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    width, n = (widths[0]["w"], widths[0]["n"]) if widths else (0, 0)
    sample = rows.where(F.size("v") == width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    sample = _scaled(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), width), metric)
    pivots = fitted_pivots(sample, int(min(MANY, max(FEW, math.sqrt(n) / 2)))) if len(sample) else np.zeros((0, width))

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            far, cluster = np.zeros(len(b)), np.full(len(b), APART, np.int32)
            at = np.flatnonzero(b["v"].map(len).to_numpy() == width)
            if len(at) and len(pivots):
                x = np.stack(b["v"].iloc[at].to_list()).astype(np.float64)
                if metric == "cosine":
                    at, x = at[(x * x).sum(1) > 0], x[(x * x).sum(1) > 0]
                d = distances(_scaled(x, metric), pivots)
                cluster[at] = d.argmin(1)
                far[at] = d[np.arange(len(at)), cluster[at]]
            yield b.assign(far=far, cluster=cluster)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, v {rows.schema['v'].dataType.simpleString()}, far double, cluster int"
    placed = rows.mapInPandas(assigned, schema)
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, n // 1_000_000))).alias("part")  # a folder of very many rows is dealt
    placed.withColumn("part", part).repartition("cluster", "part").drop("part").sortWithinPartitions("cluster", "far").write.mode("overwrite").partitionBy("cluster").parquet(f"{root}/rows")
    spark.createDataFrame([(p.tolist(),) for p in pivots], "pivot array<double>").coalesce(1).write.mode("overwrite").parquet(f"{root}/pivots")
    stats = _rows(spark, root, schema).groupBy("cluster").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far"))
    stats.coalesce(1).withColumn("metric", F.lit(metric)).withColumn("schema", F.lit(schema)).write.mode("overwrite").parquet(f"{root}/clusters")
    return read_vectors(spark, root)


def _rows(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/rows")


def read_vectors(spark: SparkSession, root: str) -> VectorIndex | None:
    """The index at a folder, or None if there is none, or its writing wasn't finished."""
    if not exists(spark, f"{root}/clusters/_SUCCESS"):
        return None
    found = spark.read.parquet(f"{root}/clusters").orderBy("cluster").collect()  # MANY + 1 rows
    clusters = pd.DataFrame([(r["cluster"], r["n"], r["near"], r["far"]) for r in found], columns=["cluster", "n", "near", "far"])
    pivots = np.array([r["pivot"] for r in spark.read.parquet(f"{root}/pivots").collect()], np.float64)
    schema = found[0]["schema"] if found else "id long, v array<double>, far double, cluster int"
    return VectorIndex(_rows(spark, root, schema), clusters, pivots.reshape(len(pivots), -1) if len(pivots) else np.zeros((0, 0)), found[0]["metric"] if found else "l2")


def kept_vectors(spark: SparkSession, path: str, id_col: str, vector: str, metric: str = "l2") -> VectorIndex:
    """The index of a parquet table's vectors, from the shared folder; built there first if the table has none or has changed."""
    named = hashlib.sha256(repr((sorted(listed(spark, path)), path, id_col, vector, metric)).encode()).hexdigest()[:24]
    root = f"{shared_folder(spark)}/vectors-{named}"
    found: Callable = lambda: read_vectors(spark, root)
    return found() or write_vectors(spark.read.parquet(path).select(id_col, vector), id_col, vector, root, metric)
