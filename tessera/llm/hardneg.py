"""Hard negatives by an exact join over Voronoi cells.

Inner products become distances when each row gets one more component, sqrt(M^2 - |x|^2) for the greatest length M, and each
anchor a zero: then |q - s|^2 = |q|^2 + M^2 - 2 qs, so the best scores are the nearest rows. Rows and anchors belong to the
nearest of some pivots. From the rows nearest to each pivot follows how far an anchor of a cell must look, and a row goes
only to the groups of cells in whose reach it lies. Groups are joined exactly, slice by slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores from 80 to 100 hundredths of the positive.
LOW, HIGH = 80, 100
PIVOTS, SEED = 64, 41
#: Anchors of a group at most, rows of a slice at least and slices at most, anchors that are scored at once.
GROUP, SLICE, SLICES, BLOCK = 16_384, 4_096, 1_024, 2_048
#: Bounds are widened by this share against rounding.
SLACK = 1e-9
NO_ID = 2**63 - 1


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one counts as ending in zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Space:
    """Pivots, and distances to them with one more component against unequal lengths."""

    def __init__(self, pivots: list[list[int]], width: int, longest: int):
        self.width, self.longest = width, float(longest)  # longest: M^2
        self.pivots = matrix(pd.Series(pivots, dtype=object), width).astype(np.float64)
        self.last = np.sqrt(np.maximum(self.longest - (self.pivots**2).sum(1), 0))
        self.between = self._distance(self.pivots, self.last)

    def _distance(self, x: np.ndarray, last: np.ndarray | float) -> np.ndarray:
        square = ((x**2).sum(1) + last**2)[:, None] + self.longest - 2 * (x @ self.pivots.T + np.multiply.outer(np.broadcast_to(last, len(x)), self.last))
        return np.sqrt(np.maximum(square, 0))

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return self._distance(x, np.sqrt(np.maximum(self.longest - (x**2).sum(1), 0)))

    def anchors(self, x: np.ndarray) -> np.ndarray:
        return self._distance(x.astype(np.float64), 0.0)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**52:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if most < 2**62:
        return a @ b.T
    raise ValueError("scores go beyond 64 bits")


class Best:
    """The first ``k`` (score descending, id ascending) of each slot."""

    def __init__(self, slots: int, k: int):
        self.k, self.waiting = k, 0
        self.least = np.full(slots, -(2**63), np.int64)  # a slot that is full takes nothing below
        self.parts = [np.zeros((3, 0), np.int64)]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[slot]
        self.parts.append(np.stack([slot[good], score[good], ids[good]]))
        self.waiting += int(good.sum())
        if self.waiting > 4 * self.k * len(self.least):
            self.compact()

    def compact(self) -> np.ndarray:
        """Rows slot, score, id, in order."""
        kept = np.concatenate(self.parts, axis=1)
        kept = kept[:, np.lexsort((kept[2], -kept[1], kept[0]))]
        place = np.arange(kept.shape[1]) - np.searchsorted(kept[0], kept[0])
        kept, place = kept[:, place < self.k], place[place < self.k]
        self.parts, self.waiting = [kept], 0
        full = place == self.k - 1
        self.least[kept[0, full]] = kept[1, full]
        return kept


class Positives:
    """The best rows of the anchors' own label."""

    out = "anchor long, id long, score long"

    def __init__(self, anchors: pd.DataFrame, width: int):
        self.anchors, self.vectors = anchors["row"].to_numpy(), matrix(anchors["vector"], width)
        self.codes = {label: k for k, label in enumerate(anchors["label"].unique())}
        self.labels = anchors["label"].map(self.codes).to_numpy()
        self.best = Best(len(anchors), POSITIVES)

    def add(self, rows: pd.DataFrame) -> None:
        x, ids, number = matrix(rows["vector"], self.vectors.shape[1]), rows["id"].to_numpy(), rows["row"].to_numpy()
        label = np.array([self.codes.get(v, -1) for v in rows["label"]])
        for s in range(0, len(self.anchors), BLOCK):
            own = slice(s, s + BLOCK)
            found = scores(self.vectors[own], x)
            wanted = (self.labels[own, None] == label) & (self.anchors[own, None] != number) & (found >= self.best.least[own, None])
            a, r = np.nonzero(wanted)
            self.best.add(a + s, found[a, r].astype(np.int64), ids[r])

    def rows(self) -> pd.DataFrame:
        slot, score, ids = self.best.compact()
        return pd.DataFrame({"anchor": self.anchors[slot], "id": ids, "score": score})


class Negatives(Positives):
    """For each positive of an anchor, the best rows of other labels in its window of scores."""

    out = "anchor long, place int, id long, score long"

    def __init__(self, anchors: pd.DataFrame, width: int):
        super().__init__(anchors, width)
        most = np.zeros((len(anchors), POSITIVES), np.int64)
        for k, own in enumerate(anchors["positive"]):
            most[k, : len(own)] = own
        self.high = most
        self.low = -((-LOW * most) // HIGH)
        none = np.arange(POSITIVES) >= anchors["positive"].map(len).to_numpy()[:, None]
        none |= most < 0  # a window below a negative score is empty
        self.low[none], self.high[none] = 1, 0
        self.least, self.most = np.where(none, 2**62, self.low).min(1), np.where(none, -1, self.high).max(1)
        self.best = Best(len(anchors) * POSITIVES, NEGATIVES)

    def add(self, rows: pd.DataFrame) -> None:
        x, ids = matrix(rows["vector"], self.vectors.shape[1]), rows["id"].to_numpy()
        label = np.array([self.codes.get(v, -1) for v in rows["label"]])
        for s in range(0, len(self.anchors), BLOCK):
            own = slice(s, s + BLOCK)
            found = scores(self.vectors[own], x)
            a, r = np.nonzero((self.labels[own, None] != label) & (found >= self.least[own, None]) & (found <= self.most[own, None]))
            score = found[a, r].astype(np.int64)
            a = a + s
            for p in range(POSITIVES):
                good = (score >= self.low[a, p]) & (score <= self.high[a, p])
                self.best.add(a[good] * POSITIVES + p, score[good], ids[r[good]])

    def rows(self) -> pd.DataFrame:
        slot, score, ids = self.best.compact()
        return pd.DataFrame({"anchor": self.anchors[slot // POSITIVES], "place": (slot % POSITIVES).astype(np.int32), "id": ids, "score": score})


def packed(space: Space, counts: dict[int, int], most: int) -> tuple[dict[int, tuple[int, int]], int]:
    """The first group of each cell that has anchors, and its number of groups: neighbouring cells share a group of ``most``
    anchors at most, and a larger cell is cut in groups of its own. Also the number of all groups.
    """
    out, group, room, todo = {}, -1, 0, set(counts)
    here = min(todo, default=0)
    while todo:
        here = min(todo, key=lambda c: (space.between[here, c], c))  # the nearest cell that is left
        todo.remove(here)
        n = counts[here]
        if n > most:
            parts = -(-n // most)
            out[here], group, room = (group + 1, parts), group + parts, 0
        else:
            if n > room:
                group, room = group + 1, most
            out[here] = (group, 1)
            room -= n
    return out, group + 1


class HardNegatives:
    """A join of anchors with the rows of a table: (id, label, vector of whole numbers, is_anchor)."""

    def __init__(self, rows: DataFrame):
        number = F.monotonically_increasing_id().alias("row")
        kept = rows.where("label is not null and vector is not null").select(number, F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("label").cast("string").alias("label"), "vector", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
        self.table = saved(kept, "quantized")  # from here on a row keeps its number
        square = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
        one = self.table.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(square).alias("longest")).first()
        self.n, self.width = one["n"], one["width"] or 0
        if not self.n:
            return
        pivots = self.table.orderBy(F.xxhash64("row", F.lit(SEED)), "row").limit(PIVOTS).select("vector").collect()  # PIVOTS rows
        self.space = Space([r[0] for r in pivots], self.width, one["longest"])
        self.slices = min(SLICES, -(-self.n // SLICE))
        self.anchors = saved(self.table.where("is_anchor").drop("is_anchor").mapInPandas(self._celled(), "row long, id long, label string, vector array<long>, cell int, reach double, square double"), "anchors")
        counts = {r["cell"]: r["n"] for r in self.anchors.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # PIVOTS rows
        self.groups, self.group_count = packed(self.space, counts, GROUP)

    def _celled(self) -> Callable:
        space = self.space

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = matrix(b["vector"], space.width)
                far = space.anchors(x)
                cell = far.argmin(1)
                yield b.assign(cell=cell.astype(np.int32), reach=far[np.arange(len(b)), cell], square=(x.astype(np.float64) ** 2).sum(1))

        return run

    def limits_of_labels(self) -> DataFrame:
        """(label, cells, limits): how far from a cell's pivot a row of the label may lie and still be a positive of one of the cell's anchors.

        The POSITIVES + 1 rows of a label nearest to each pivot bound from above the distance of an anchor's last positive
        (one of them may be the anchor itself).
        """
        space = self.space

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: pd.DataFrame | None = None
            for b in batches:
                far = space.rows(matrix(b["vector"], space.width))
                cell = far.argmin(1)
                part = pd.DataFrame({"label": b["label"], "cell": cell.astype(np.int32), "far": far[np.arange(len(b)), cell]})
                kept = part if kept is None else pd.concat([kept, part])
                kept = kept.sort_values("far").groupby(["label", "cell"]).head(POSITIVES + 1)
                if len(kept) > 200_000:  # very many labels: what is there goes on
                    yield kept
                    kept = None
            if kept is not None:
                yield kept

        def limits(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            own, rows = part[part["reach"].notna()], part[part["reach"].isna()]
            out = []
            for cell, reach in zip(own["cell"], own["reach"]):
                bound = np.sort(space.between[cell][rows["cell"].to_numpy()] + rows["far"].to_numpy())
                out.append(2 * reach + bound[POSITIVES] if len(bound) > POSITIVES else np.inf)
            return pd.DataFrame({"label": [key[0]], "cells": [own["cell"].to_list()], "limits": [out]})

        near = self.table.select("label", "vector").mapInPandas(nearest, "label string, cell int, far double")
        w = Window.partitionBy("label", "cell").orderBy("far")
        near = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= POSITIVES + 1).drop("n").withColumn("reach", F.lit(None).cast("double"))
        reach = self.anchors.groupBy("label", "cell").agg(F.max("reach").alias("reach")).withColumn("far", F.lit(None).cast("double"))
        # a group is a label: PIVOTS * (POSITIVES + 2) rows at most
        both = near.unionByName(reach).join(reach.select("label").distinct(), "label", "left_semi")
        return saved(both.groupBy("label").applyInPandas(limits, "label string, cells array<int>, limits array<double>"), "limits")

    def _joined(self, rows: DataFrame, anchors: DataFrame, route: Callable, local: type[Positives]) -> DataFrame:
        """Rows go to the groups that ``route(batch, distances to pivots)`` [rows, cells with anchors] tells, anchors to their own; each
        slice of a group is joined by ``local``.
        """
        space, groups, slices, width = self.space, self.groups, self.slices, self.width
        cells = sorted(groups)

        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                met = route(b, space.rows(matrix(b["vector"], width)))
                to: dict[int, np.ndarray] = {}
                for k, c in enumerate(cells):
                    for g in range(groups[c][0], sum(groups[c])):
                        to[g] = to[g] | met[:, k] if g in to else met[:, k]
                for g, some in to.items():
                    if some.any():
                        yield b.loc[some, ["row", "id", "label", "vector"]].assign(group=g)

        sent = rows.mapInPandas(routed, "row long, id long, label string, vector array<long>, group int")
        sent = sent.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")).withColumn("is_row", F.lit(1))
        first = F.create_map(*(F.lit(v) for c in cells for v in (c, groups[c][0])))
        parts = F.create_map(*(F.lit(v) for c in cells for v in (c, groups[c][1])))
        asked = anchors.withColumn("group", (first[F.col("cell")] + F.pmod(F.xxhash64("row", F.lit(3)), parts[F.col("cell")])).cast("int"))
        asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("is_row", F.lit(0)).drop("cell", "reach", "square")
        dealt = sent.unionByName(asked, allowMissingColumns=True).withColumn("deal", F.col("group").cast("long") * slices + F.col("slice")).drop("group", "slice")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, waiting, join = None, [], None
            for b in batches:
                key = b["deal"].to_numpy() * 2 + b["is_row"].to_numpy()
                cut = np.flatnonzero(np.diff(key, prepend=-1, append=-1)) if len(b) else []
                for s, e in zip(cut[:-1], cut[1:]):
                    part, deal = b.iloc[s:e], key[s] // 2
                    if deal != now:
                        if join:
                            yield join.rows()
                        now, waiting, join = deal, [], None
                    if key[s] % 2 == 0:
                        waiting.append(part)
                    elif waiting or join:  # anchors come first
                        join = join or local(pd.concat(waiting, ignore_index=True), width)
                        waiting = []
                        join.add(part)
            if join:
                yield join.rows()

        return dealt.repartition("deal").sortWithinPartitions("deal", "is_row").mapInPandas(run, local.out)

    def positives(self) -> DataFrame:
        """(anchor, place from 0, id, score): the first POSITIVES other rows of each anchor's label."""
        cells = sorted(self.groups)
        at = {c: k for k, c in enumerate(cells)}

        def route(b: pd.DataFrame, far: np.ndarray) -> np.ndarray:
            met = np.zeros((len(b), len(cells)), bool)
            for k, (own, limits) in enumerate(zip(b["cells"], b["limits"])):
                own = np.asarray(own)
                met[k, [at[c] for c in own]] = far[k, own] <= np.asarray(limits) * (1 + SLACK) + SLACK
            return met

        rows = self.table.join(self.limits_of_labels(), "label")
        found = self._joined(rows, self.anchors, route, Positives)
        w = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc("id"))
        return found.withColumn("place", (F.row_number().over(w) - 1).cast("int")).where(F.col("place") < POSITIVES)

    def negatives(self, positives: DataFrame) -> DataFrame:
        """(anchor, place, id, score, rank from 1): the first NEGATIVES rows of other labels in the window of each positive."""
        chosen = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # POSITIVES of each
        anchors = saved(self.anchors.join(chosen, F.col("row") == F.col("anchor")).drop("anchor").withColumn("positive", F.col("p.score")).drop("p"), "asked")
        wanted = F.filter("positive", lambda s: s >= 0)
        longest = self.space.longest
        least, most = (f(wanted).cast("double") for f in (F.array_min, F.array_max))
        far = lambda score: F.sqrt(F.greatest(F.col("square") + longest - 2 * score, F.lit(0.0)))
        ends = anchors.where(F.size(wanted) > 0).groupBy("cell").agg(F.max(F.col("reach") + far(least * LOW / HIGH)).alias("out"), F.min(far(most) - F.col("reach")).alias("in"))
        ring = {r["cell"]: (r["in"], r["out"]) for r in ends.collect()}  # PIVOTS rows
        cells = sorted(self.groups)
        inner = np.array([ring.get(c, (np.inf, -np.inf))[0] for c in cells])
        outer = np.array([ring.get(c, (np.inf, -np.inf))[1] for c in cells])

        def route(b: pd.DataFrame, distance: np.ndarray) -> np.ndarray:
            own = distance[:, cells]
            slack = SLACK * (1 + np.abs(own))
            return (own <= outer + slack) & (own >= inner - slack)

        found = self._joined(self.table, anchors, route, Negatives)
        w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc("id"))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEGATIVES)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from rows (id, label, vector, is_anchor) whose
    vectors are arrays of whole numbers. Rows of a null label or vector take no part.
    """
    join = HardNegatives(rows)
    if not join.n or not join.groups:
        return rows.sparkSession.createDataFrame([], MINED)
    positives = saved(join.positives(), "positives")
    negatives = join.negatives(positives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    named = join.anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    asked = positives.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).join(named, "anchor")
    out = asked.join(negatives, ["anchor", "place"])
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")


def quantized(vector: str) -> Column:
    """floor(SCALE * x) of each component; null if one is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors in ``embeddings``. Rows with a null label, a null vector or a null or non-finite component
    take no part; repeated rows are rows of their own, as anchors too, so a copy of an anchor is its first positive; a null
    id is no anchor and comes last among equal scores; a shorter vector counts as ending in zeros; an anchor without a
    positive or a positive without a negative gives no row; an empty table gives none; other columns are not read.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), quantized("embedding").alias("vector"), (F.col("vec_id") % 100 == 0).alias("is_anchor"))
    return hard_negatives(rows)


SQL = """with r as (select row_number() over () n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.n, a.vec_id anchor_id, r.vec_id id, a.label = r.label same, list_inner_product(a.v, r.v)::bigint score from r a join r on a.n <> r.n where a.vec_id % 100 = 0),
p as (select n, anchor_id, id positive_id, score positive_score, row_number() over (partition by n order by score desc, id) k from s where same qualify k <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.n, k order by score desc, id))::int rank, id negative_id, positive_score, score negative_score
from p join s on s.n = p.n and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score qualify rank <= 5"""
