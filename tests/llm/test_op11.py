"""Hard negatives against a plain search of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import same
from tessera.llm import hardneg


def brute(rows):
    """The contract in plain Python, on (id, label, vector of whole numbers, is_anchor)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    width = max((len(r[2]) for r in rows), default=0)
    x = [[*map(int, r[2]), *[0] * (width - len(r[2]))] for r in rows]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, a in enumerate(rows):
        if not a[3]:
            continue
        found = [(-sum(p * q for p, q in zip(x[k], x[j])), last(r[0]), r) for j, r in enumerate(rows) if j != k]
        positives = sorted((f for f in found if f[2][1] == a[1]), key=lambda f: f[:2])[:5]
        for score, _, p in positives:
            window = sorted((f for f in found if f[2][1] != a[1] and 80 * -score <= 100 * -f[0] <= 100 * -score), key=lambda f: f[:2])[:5]
            out += [(a[0], p[0], k, f[2][0], -score, -f[0]) for k, f in enumerate(window, 1)]
    return sorted(out, key=repr)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "id long, label int, vector array<long>, is_anchor boolean").withColumn("row", F.lit("x")).withColumn("cell", F.lit("x")).repartition(3)
    out = hardneg.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def table(seed, n=500, width=6, spread=60):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (12, width))
    x = centres[rng.integers(0, 12, n)] + rng.integers(-spread, spread, (n, width))
    return [(i, int(rng.integers(0, 4)), v.tolist(), i % 20 == 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("group", [4, 10_000])
def test_equals_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(hardneg, "GROUP", group)
    monkeypatch.setattr(hardneg, "SLICE", 90)
    monkeypatch.setattr(hardneg, "PIVOTS", 16)
    rows = table(1)
    # lengths of another order, equal vectors, repeated rows, other widths, zero vectors, labels of few rows
    rows += [(1000 + i, i % 3, [v * 40 for v in r[2]], i % 7 == 0) for i, r in enumerate(rows[:30])]
    rows += [(2000 + i, r[1], r[2], False) for i, r in enumerate(rows[:40])] + rows[:25]
    rows += [(3000, 0, [], True), (3001, 1, [5], True), (3002, 7, [1, 2], True), (3003, 8, [1] * 6, True), (3004, 8, [2] * 6, True), (None, 0, rows[0][2], None), (3005, None, [1], True), (3006, 1, None, True), (3007, 2, [0] * 6, True)]
    assert mined(spark, rows) == brute(rows)


def test_bounds_spare_far_rows(spark, monkeypatch):
    """Where clusters lie apart, most rows go to no group but their own cluster's."""
    monkeypatch.setattr(hardneg, "GROUP", 8)
    monkeypatch.setattr(hardneg, "PIVOTS", 24)
    rng = np.random.default_rng(2)
    centres = np.eye(8, dtype=int) * 1000
    kind = rng.integers(0, 8, 800)
    x = centres[kind] + rng.integers(-9, 9, (800, 8))
    rows = [(i, int(kind[i] * 2 + i % 2), v.tolist(), i % 10 == 0) for i, v in enumerate(x)]
    sent = []
    plain = hardneg.HardNegatives._joined

    def counted(self, table, anchors, route, local):
        found = [route(b, self.space.rows(hardneg.matrix(b["vector"], self.width))) for b in [table.toPandas()]]
        sent.append(float(np.mean(found[0])))
        return plain(self, table, anchors, route, local)

    monkeypatch.setattr(hardneg.HardNegatives, "_joined", counted)
    assert mined(spark, rows) == brute(rows)
    assert len(sent) == 2 and max(sent) < 0.35


def test_no_anchor_and_no_row(spark):
    assert mined(spark, [(1, 1, [1, 2], False)]) == [] == mined(spark, [])


def test_large_scores_are_exact(spark):
    rows = [(i, i % 2, [2**29 + i, -(2**28) - 3 * i, 7], i == 0) for i in range(40)]
    assert mined(spark, rows) == brute(rows)


def test_quantized(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan"), 1.0],), ([None, 1.0],), ([float("-inf")],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(hardneg.quantized("v")).collect()] == [[128, -1], None, None, None, None, []]


def test_query_equals_sql(spark, sf):
    same(hardneg.op11_hard_negatives(spark, sf), sf, hardneg.SQL)
