"""The pivot index against a plain search, and how much of it is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vector
from tessera.sources import vector_index


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "id", "distance", "rank").collect()))


def clustered(n=2000, width=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 10
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width))).round(3)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equals_a_plain_search(spark, tmp_path, metric, monkeypatch):
    x = clustered(600)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[i].tolist()) for i in range(40)]  # copies: ties go to the smaller id
    data += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, 2.0]), (2003, [float("nan")] * 8), (None, x[0].tolist()), (2004, [1e6] * 8)]
    base = spark.createDataFrame(data, "id long, v array<float>").repartition(4)
    asked = base.where("id % 20 = 0 or id >= 2000")
    found = vector_index.write_vectors(base, "id", "v", str(tmp_path / "i"), metric)
    want = rows_of(vector.vector_topk(asked.where("size(v) = 8"), base, "id", "v", 6, metric))
    assert rows_of(found.search(asked.where("size(v) = 8"), "id", "v", 6)) == want
    assert [r["id"] for r in found.search(asked.where("id = 2002"), "id", "v", 3).collect()] == [2002]
    monkeypatch.setattr(vector_index, "PASS_NUMBERS", 100)
    assert rows_of(found.search(asked.where("size(v) = 8"), "id", "v", 6)) == want
    assert found.search(asked.where("id < 0"), "id", "v", 3).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_most_vectors_are_not_read(spark, tmp_path, metric):
    base = spark.createDataFrame([(f"r{i:04}", v.tolist()) for i, v in enumerate(clustered())], "id string, v array<double>")
    asked = base.where(F.xxhash64("id") % 40 == 0)
    found, seen = vector_index.write_vectors(base, "id", "v", str(tmp_path / "i"), metric), []
    assert rows_of(found.search(asked, "id", "v", 5, seen)) == rows_of(vector.vector_topk(asked, base, "id", "v", 5, metric))
    assert len(seen) == 1 and seen[0] < 0.5


def test_few_rows_and_none(spark, tmp_path):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    found = vector_index.write_vectors(base, "id", "v", str(tmp_path / "few"))
    assert [tuple(r) for r in found.search(base, "id", "v", 5).orderBy("query_id", "rank").collect()] == [(1, 1, 0.0, 1), (1, 2, 1.414214, 2), (2, 2, 0.0, 1), (2, 1, 1.414214, 2)]
    none = vector_index.write_vectors(base.where("id = 0"), "id", "v", str(tmp_path / "none"))
    assert none.search(base, "id", "v", 5).count() == 0
    assert vector_index.read_vectors(spark, str(tmp_path / "nothing")) is None


def test_few_distances_are_held_at_once(spark, tmp_path, monkeypatch):
    """Blocks of questions give what all at once give, and no more distances than allowed are made at once."""
    r = np.random.default_rng(5)
    base = spark.createDataFrame([(k, [float(x) for x in r.integers(0, 4, 3)]) for k in range(300)], "id long, v array<double>")
    for metric in ("l2", "cosine"):
        found = vector_index.write_vectors(base, "id", "v", str(tmp_path / metric), metric)
        asked = base.where("id % 2 = 0")
        want = sorted(map(tuple, found.search(asked, "id", "v", 4).collect()))
        q = np.array([row["v"] for row in asked.orderBy("id").collect()])
        made = []
        monkeypatch.setattr(vector_index.np, "partition", lambda d, *a, f=np.partition, **b: made.append(d.size) or f(d, *a, **b))
        monkeypatch.setattr(vector_index, "DISTANCES", 500)
        monkeypatch.setattr(vector_index, "HELD", 700)
        tasks = []
        plan = np.ones((len(q), len(found.clusters)), bool)
        rows = found.rows.toPandas()
        monkeypatch.setattr(type(found.rows), "mapInPandas", lambda self, f, schema: tasks.append(f) or self)
        found._read([2 * k for k in range(len(q))], vector_index._scaled(q, metric), plan, None, 4, ("long", "long"))
        monkeypatch.undo()
        monkeypatch.setattr(vector_index, "HELD", 700)
        monkeypatch.setattr(vector_index, "DISTANCES", 500)
        monkeypatch.setattr(vector_index.np, "partition", lambda d, *a, f=np.partition, **b: made.append(d.size) or f(d, *a, **b))
        got = next(tasks[0](iter([rows])))
        monkeypatch.undo()
        assert made and max(made) <= 500
        got["rank"] = got.sort_values(["distance", "id"]).groupby("query_id").cumcount() + 1
        assert sorted(got[got["rank"] <= 4].itertuples(index=False, name=None)) == want
