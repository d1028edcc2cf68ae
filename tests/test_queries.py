import pytest

from oracle import same
from tessera.plans import crawling, derived, evaluation, retrieval, splitting

MODULES = (retrieval, evaluation, crawling, derived, splitting)
ALL = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    same(ALL[name](spark, sf), sf, SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert ALL[name](spark, sf).count() > 0


def test_thin_pages_measures_every_text(spark, sf, tmp_path):
    whole = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "length(regexp_replace(text, '\\\\s+$', ''))").collect()}
    rows = crawling.thin_pages(spark, sf).collect()
    assert {r["doc_id"]: r["n_chars"] for r in rows} == {i: max(n + 2, 1) for i, n in whole.items()}

    odd = [(1, "intro\n# T\nabc \n"), (2, "x" * 200), (3, " # no"), (4, ""), (5, None), (7, "## T\nabc"), (8, "# T\n" + "y" * 130)]
    spark.createDataFrame(odd, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in crawling.thin_pages(spark, str(tmp_path)).collect()}
    assert got == {1: (True, 15, True, 7), 2: (False, 202, True, 0), 3: (True, 7, True, 0), 4: (True, 1, True, 0), 5: (None,) * 4, 7: (True, 10, True, 0), 8: (False, 136, False, 134)}


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).collect()
    assert len(row) == 1 and 0 <= row[0]["mrr"] <= row[0]["hit"] <= 1
    assert set(e.oracle_sql()) <= set(e.queries())
