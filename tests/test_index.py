"""The lexical index: search against a plain search, segments, deletes and folding against a rebuild."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.sources import index

WORDS = [f"w{i}" for i in range(30)]


def corpus(n, seed=6, low=0, high=12):
    rng = np.random.default_rng(seed)
    weight = 1 / np.arange(1, len(WORDS) + 1)
    return [" ".join(rng.choice(WORDS, rng.integers(low, high), p=weight / weight.sum())) for _ in range(n)]


def plain(found, rows, asked, k):
    """BM25 by loops, with the idf of the index."""
    idf, avgdl = {r["term"]: r["idf"] for r in found.terms.collect()}, found.avgdl
    want = set()
    for q, t in asked:
        scores = []
        for i, text in rows:
            own = (text or "").split()
            part = [idf[w] * own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / avgdl)) for w in (t or "").split() if w in own]
            scores += [(-round(sum(part), 6), i)] if part else []
        want |= {(q, i, n) for n, (_, i) in enumerate(sorted(scores)[:k], 1)}
    return want


def searched(found, queries, k=4):
    return {(r["query_id"], r["id"], r["rank"]) for r in found.search(queries, "q", "t", k).collect()}


def test_search_equals_a_plain_search(spark, tmp_path, monkeypatch):
    """Scores and ties against loops, with texts in several shards, blocks of few postings, string ids, null ids and texts."""
    monkeypatch.setattr(lexical, "FEW", 15)
    monkeypatch.setattr(lexical, "POSTINGS", 4)
    rows = [(f"d{i % 50:02}-{i}", t) for i, t in enumerate(corpus(60))] + [("zz", None)]
    docs = spark.createDataFrame([*rows, (None, "w1")], "id string, t string").repartition(5)
    rng = np.random.default_rng(7)
    asked = [(i, " ".join(rng.choice(WORDS, 6))) for i in range(9)] + [(9, "none of these"), (10, None)]
    queries = spark.createDataFrame(asked, "q int, t string")
    found = index.write_lexical(docs, "id", "t", str(tmp_path / "i"))
    assert found.manifest.segments[0].shards > 3
    want = plain(found, rows, asked, 4)
    assert searched(found, queries) == want
    monkeypatch.setattr(lexical, "PASS_CHARS", 60)  # several passes
    assert searched(found, queries) == want
    assert found.search(queries.where("false"), "q", "t", 4).count() == 0


@pytest.mark.parametrize("negative", [False, True])
def test_a_shard_stops_early_and_misses_nothing(negative):
    rng = np.random.default_rng(1)
    n, vocabulary = 3000, 400
    weight = 1 / np.arange(1, vocabulary + 1)
    texts = [rng.choice(vocabulary, rng.integers(1, 60), p=weight / weight.sum()) for _ in range(n)]
    dl = np.array([len(t) for t in texts])
    rows = {"term": [], "ids": [], "tfs": [], "dls": []}
    for w in range(vocabulary):
        own = [(i, int((t == w).sum())) for i, t in enumerate(texts) if (t == w).any()]
        for s in range(0, len(own), 50):
            part = own[s : s + 50]
            for c, v in zip(rows, (f"t{w}", [i for i, _ in part], [f for _, f in part], [int(dl[i]) for i, _ in part])):
                rows[c].append(v)
    schema = pa.schema([("term", pa.string()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32()))])
    gone = [5, 17, 400]
    rows["term"].append(None), rows["ids"].append(gone), rows["tfs"].append([]), rows["dls"].append([])
    shard = lexical.Shard(pa.array([f"t{w}" for w in range(vocabulary)]), pa.table(rows, schema=schema), float(dl.mean()), 1.5, 0.75)
    idf = np.log(n / np.array([max(1, sum(w in t for t in texts)) for w in range(vocabulary)]))
    if negative:
        idf[:3] = (-0.1, 0.0, -0.5)
    full = 0
    for _ in range(60):
        words = np.unique(rng.choice(vocabulary, rng.integers(1, 25)))
        k = int(rng.integers(1, 8))
        ids, score = shard.search(words, idf[words], k)
        want = []
        for i, t in enumerate(texts):
            tf = np.array([(t == w).sum() for w in words])
            full += int((tf > 0).sum())
            if tf.any() and i not in gone:
                want.append((-round(float((idf[words] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl[i] / dl.mean()))).sum()), 6), i))
        want = sorted(want)[:k]
        assert [(-s, i) for s, i in zip(score.tolist(), ids.tolist())] == [(s, i) for s, i in want]
    if not negative:
        assert shard.read < 0.7 * full  # postings that were scored


def same_index(a, b, queries):
    assert {tuple(r) for r in a.terms.select("term", "df", F.round("idf", 9)).collect()} == {tuple(r) for r in b.terms.select("term", "df", F.round("idf", 9)).collect()}
    assert (a.manifest.n, a.manifest.length) == (b.manifest.n, b.manifest.length)
    assert searched(a, queries) == searched(b, queries)


def test_updates_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "FEW", 20)
    now = dict(enumerate(corpus(80, 1)))
    frame = lambda rows: spark.createDataFrame([*rows], "id long, t string").repartition(3)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(12, 2, 3, 9))], "q int, t string")
    found = index.write_lexical(frame(now.items()), "id", "t", str(tmp_path / "a"))
    first, before = found, searched(found, queries)
    for step in range(2):
        new = dict(zip([*range(step * 9, step * 9 + 12), *range(100 + step * 4, 106 + step * 4)], corpus(18, 10 + step)))
        lost = [3 + step, 50 + step, 999]
        found = index.updated(found, frame(new.items()), "id", "t", spark.createDataFrame([(i,) for i in lost], "id long"))
        now = {i: t for i, t in (now | new).items() if i not in lost or i in new}
        same_index(found, index.write_lexical(frame(now.items()), "id", "t", str(tmp_path / f"b{step}")), queries)
    assert len(found.manifest.segments) == 3 and found.manifest.gone
    one = index.folded(found)
    assert len(one.manifest.segments) == 1 and not one.manifest.gone
    same_index(one, found, queries)
    assert searched(first, queries) == before  # an older version still reads
    none = index.updated(one, frame([]), "id", "t")
    same_index(none, one, queries)
    assert index.read_lexical(spark, str(tmp_path / "a")).version == none.version
    monkeypatch.setattr(index, "SEGMENTS", 1)
    more = index.updated(one, frame([(7, "w1 w2")]), "id", "t")
    assert len(more.manifest.segments) == 1


def test_kept_index_reads_new_files_only(spark, tmp_path):
    at = tmp_path / "d.parquet"
    rows = lambda *r: spark.createDataFrame([*r], "doc_id long, text string").coalesce(1)
    for day, r in (("a", [(0, "a b"), (1, "b c")]), ("b", [(2, "a c"), (3, "c d")]), ("c", [(4, "e")])):
        rows(*r).write.parquet(f"{at}/day={day}")
    kept = lambda: index.kept_lexical(spark, str(at), "doc_id", "text")
    first = kept()
    assert kept().version == first.version and first.manifest.n == 5
    rows((5, "a a f")).write.parquet(f"{at}/day=d")
    second = kept()
    assert [s.path for s in second.manifest.segments[:-1]] == [s.path for s in first.manifest.segments]
    assert second.docs(1).select("id").collect() == [(5,)] and second.manifest.n == 6
    rows((2, "a z"), (6, "y")).write.mode("overwrite").parquet(f"{at}/day=b")  # an inner folder changes: 3 is gone
    third = kept()
    queries = spark.createDataFrame([(1, "a"), (2, "d"), (3, "z y")], "q int, t string")
    assert {(r["query_id"], r["id"]) for r in third.search(queries, "q", "t", 9).collect()} == {(1, 0), (1, 2), (1, 5), (3, 2), (3, 6)}
    assert {r["term"]: r["df"] for r in third.terms.collect()} == {"a": 3, "b": 2, "c": 1, "e": 1, "f": 1, "y": 1, "z": 1}
    assert index.read_lexical(spark, str(tmp_path / "none")) is None


def test_odd_tables(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a")], "q int, t string")
    empty = index.write_lexical(spark.createDataFrame([], "id long, t string"), "id", "t", str(tmp_path / "e"))
    assert empty.search(queries, "q", "t").count() == 0 and empty.stats.first()["n"] == 0
    blank = index.write_lexical(spark.createDataFrame([(1, ""), (2, None)], "id long, t string"), "id", "t", str(tmp_path / "b"))
    assert blank.search(queries, "q", "t").count() == 0 and blank.stats.first()["n"] == 2
    twice = index.write_lexical(spark.createDataFrame([(1, "b"), (1, "a"), (2, "a")], "id long, t string"), "id", "t", str(tmp_path / "t"))
    assert twice.manifest.n == 2 and {r["id"] for r in twice.search(queries, "q", "t").collect()} == {1, 2}


def test_statistics_without_an_index_equal_its(spark, tmp_path):
    """Counted from the texts, with null, empty and repeated ones, and with no postings made; then read from the kept index."""
    rows = [(1, "a b b"), (2, None), (3, ""), (4, "..."), (5, "b c C"), (None, "x y"), (6, "é b 1"), (6, "é b")]
    for name, own in (("some", rows), ("none", [])):
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(own, "doc_id long, text string").write.parquet(path)
        root = index._root(spark, path, "doc_id", "text")
        seen = []
        for _ in range(2):
            stats, terms = index.table_statistics(spark, path, "doc_id", "text")
            seen.append((stats.collect(), sorted((r["term"], r["df"], round(r["idf"], 9)) for r in terms.collect())))
            assert bool(index._versions(spark, root)) == (len(seen) == 2)
            index.kept_lexical(spark, path, "doc_id", "text")
        assert seen[0] == seen[1]


def test_a_task_inverts_its_texts_before_the_shuffle(spark, monkeypatch):
    """Rows of terms, not of postings, are shuffled; a rare term of many shards is one block; blocks hold all postings."""
    monkeypatch.setattr(lexical, "POSTINGS", 8)
    rows = [(i, t) for i, t in enumerate(corpus(300, 3))] + [(900, "rare rare"), (901, "rare"), (902, None)]
    lists = lexical.term_lists(spark.createDataFrame(rows, "id long, t string").repartition(3), "id", "t")
    want = {(w, i, (t or "").split().count(w), len(t.split())) for i, t in rows if t for w in t.split()}
    for held, most in ((1_000_000, 3 * 31 * 2), (50, len(want))):
        monkeypatch.setattr(lexical, "HELD", held)
        assert len(set(WORDS)) < lexical.runs(lists, 90).count() <= most < len(want) + 1  # two groups of shards
        found = lexical.blocks(lists, 90, 16).collect()
        assert {(r["term"], *p) for r in found for p in zip(r["ids"], r["tfs"], r["dls"])} == want
        assert sum(len(r["ids"]) for r in found) == len(want) == sum(r["df"] or 0 for r in found)
        assert max(len(r["ids"]) for r in found) == 8
        shard = {r["id"]: r["s"] for r in lists.select("id", F.pmod(F.xxhash64("id"), F.lit(90)).alias("s")).collect()}
        for r in found:
            assert [s["shard"] for s in r["slices"] for _ in range(s["size"])] == [shard[i] for i in r["ids"]]
            assert [s["first"] for s in r["slices"]] == np.cumsum([0] + [s["size"] for s in r["slices"]])[:-1].tolist()
    assert len([r for r in found if r["term"] == "rare"]) <= 2


def test_a_shard_has_as_many_texts_however_large_the_table():
    """A task of a search holds a shard's postings."""
    for n in (1, 50_000, 256_000, 2_000_000, 60_000_000):
        assert n / lexical.shard_count(n) <= 8_000


def test_a_row_of_the_shuffle_holds_many_terms(spark, monkeypatch):
    """Rare terms don't make a row each; terms are counted the same however many tokens a task takes at once."""
    rows = [(i, " ".join([*(f"w{i}x{k}" for k in range(20)), "often", "often"])) for i in range(100)] + [(900, None), (901, "...")]
    docs = spark.createDataFrame(rows, "id long, t string").repartition(3)
    for held in (400_000, 30):
        monkeypatch.setattr(lexical, "HELD", held)
        lists = {r["id"]: r for r in lexical.term_lists(docs.withColumn("more", F.lit("m")), "id", "t").collect()}
        for i, t in rows:
            words = [w for w in (t or "").split() if w != "..."]
            own = sorted(set(words))
            assert tuple(lists[i]) == (i, len(words), own, [words.count(w) for w in own], "m")
    monkeypatch.setattr(lexical, "HELD", 400_000)
    made = lexical.term_lists(docs, "id", "t")
    assert lexical.runs(made, 90, 16).count() <= 3 * 2 * 16
    assert sum(len(r["ids"]) for r in lexical.blocks(made, 90, 16).collect()) == 100 * 21
    for length, shards in ((1, 1), (26_000_000, 26), (10**9, 256), (10**11, 7_500)):
        assert length / -(-shards // lexical.SHARDS) / lexical.bucket_count(length, shards) <= lexical.BUCKETED
