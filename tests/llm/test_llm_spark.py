"""The registered queries on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and on empty tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontam, embedding, html, lm, queries, simhash, spm

CLASH = ("row", "key", "id", "label", "component", "block", "pair", "score", "host", "token", "y", "fp", "__row", "__p")
WORDS = "the and of thing there other where with that this from not are was house garden river stone light water".split()


def texts():
    rng = np.random.default_rng(1)
    base = [" ".join(WORDS[i] for i in rng.integers(0, len(WORDS), 60)) for _ in range(12)]
    out = [None, "", " \n", "!!! 123", "x"] + base + [base[0], base[1] + " end", "word " * 20_000, "idiot " + base[2], "THIS!! IS!! LOUD!! " * 20]
    return [(i, t, "en" if i % 3 else None, "src0") for i, t in enumerate(out)] + [(8, out[8], "en", "src0"), (None, "no id here", "en", None)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    docs = spark.createDataFrame(texts(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(22)] + [(3, None, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    v = [1.0] * 8
    vectors = [(0, v, 1), (1, v, 1), (2, [1.0] * 7 + [1.05], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0] * 8, 1), (7, [float("nan")] * 8, 1), (8, [], 1), (0, v, 1), (9, [-1.0] * 8, 1), (10, [None] + v[1:], 1)]
    e = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    e.withColumn("row", F.lit("x")).withColumn("digest", F.lit("x")).write.parquet(f"{d}/embeddings.parquet")
    pages = [(0, "http://a.example/1", "<nav>m</nav><article><p>one &amp; two</article>"), (1, None, None), (2, "", ""), (3, "http://a.example/2", "<article>x"), (3, "http://a.example/2", "<article>x"), (4, "http://b.example", "<p>" + "long " * 30_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit("x")).write.parquet(f"{d}/pages.parquet")
    items = [(0, " ".join(texts()[7][1].split()[5:30])), (1, None), (2, ""), (3, "unique passage that nobody copied anywhere else"), (None, "x")]
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "embeddings", "pages", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def rows(spark, d, name):
    return queries.QUERIES[name](spark, d).collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert rows(spark, empty, name) == []


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_language_id", "op9_quality"])
def test_classifiers(spark, small, name):
    out = rows(spark, small, name)
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in texts()) and all(0 <= r["score"] <= 1 for r in out)
    mod, held = {"op2_toxicity": (4, 2), "op3_language_id": (4, 2), "op9_quality": (5, 0)}[name]
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % mod == held) for r in out)
    if name == "op3_language_id":
        assert {r["lang_pred"] for r in out if r["doc_id"] in (0, 1, 2, 3)} == {"und"} and {r["lang_pred"] for r in out if r["doc_id"] and r["doc_id"] > 4} == {"en"}
    else:
        assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)


def test_simhash_components(spark, small):
    out = rows(spark, small, "op4_simhash_near_dedup")
    known = texts()
    assert len(out) == len(known)
    fps = {t: simhash.fingerprint(t) for _, t, *_ in known}
    ids = [i for i, *_ in known]
    own = [fps[t] for _, t, *_ in known]
    comp = list(range(len(known)))
    for _ in known:
        for a in range(len(known)):
            for b in range(len(known)):
                if (own[a] ^ own[b]).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {c: min((i for i, k in zip(ids, comp) if k == c and i is not None), default=None) for c in comp}
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == Counter((i, f"{f:016x}", least[c]) for i, f, c in zip(ids, own, comp))


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    base = 0x1234_5678_9ABC_DEF0
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(10)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from tessera.llm.common import connected_components

    found = connected_components(simhash.near_edges(df))
    assert found.select("component").distinct().count() == 1 and found.count() == len(fps)


def test_embeddings(spark, small):
    out = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(spark, small, "op5_embedding_near_dedup"))
    want = Counter({(0, 3, 0, True): 2, (1, 3, 0, False): 1, (2, 3, 0, False): 1})
    want.update((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert out == want


def test_pages(spark, small):
    out = Counter((r["page_id"], r["text"] if len(r["text"]) < 99 else "", r["n_chars"]) for r in rows(spark, small, "op1_html_extraction"))
    assert out == Counter({(0, "one & two", 9): 1, (1, "", 0): 1, (2, "", 0): 1, (3, "x", 1): 2, (4, "", 149_999): 1})


def test_fixed_slots_of_a_host(spark):
    """Furniture in a container without a telling name goes where other text varies; copies of a page stay whole."""
    page = lambda t: f"<body><div class=qx><p>same on every page</p></div><div class=zz><p>{t}</p></div></body>"
    own = [f"story {'abcdefgh'[i] * 5} of its own" for i in range(8)]
    pages = [(i, f"http://a.example/{i}", page(t)) for i, t in enumerate(own)] + [(10 + i, f"http://b.example/{i}", page("copy")) for i in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert out == dict(enumerate(own)) | {10 + i: "same on every page copy" for i in range(4)}


def test_encodings(spark, small):
    sp = spm.encoder(spm.model_bytes(spm.model_path())).sp
    out = Counter((r["doc_id"], r["n_tokens"]) for r in rows(spark, small, "op6_sentencepiece"))
    assert out == Counter((i, len(sp.encode(t or ""))) for i, t, *_ in texts())
    counts = {r["doc_id"]: r["n_pretokens"] for r in rows(spark, small, "op10_token_counts")}
    assert counts == {i: len((t or "").split()) for i, t, *_ in texts()}


def test_lm(spark, small):
    low = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").lower()) + [0]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in texts() if not held(i) for w in low(t))
    n, v = sum(counts.values()), len(counts)
    out = rows(spark, small, "op7_lm_scores")
    assert len(out) == len(texts())
    by_id = {r["doc_id"]: r for r in out}
    for i, t, *_ in texts():
        r, w = by_id[i], low(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(counts[x] > 0 for x in w), n, held(i))
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9) and r["score"] <= 0


def test_lm_counts_beyond_the_known_words(spark, small, monkeypatch):
    """However few words are looked up in place, results are the same."""
    first = {(r["doc_id"], r["n_tokens"]): r for r in rows(spark, small, "op7_lm_scores")}
    monkeypatch.setattr(lm, "KNOWN_WORDS", 3)
    second = {(r["doc_id"], r["n_tokens"]): r for r in rows(spark, small, "op7_lm_scores")}
    assert first.keys() == second.keys()
    for k, a in first.items():
        b = second[k]
        assert a["n_known"] == b["n_known"] and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9) and math.isclose(a["score"], b["score"], rel_tol=1e-9)


def test_frequent_words(spark):
    df = spark.createDataFrame([(f"w{c}-{k}", c) for c in (1, 2, 3, 50, 900) for k in range(4)], "word string, c long")
    for most, want in ((3, 0), (4, 4), (11, 8), (19, 16), (20, 20), (99, 20)):
        found = lm.frequent(df, most).collect()
        assert len(found) == want and (not found or min(r["c"] for r in found) >= max([c for c in (1, 2, 3, 50, 900) if c not in {r["c"] for r in found}], default=0))


def test_ids_stay_whole_beside_nulls(spark, tmp_path):
    big = 9007199254740993
    spark.createDataFrame([(None, "a b"), (big, "c d"), (big + 1, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in rows(spark, tmp_path, "op7_lm_scores")} == {None, big, big + 1}
    vectors = [(None, [1.0, 0.0], None), (big, [1.0, 0.0], big), (big + 1, [1.0, 0.0], big + 1), (big + 2, [1.0, 0.0], big)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label long").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(spark, tmp_path, "op5_embedding_near_dedup")}
    assert found == {None: (0, None), big: (1, big), big + 1: (0, big + 1), big + 2: (1, big)}


def test_links_of_vectors_equal_brute_force(spark):
    """Planted pairs just above and below the threshold: 0.9 of the true links or more, none that is false."""
    rng = np.random.default_rng(21)
    base = rng.standard_normal((120, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = [base]
    for cosine in (0.999, 0.985, 0.981, 0.979, 0.9):
        noise = rng.standard_normal(base.shape)
        noise -= (noise * base).sum(1, keepdims=True) * base
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        vectors.append(cosine * base + (1 - cosine**2) ** 0.5 * noise)
    x = np.concatenate(vectors).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 120 % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.arange(len(x)) % 120 % 3
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    out = {r["vec_id"]: r for r in embedding.near_duplicates(df).collect()}
    links = np.array([out[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()
    for i in range(len(x)):
        assert out[i]["kept"] == (out[i]["component_id"] == i) and (links[i] > 0 or out[i]["component_id"] == i)


def test_components_with_hubs(spark, monkeypatch):
    """Hubs that are met by broadcast, and those beyond their number, give the components of a plain search."""
    rng = np.random.default_rng(22)
    edges = [(0, k) for k in range(1, 80)] + [(500 + k, 400) for k in range(60)] + [(79, 500)] + [(1000 + k, 1001 + k) for k in range(40)]
    edges += [tuple(int(v) for v in rng.integers(2000, 2200, 2)) for _ in range(90)] + [(7, 7), (0, 1), (1, 0)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {v: root(v) for a, b in edges if a != b for v in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    for hub, hubs in ((10**9, 1), (3, 1), (3, 100)):
        monkeypatch.setattr(common, "HUB", hub)
        monkeypatch.setattr(common, "HUBS", hubs)
        assert {r["id"]: r["component"] for r in common.connected_components(df).collect()} == want


def test_stages_keep_columns_whole(spark, small):
    """Columns whose names a stage might use for itself come back with their values; clashing outputs are replaced."""
    names = ("number", "row", "language", "score", "leaks", "coded", "N_Tokens", "ids_sha256", "__row", "component")
    docs = spark.createDataFrame(texts(), "doc_id long, text string, lang string, source string")
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        found = out.collect()
        assert found
        for r in found:
            for c in names if name != "sentencepiece" else [c for c in names if c not in ("N_Tokens", "ids_sha256")]:
                assert r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}"
        if name == "sentencepiece":
            assert [c for c in out.columns if c.lower() == "n_tokens"] == ["n_tokens"] and len(found) == len(texts())
        else:
            assert out.columns == docs.columns


def test_samples_hold_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, t) for t in ("b", "a", None, "c")] + [(2, None), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None)], "doc_id long, y0 int")
    sample, weights = common.labelled_sample(docs, labels, "y0", 1, 5, 100)
    assert sorted((r["doc_id"], r["text"], r["y"]) for r in sample.collect()) == [(1, "a", 1), (2, None, 0)] and weights == {0: 1.0, 1: 1.0}


def test_shared_folder_is_asked_for():
    class Bare:
        class sparkContext:  # noqa: N801
            master, applicationId = "local-cluster[2,1,1024]", "x"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    unset = type("Unset", (), {"isDefined": staticmethod(lambda: False)})
                    return type("Context", (), {"getCheckpointDir": staticmethod(lambda: unset)})

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        common.checkpoint_root(Bare)


def test_decontamination(spark, small, monkeypatch):
    out = {(r["doc_id"], r["item_id"]) for r in rows(spark, small, "op8_decontamination")}
    assert out == {(7, 0), (20, 0), (4, None)}  # an item of a null id is one like any other
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 60)  # several blocks give the same
    assert {(r["doc_id"], r["item_id"]) for r in rows(spark, small, "op8_decontamination")} == out


def test_leaks_by_a_common_phrase(spark):
    """An edited copy whose only unbroken 4-gram stands in many documents is found, whatever their number."""
    item = "alpha beta gamma one of the most delta eps zeta eta"
    copy = "so alpha beta xx one of the most yy eps zeta eta there"
    docs = spark.createDataFrame([(i, f"w{i} is one of the most v{i} things") for i in range(60)] + [(999, copy)], "doc_id long, text string")
    found = decontam.leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert [(r["doc_id"], r["leak"]["item_id"], r["leak"]["score"]) for r in found.collect()] == [(999, 5, 16 / 22)]


def test_pipeline(spark, small, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.run(spark, small)
    assert set(docs.columns) < set(kept.columns)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and not {0, 1, 2, 3, 7} & set(ids) and set(ids) <= {i for i, *_ in texts()}
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_near_copies(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join("abcdefghij"[i] for i in rng.integers(0, 10, 6))
    base = [word() for _ in range(200)]
    edited = list(base)
    edited[100] = "changed"
    other = [word() for _ in range(200)]
    df = spark.createDataFrame([(3, " ".join(base)), (1, " ".join(edited)), (2, " ".join(other)), (4, " ".join(base)), (1, " ".join(edited))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_copies_removed(df).collect()) == [1, 2]


def test_near_copies_by_exact_similarity(spark):
    """Copies with an added block, a cut end or scattered edits against brute force, close to the threshold on both sides."""
    rng = np.random.default_rng(12)
    word = lambda: "".join("abcdefghij"[i] for i in rng.integers(0, 10, 6))
    docs = []
    for k in range(40):
        base = [word() for _ in range(200)]
        docs += [base, base + [word() for _ in range(30 + k)], base[: 150 + k]]
        edited = list(base)
        for at in rng.choice(200, 1 + k % 7, replace=False):
            edited[at] = word()
        docs.append(edited)
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    component = list(range(len(docs)))
    for _ in range(4):
        for a in range(len(docs)):
            for b in range(a - a % 4, a - a % 4 + 4):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_copies_removed(df).collect()) == sorted(set(component))


def test_each_id_is_a_target_of_the_gradient(spark, monkeypatch):
    """All ids of all training texts, ends included, are targets, once each, whatever the texts' lengths."""
    leaf, tasks, seen = np.arange(3_001) % lm.LEAVES, [], np.zeros(lm.LEAVES, int)

    class Rows:
        def __getattr__(self, name):
            return lambda *a, **b: [] if name == "collect" else self

        def mapInPandas(self, f, schema):
            tasks.append(f)
            return self

    monkeypatch.setattr(lm.Trainer, "step", lambda self, x, y, w: np.add.at(seen, y[w > 0], 1))
    lm.trained(Rows(), leaf, lm.Attention.new(np.ones(lm.LEAVES), 2))
    sequences = [np.random.default_rng(n).integers(0, 3_000, n) for n in (0, 1, 31, 32, 300, 9_000)] * 9
    batches = [pd.DataFrame({"ids": [s.astype(lm.id_kind(3_000)).tobytes() for s in own]}) for own in (sequences[:20], [], sequences[20:])]
    list(tasks[0](iter(batches)))
    assert (seen == np.bincount(np.concatenate([np.append(s, 3_000) for s in sequences]), minlength=lm.LEAVES)).all()
