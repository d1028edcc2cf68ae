"""Sections and chunks against the plain splitter, segments against all segmentations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, sections, segmentation

TEXTS = [
    "# A\none\n\ntwo\n## B\nthree\n### C\nfour\n## D\nfive\n# E\nsix\n### F\nseven",
    "before\n```\n# no header\n~~~\n```\n# yes\nx\n~~~ py\n# no\n```\n## no\n~~~ end\n## also\ny",
    "# open\n```\n# never closed\nz",
    "```\nfirst\n```",
    "# A\nx\n# A\ny\n## B\n# A\nz",
    "# only\n## headers\n#\n####  four\n#none",
    "　# wide \n text \x1c\n  ## in \t\nt",
    "a\r\n# b\r\nc # d\n\n\n",
    "", " \n ", None,
]


def plain(texts):
    return [(i, k, h.get("h1"), h.get("h2"), h.get("h3"), c) for i, t in enumerate(texts) for k, (h, c) in enumerate(chunking.header_sections(t or ""))]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_sections_equal_the_plain_splitter(spark):
    rng = random.Random(4)
    parts = ["# A", "# B", "## A", "## C", "### A", "### D", "x", "y  ", "", "```", "~~~", "  ``` py", "#x", "#### q"]
    texts = TEXTS + ["\n".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)]
    found = sections.header_sections(table(spark, texts), "text").select("id", "section", "h1", "h2", "h3", "content")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain(texts), key=str)


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "# A\nx", "n")] * 2, "id long, text string, line string")
    assert [tuple(r) for r in sections.header_sections(docs, "text").collect()] == [(1, "n", 0, "A", None, None, "x")] * 2
    assert sections.header_sections(docs.limit(0), "text").count() == 0


def test_a_long_fence(spark):
    text = "# A\n```\n" + "# line\n" * 60_000 + "```\nend"
    (row,) = sections.header_sections(table(spark, [text]), "text").collect()
    assert row["h1"] == "A" and row["content"].count("\n") == 60_002


def test_chunks_by_lateral_join(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["word", "# A", "longer\n", "\n\n", "x" * 40]) for _ in range(200)) for _ in range(12)] + TEXTS
    docs = table(spark, texts)
    found = sections.split_sections(sections.header_sections(docs, "text"), size=100, overlap=20).select("id", "section", "chunk_index", "chunk")
    expected = [(i, k, n, c) for i, k, *_, body in plain(texts) for n, c in enumerate(chunking.recursive_split(body, 100, 20))]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    # the same as the chunks of the vectorised way, in their order
    other = chunking.recursive_chunks(docs, "id", "text", 100, 20).select("id", "chunk_index", "chunk").collect()
    mine = {i: [c for j, *_, c in sorted(expected) if j == i] for i in range(len(texts))}
    assert {i: c for i, c in mine.items() if c} == {i: [r["chunk"] for r in sorted((r for r in other if r["id"] == i), key=lambda r: r["chunk_index"])] for i in {r["id"] for r in other}}
    sections.register(spark)
    docs.createOrReplaceTempView("split_docs")
    by_sql = spark.sql("select id, c.chunk from split_docs, lateral split_text(text, 100, 20) c").collect()
    assert sorted(map(tuple, by_sql)) == sorted((i, c) for i, t in enumerate(texts) if t is not None for c in chunking.recursive_split(t, 100, 20))


def segmentations(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in segmentations(text[k:]):
            yield [text[:k], *rest]


@pytest.mark.parametrize("most", [(10**6, 10**6), (0, 0)])
def test_segments_are_the_best_of_all(spark, most):
    """Both ways, by a table sent to the tasks and by a join."""
    rng = random.Random(6)
    counts = {"a": 3, "ab": 5, "abc": 1, "b": 2, "bc": 7, "cab": 4, "ca": 2, "中文": 9, "文": 1}
    texts = ["".join(rng.choice("abcd中文") for _ in range(rng.randrange(11))) for _ in range(60)] + [None, "", "abab", "zz", "abab"]
    words = spark.createDataFrame([(w, n) for w, n in counts.items()] + [("ab", 0), ("", 5)], "word string, n long")
    docs = table(spark, texts).withColumn("start", F.lit("kept"))
    found = segmentation.segmented(docs, "text", words, most).collect()
    total = sum(counts.values())
    assert len(found) == len(texts)
    for r in found:
        t = texts[r["id"]]
        if t is None:
            assert r["words"] is None
            continue
        score = lambda ws: sum(math.log(counts.get(w, 1) / total) for w in ws)
        legal = [ws for ws in segmentations(t) if all(len(w) == 1 or w in counts for w in ws)]
        assert r["words"] in legal and abs(score(r["words"]) - max(map(score, legal))) < 1e-9
    assert {r["start"] for r in found} == {"kept"}


def test_empty_dictionary(spark):
    words = spark.createDataFrame([], "word string, n long")
    for most in ((10, 10), (-1, -1)):
        assert [r["words"] for r in segmentation.segmented(table(spark, ["ab"]), "text", words, most).collect()] == [["a", "b"]]
