"""Segmentation of unspaced text by a dictionary: the words that may begin at each character are the edges of a graph, and
the path of greatest probability is taken. Characters that no word covers stand alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: A dictionary of more words, or of longer ones together, stays a table that pieces of the texts are joined with.
WORDS, CHARS = 1_000_000, 16_000_000


def dictionary(docs: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(word, n) of the lower-case words of all texts that occur ``least`` times or more."""
    return docs.select(F.explode(tx.tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def prefixes(counts: dict[str, int]) -> dict[str, int]:
    """The dictionary with all beginnings of its words; one that is no word itself counts 0."""
    out = dict(counts)
    for w in counts:
        for k in range(1, len(w)):
            out.setdefault(w[:k], 0)
    return out


def edges(text: str, known: dict[str, int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, count) of the words in a text; a start is left as soon as no word begins so."""
    for start in range(len(text)):
        for end in range(start + 1, len(text) + 1):
            n = known.get(text[start:end])
            if n is None:
                break
            if n:
                yield start, end - start, n


def best_path(text: str, graph: Iterable[tuple[int, int, int]], total: int) -> list[str]:
    """The words of the most probable path; a character without a word of its own counts 1. Of equal paths the one whose first
    differing word is longer is taken.
    """
    words: list[dict[int, int]] = [{1: 1} for _ in text]
    for start, length, n in graph:
        words[start][length] = n
    log_total = math.log(max(total, 1))
    best = [(0.0, 0)] * (len(text) + 1)
    for start in range(len(text) - 1, -1, -1):
        best[start] = max((math.log(n) - log_total + best[start + k][0], k) for k, n in words[start].items())
    out, at = [], 0
    while at < len(text):
        out.append(text[at : at + best[at][1]])
        at += best[at][1]
    return out


def segmented(texts: DataFrame, text: str, words: DataFrame, most: tuple[int, int] = (WORDS, CHARS)) -> DataFrame:
    """``texts`` with ``words``, an array of the segments of each text; null gives null, an empty text no words.

    A dictionary within ``most`` (words, characters) goes to the tasks once, as a prefix table. A larger one is joined with
    the pieces of the texts, each up to the longest word; the result is the same. Repeated words of ``words`` are added up.
    """
    words = words.where("word <> '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    size = words.agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("chars"), F.max(F.length("word")).alias("longest"), F.sum("n").alias("total")).first()
    total, longest = size["total"] or 0, size["longest"] or 1
    if size["words"] <= most[0] and (size["chars"] or 0) <= most[1]:
        sent = texts.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in words.toLocalIterator()})  # at most ``most``

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = prefixes(sent.value)
            for b in batches:
                yield pd.Series([None if t is None else best_path(t, edges(t, known), total) for t in b], dtype=object)

        return texts.withColumn("words", cut(F.col(text)))

    # one graph for each distinct text
    distinct = texts.select(F.col(text).alias("__text")).where("__text <> ''").distinct()
    starts = distinct.select("__text", F.explode(F.sequence(F.lit(0), F.length("__text") - 1)).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("__text") - F.col("start")))
    pieces = starts.select("__text", "start", F.explode(F.transform(lengths, lambda k: F.substr("__text", F.col("start") + 1, k))).alias("word"))
    graph = pieces.join(words, "word").groupBy("__text").agg(F.collect_list(F.struct("start", F.length("word").alias("length"), "n")).alias("__graph"))

    @F.pandas_udf("array<string>")
    def path(found: pd.Series, graphs: pd.Series) -> pd.Series:
        whole = ((t, g if g is not None else ()) for t, g in zip(found, graphs))
        return pd.Series([None if t is None else best_path(t, ((e["start"], e["length"], e["n"]) for e in g), total) for t, g in whole], dtype=object)

    joined = texts.select(F.struct("*").alias("__whole"), F.col(text).alias("__own")).join(graph, F.col("__own") == F.col("__text"), "left")
    return joined.select("__whole.*", path("__own", "__graph").alias("words"))
