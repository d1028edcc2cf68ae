"""Chunking: header sections, recursive character splits, fixed strides, and what is stamped on a chunk."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown, text as tx

SIZE, OVERLAP, LONGEST, SHORTEST = 1000, 128, 2000, 5
SEPARATORS = ("\n```", "\n\n", "\n", " ", "")
LEVELS = {"# ": "h1", "## ": "h2", "### ": "h3"}


def header_sections(source: str) -> list[tuple[dict[str, str], str]]:
    """Sections of a markdown text with the headers they stand under. Header lines go, fenced code is never a header."""
    out: list[tuple[dict[str, str], list[str]]] = []
    headers: dict[str, str] = {}
    fence = ""
    for raw in source.split("\n"):
        line = raw.strip()
        if fence:
            if line.startswith(fence):
                fence = ""
        elif line.startswith(("```", "~~~")):
            fence = line[:3]
        else:
            level = next((k for k in LEVELS if line.startswith(k)), None)
            if level:
                names = list(LEVELS.values())
                own = LEVELS[level]
                headers = {k: v for k, v in headers.items() if names.index(k) < names.index(own)} | {own: line[len(level) :].strip()}
                continue
        if not line:
            continue
        if not out or out[-1][0] != headers:
            out.append((dict(headers), []))
        out[-1][1].append(line)
    return [(h, "  \n".join(lines)) for h, lines in out]


def recursive_split(source: str, size: int = SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that occurs, by the next one where a piece is
    still too long; neighbours share up to ``overlap`` characters of whole parts. A separator stays at the head of its part.
    """
    at = next((k for k, s in enumerate(separators) if s == "" or s in source), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    parts = list(source) if separator == "" else [p for p in re.split(f"(?={re.escape(separator)})", source) if p]
    out: list[str] = []
    window: list[str] = []
    held = 0

    def flush():
        joined = "".join(window).strip()
        if joined:
            out.append(joined)

    for p in parts:
        if len(p) > size and finer:
            if window:
                flush()
                window, held = [], 0
            out += recursive_split(p, size, overlap, finer)
            continue
        if held + len(p) > size and window:
            flush()
            while held > overlap or (held + len(p) > size and held > 0):
                held -= len(window.pop(0))
        window.append(p)
        held += len(p)
    if window:
        flush()
    return out


def recursive_chunks(docs: DataFrame, id_col: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, chunk): header sections, each split. Greedy merging is sequential within a text, so it is a
    vectorised UDF; texts are independent, so nothing is shuffled.
    """

    @F.pandas_udf("array<struct<headers:map<string,string>,content:string>>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"headers": h, "content": c} for h, body in header_sections(t or "") for c in recursive_split(body, size, overlap)] for t in texts], dtype=object)

    parts = docs.select(F.col(id_col), F.posexplode(split(F.col(text))).alias("chunk_index", "part"))
    return parts.select(id_col, "chunk_index", F.col("part.headers").alias("headers"), F.col("part.content").alias("chunk"))


def fixed_stride_chunks(docs: DataFrame, id_col: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, chunk) at every ``size - overlap`` characters, all of built-in expressions."""
    stride = size - overlap
    t = F.coalesce(F.col(text), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(stride))
    pieces = F.transform(starts, lambda i: F.substr(t, i + 1, F.lit(size)))
    return docs.select(F.col(id_col), F.posexplode(pieces).alias("chunk_index", "chunk"))


def chunk_filter(chunk: Column, shortest: int = SHORTEST) -> Column:
    return F.length(tx.stripped(chunk)) > shortest


def chunk_truncate(chunk: Column, longest: int = LONGEST) -> Column:
    return F.left(chunk, F.lit(longest))


def source_header(title: Column, filename: Column, url: Column, headers: Column) -> Column:
    """The line before a chunk that says where it is from."""
    path = F.array_join(F.filter(F.array(*(F.try_element_at(headers, F.lit(k)) for k in LEVELS.values())), lambda x: x.isNotNull()), " > ")
    # fixed values: the words of the heading
    return F.concat(F.lit("【来源: "), F.coalesce(title, filename), F.when(url.isNotNull(), F.concat(F.lit(" ("), url, F.lit(")"))).otherwise(""), F.when(path != "", F.concat(F.lit(" | 章节: "), path)).otherwise(""), F.lit("】\n\n"))


def corpus_chunks(files: DataFrame, caption: Callable | None = None) -> DataFrame:
    """Chunks (see ``schemas.CHUNKS``) of markdown files (path, body), as an index takes them."""
    name = F.element_at(F.split("path", "/"), -1)
    front = markdown.front_columns(F.col("body"))
    docs = files.where(tx.stripped(F.coalesce("body", F.lit(""))) != "").select(name.alias("file"), *(front[c].alias(c) for c in ("source_url", "docdata_url", "title", "data_type")), "body")
    docs = docs.withColumn("docid", tx.source_docid(F.col("source_url"), F.col("docdata_url"), F.col("file")))
    docs = docs.withColumn("body", markdown.absolute_images(F.col("body"), F.col("docdata_url"), F.col("source_url")))
    docs = docs.withColumn("enriched", markdown.enriched_images(F.col("body"), F.col("docid"), caption))
    docs = docs.withColumn("whole", F.struct("file", "source_url", "docdata_url", "title", "data_type", "docid", F.col("enriched.image_map").alias("image_map")))
    parts = recursive_chunks(docs.select("whole", F.col("enriched.text").alias("text")), "whole", "text").select("whole.*", "chunk_index", "headers", "chunk")
    content = F.concat(source_header(F.col("title"), F.col("file"), F.col("source_url"), F.col("headers")), "chunk")
    parts = parts.withColumn("page_content", content).where(chunk_filter(F.col("page_content")))
    size = F.size("image_map")
    return parts.select("docid", "chunk_index", chunk_truncate(F.col("page_content")).alias("page_content"), "headers", "source_url", "docdata_url", "title", "data_type", "image_map", (size > 0).alias("has_image"), size.alias("image_count"))
