"""Files in and out: markdown folders, case sets, CSV, indexes, reports, state and feedback."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import crawl, evalset


def target_directories(raw: str, extra: str | None = None) -> list[str]:
    """Folders to read: the raw one, and another if it isn't blank."""
    return [raw] + ([extra.strip()] if extra and extra.strip() else [])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_markdown(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """(path, body) of all ``*.md`` files below the folders that exist; blank files are left out."""
    there = [d for d in directories if exists(spark, d)]
    if not there:
        return spark.createDataFrame([], "path string, body string")
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(there, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")).where(F.regexp_replace("body", r"\s+", "") != "")


def read_cases(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Validated cases of a JSONL file; blank lines are skipped, a missing or empty file is an error."""
    raw = spark.read.schema(T.StructType([*schemas.EVAL_CASE.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path).cache()
    try:  # Spark reads a broken line's text only beside other columns, so both looks go through the cache
        if raw.isEmpty():
            raise ValueError(f"no cases in {path}")
        broken = not raw.where("_corrupt_record is not null").isEmpty()
    finally:
        raw.unpersist()
    if strict and broken:
        raise ValueError(f"lines of {path} aren't JSON objects")
    if not broken:
        return evalset.validated(spark.read.schema(schemas.EVAL_CASE).json(path), strict)
    return evalset.validated(raw.where("_corrupt_record is null").drop("_corrupt_record"), strict)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, marks at its head removed, and ``line``: the number of each row, from 1."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return evalset.numbered(df.withColumn("__at", F.monotonically_increasing_id()), "__at", "line").drop("__at")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """An index is a parquet table of chunks with vectors; the old one goes when the new one is whole."""
    chunks.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index, or None if it is missing or can't be read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list], text: str = "page_content", batch: int = 10) -> DataFrame:
    """Chunks with ``embedding`` and ``status``. A batch that fails is tried row by row, and a row that fails is marked, not lost."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("status", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the texts that the model is given at once leave the batch's memory
        for b in (whole.slice(at, 50 * batch) for whole in batches for at in range(0, whole.num_rows, 50 * batch)):
            vectors, status = [], []
            for at in range(0, b.num_rows, batch):
                texts = b.column(text).slice(at, batch).to_pylist()
                try:
                    found = list(embed(texts))
                    if len(found) != len(texts):
                        raise ValueError("vectors are missing")
                except Exception:  # noqa: BLE001 - whatever the model raised, its rows are tried alone
                    found = []
                    for t in texts:
                        try:
                            found.append(embed([t])[0])
                        except Exception:  # noqa: BLE001
                            found.append(None)
                vectors += found
                status += ["ok" if v is not None else "failed" for v in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(status, pa.string())], names=names)

    return chunks.mapInArrow(run, schema)


def hashed_embedding(dimensions: int = 64) -> Callable[[list[str]], list]:
    """A stand-in for a text model: hashed words, at length one."""
    import zlib

    import numpy as np

    def embed(texts: list[str]) -> list:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, t in zip(out, texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                row[h % dimensions] += 1 if h >> 31 else -1
            row /= max(float(np.linalg.norm(row)), 1e-9)
        return out.tolist()

    return embed


def write_pages(rows: DataFrame, root: str) -> int:
    """Write the markdown of rows (path, markdown) to files at their paths below ``root``, and return how many.

    Each task writes its rows' files, beside their places first; a file whose page isn't among the rows stays.
    """
    if "://" not in root:
        root = os.path.abspath(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, text in zip(b["path"], b["markdown"]):
                at = f"{base}/{path}"
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                beside = f"{at}.{uuid.uuid4().hex}.next"
                with system.open_output_stream(beside) as f:
                    f.write(text.encode())
                system.move(beside, at)
            yield pd.DataFrame({"n": [len(b)]})

    texts = rows.where("path is not null and markdown is not null").select("path", "markdown")
    return texts.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The crawl's last snapshot; an empty one if it is missing or can't be read."""
    try:
        return spark.read.schema(schemas.CRAWL_STATE).parquet(path) if exists(spark, path) else spark.createDataFrame([], schemas.CRAWL_STATE)
    except AnalysisException:
        return spark.createDataFrame([], schemas.CRAWL_STATE)


def save_state(state: DataFrame, root: str, version: int) -> str:
    """Write a snapshot beside the others: a reader never sees half of one, and a plan may still read the one before."""
    path = f"{root}/v={version}"
    state.write.mode("overwrite").parquet(path)
    return path


def replace_state(state: DataFrame, root: str) -> None:
    """Make ``state`` the last snapshot below ``root``. It may have been read from there, so it is written beside it first."""
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(f"{root}/next")
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    system = path("next").getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(path("last"), True)
    system.rename(path("next"), path("last"))


def save_feedback(rows: DataFrame, path: str) -> None:
    """Append feedback to the folder of its day."""
    rows.withColumn("date", F.date_format("timestamp", "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)


def day_file(ts):
    return F.concat(F.lit("feedback_"), F.date_format(ts, "yyyy-MM-dd"), F.lit(".json"))


def write_link_reports(path: str, links: dict[str, DataFrame], mapping: DataFrame) -> DataFrame:
    """Write a crawl's link lists (name -> a table with ``url``), sorted, and its map of pages to files (url, file); returns
    the counts, one row (name, n) a list, which are written too.
    """
    counts = None
    for name, rows in links.items():
        report = crawl.link_report(rows, "url")
        report.write.mode("overwrite").json(f"{path}/links/list={name}")
        one = report.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    mapping.select("url", "file").orderBy("url").write.mode("overwrite").json(f"{path}/url_to_file")
    one = mapping.agg(F.lit("mapped").alias("name"), F.count("*").alias("n"))
    counts = one if counts is None else counts.unionByName(one)
    counts.write.mode("overwrite").json(f"{path}/counts")
    return counts


def dataset(spark: SparkSession, root: str, name: str, description: str = "") -> str:
    """The folder of a named data set below ``root``, with a row that describes it; one that is there stays as it is."""
    path = f"{root}/{name}"
    if not exists(spark, f"{path}/about"):
        spark.createDataFrame([(name, description)], "name string, description string").coalesce(1).write.json(f"{path}/about")
    return path


def upload_summary(summary: DataFrame, root: str, name: str, result: str) -> str:
    """Append a result's summary, one row, to a data set as text; returns the data set's folder."""
    path = dataset(summary.sparkSession, root, name)
    row = summary.select(F.lit("eval_summary").alias("type"), F.lit(result).alias("result_name"), F.to_json(F.struct("*")).alias("summary"), F.lit("local_eval").alias("source"))
    row.write.mode("append").json(f"{path}/summaries")
    return path


def write_reports(rows: DataFrame, path: str) -> DataFrame:
    """Write a crawl's rows, and their counts by status and reason, which are returned."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    counts = rows.groupBy("status", "reason").agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").json(f"{path}/counts")
    return counts


WEB_RESULT = "array<struct<title:string,url:string,content:string,score:double>>"


def web_results(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Web search answers, a list or an object with ``results``, as rows; entries without content go, plain text is one entry."""
    answers = answers.withColumn("__raw", F.coalesce(raw, F.lit("")))
    listed = F.from_json("__raw", WEB_RESULT)
    within = F.from_json("__raw", f"results {WEB_RESULT}")["results"]
    single = F.from_json("__raw", "title string, url string, content string, score double")
    looks = F.substring(F.ltrim("__raw"), 1, 1)
    plain = F.struct(F.lit("").alias("title"), F.lit("").alias("url"), F.col("__raw").alias("content"), F.lit(0.0).alias("score"))
    entries = F.when(looks == "[", listed).when((looks == "{") & within.isNotNull(), within).when(looks == "{", F.array(single)).otherwise(F.array(plain))
    rows = answers.select(*(c for c in answers.columns if c not in ("__raw", raw)), F.posexplode(entries).alias("position", "r"))
    text = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    return rows.select("*", text("title").alias("title"), text("url").alias("url"), text("content").alias("content"), F.coalesce("r.score", F.lit(0.0)).alias("score"), F.lit("web").alias("source_type")).drop("r").where(F.trim("content") != "")


def upsert_cases(cases: DataFrame, path: str) -> int:
    """Append the cases whose id the stored set doesn't hold; returns how many."""
    spark = cases.sparkSession
    fresh = evalset_new(cases, spark.read.json(path)) if exists(spark, path) else cases
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    fresh.unpersist()
    return n


def evalset_new(cases: DataFrame, existing: DataFrame) -> DataFrame:
    from ..operators.metrics import new_cases

    return new_cases(cases, existing)
