"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
STRING_MAP = T.MapType(T.StringType(), T.StringType())

RAW_DOCS = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "title", "source_url", "docdata_url", "data_type", "body")])

CHUNKS = T.StructType(
    [T.StructField("docid", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("page_content", T.StringType()), T.StructField("headers", STRING_MAP)]
    + [T.StructField(n, T.StringType()) for n in ("source_url", "docdata_url", "title", "data_type")]
    + [T.StructField("image_map", STRING_MAP), T.StructField("has_image", T.BooleanType()), T.StructField("image_count", T.IntegerType())]
)

EVAL_CASE = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("expected_docids", STRINGS),
        T.StructField("reference_answer", T.StringType()),
        T.StructField("bot_answer", T.StringType()),
        T.StructField("user_rating", T.StringType()),
        T.StructField("user_feedback", T.StringType()),
        T.StructField("dataset_type", T.StringType()),
        T.StructField("tags", STRINGS),
        T.StructField("difficulty", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)

CRAWL_STATE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "hash", "file", "etag", "last_modified", "last_crawled", "source")])

FEEDBACK = T.StructType([T.StructField("id", T.StringType()), T.StructField("timestamp", T.TimestampType())] + [T.StructField(n, T.StringType()) for n in ("user_input", "assistant_response", "feedback_type")])
