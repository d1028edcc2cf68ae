"""Common blocks against the standard library, and stand-alone questions by batch and stream."""

import difflib
import random
from functools import reduce

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import blocks
from tessera.functions import text as tx
from tessera.plans import derived, flow
from tessera.streaming import streams


def library(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcd ", max_size=60), st.text(alphabet="abcd ", max_size=60))
def test_short_texts(a, b):
    assert blocks.ratio(a, b) == library(a, b)


def test_long_texts_with_popular_characters():
    rng = random.Random(4)
    for n in (150, 199, 200, 201, 400, 900):
        for alphabet in ("ab", "abcdefghij ", "".join(chr(c) for c in range(0x4E00, 0x4E00 + 400))):
            a = "".join(rng.choices(alphabet, k=n))
            cut = sorted(rng.sample(range(n), 6))
            b = "".join(reduce(lambda x, y: y + x, (a[s:e] for s, e in zip([0, *cut], [*cut, n])))) + "".join(rng.choices(alphabet, k=n // 3))
            for x, y in ((a, b), (b, a), (a, a), (a, a[: n // 2]), (a, "")):
                assert blocks.ratio(x, y) == library(x, y), (n, alphabet[:4])


def test_conversations_equal_the_library(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other")), ["conv_id", "turn"])
    rows = pairs.withColumn("s", tx.text_similarity("text", "other")).collect()
    assert rows and all(r["s"] == library(r["text"], r["other"]) for r in rows)


TURNS = [(1, 0, "user", "What is Qwen2?"), (1, 1, "assistant", "A model by Someone"), (1, 2, "user", "How do I train it, and can it run?"), (1, 3, "user", "Thisbe and that"), (2, 0, "user", "does it work"), (2, 1, "assistant", None), (2, 2, "user", None), (3, 0, "user", "Use Swift-2"), (3, 1, "user", "它怎么训练"), (3, 2, "user", "hello")]


def test_standalone_questions(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    want = {(1, 0): "What is Qwen2?", (1, 2): "How do I train Someone, and can it run?", (1, 3): "Thisbe and Someone", (2, 0): "does it work", (2, 2): "", (3, 0): "Use Swift-2", (3, 1): "Swift-2怎么训练", (3, 2): "hello"}
    got = {(r["conv_id"], r["turn"]): (r["question"], r["datasource"]) for r in flow.standalone(df).collect()}
    assert {k: q for k, (q, _) in got.items()} == want and got[3, 2][1] == "chat" and got[1, 2][1] == "docs"
    failed = flow.standalone(df, rewrite=lambda t, n: F.lit(None).cast("string")).collect()
    assert {(r["question"], r["datasource"]) for r in failed if r["conv_id"] == 3} == {("Use Swift-2", "docs"), ("它怎么训练", "docs"), ("hello", "docs")}


def test_standalone_stream_equals_the_batch(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    for k in range(2):  # two micro-batches: later turns meet the state
        spark.createDataFrame([t for t in TURNS if (t[1] > 1) == bool(k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sent = streams.standalone_messages(source).writeStream.format("memory").queryName("standalone").outputMode("append").trigger(availableNow=True).start()
    sent.awaitTermination(120)
    got = spark.table("standalone").select("conv_id", "turn", flow.with_reference(F.col("text"), F.col("name")).alias("question"))
    want = flow.standalone(spark.createDataFrame(TURNS, schema)).select("conv_id", "turn", "question")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


ODD_TURNS = ["Doñll no sigue", "tell of itó and that", "That-One", "x\u0001 this", "How_ is it", "ÑAsk it", "🙂 thiſ is", "Is This-x it", "Iñ", "they\u0001it"]


def test_standalone_questions_equal_sql_on_odd_words(spark, tmp_path):
    turns = [(k, t, r, text) for k, own in enumerate(ODD_TURNS) for t, (r, text) in enumerate([("user", "Ask Qwen"), ("assistant", own), ("user", ODD_TURNS[(k * 3 + 1) % len(ODD_TURNS)])])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    sql = derived.ORACLES["standalone_questions"].replace("from conversations", f"from '{tmp_path}/conversations.parquet/*.parquet'")
    got = derived.standalone_questions(spark, str(tmp_path)).select("conv_id", "turn", "question_hash", "datasource")
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(sql).fetchall())
