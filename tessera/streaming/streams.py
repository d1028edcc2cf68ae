"""Streams: daily feedback, incremental ingestion and state of conversations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = ("event_type",), value: str = "value", delay: str = "1 day") -> DataFrame:
    """Counts, sums and means of each day; the same plan on a batch and, with a watermark for late rows, on a stream."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(ts, delay)
    grouped = timed.groupBy(F.window(ts, "1 day").alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *by, "n", "total", "mean")


def sessions(events: DataFrame, ts: str = "ts", by: str = "user_id", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: rows no further apart than ``gap``."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(ts, gap)
    return timed.groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def ingest(pages: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Micro-batches of new pages given to ``apply``; without an interval, all that is there, then the query ends."""
    writer = pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def conversation_steps(turns: DataFrame, idle: int | None = None) -> DataFrame:
    """(conv_id, turns, rewrites) of streamed turns (conv_id, rewritten), kept as state of each conversation; with
    ``idle`` (milliseconds) a conversation without turns for so long is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, rewrites = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            rewrites += int(b["rewritten"].fillna(0).sum())
        state.update((n, rewrites))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "rewrites": [rewrites]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turns long, rewrites long", "n long, rewrites long", "update", timeout)


def standalone_messages(turns: DataFrame, idle: int | None = None) -> DataFrame:
    """(conv_id, turn, text, name) of streamed turns (conv_id, turn, role, text): each user message with the last name of the turns
    before it, which is each conversation's state; ``plans.flow.with_reference`` makes the question of both. Turns of one
    micro-batch count in their order; with ``idle`` (milliseconds) a conversation without turns for so long is forgotten.
    """
    from ..plans.flow import NAMES, NO_NAMES

    names = re.compile(NAMES)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("turn")  # a conversation's turns of one micro-batch
        out = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"]):
            if role == "user":
                out.append((key[0], turn, text, name))
            found = [w for w in names.findall(text or "") if w not in NO_NAMES]
            name = found[-1] if found else name
        state.update((name,))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "name"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, text string, name string", "name string", "append", timeout)


def conversation_totals(turns: DataFrame) -> DataFrame:
    """The batch twin of ``conversation_steps``."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.coalesce(F.sum("rewritten"), F.lit(0)).cast("long").alias("rewrites"))
