"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.progress import OUT, Reader, State, fold_rows


def progress_stream(events: DataFrame, now_ms: int) -> DataFrame:
    """A stream of progress events -> the outcome of each; a reader's books and event ids are kept as state, ids for 30 days."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        reader = Reader()
        if held.exists:
            books, seen = json.loads(held.get[0])
            reader = Reader({int(b): State(*s) for b, s in books.items()}, {int(e): t for e, t in seen.items()})
        out = fold_rows(pd.concat(list(batches)), now_ms, reader)
        reader.forget(now_ms)
        held.update((json.dumps([{b: astuple(s) for b, s in reader.books.items()}, reader.seen], default=lambda x: x.item()),))
        yield out

    return events.groupBy("user_id").applyInPandasWithState(step, OUT, "reader string", "append", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Events once per reader and event id, as long as copies come within `late` (the retention of heartbeats)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Reading sessions per user: events less than `gap` apart."""
    span = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", span.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def per_window(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and mean values per tumbling window and kind of event."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
