"""Where to listen again: probes in stretches of a timeline that are not mapped or read at an odd rate, in bounded rounds."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS = "key bigint, start_ms bigint, duration_ms bigint"


@dataclass(frozen=True)
class Plan:
    """Probes of window_ms every every_ms; then at most `rounds` more rounds, together at most `budget` times the first probes, where rates differ by more than `tolerance`."""

    window_ms: int = 8_000
    every_ms: int = 150_000
    rounds: int = 3
    tolerance: float = 0.2
    budget: float = 0.6


def grid(books: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """First probes of books(key, audio_ms); the last is cut at the end. A book without length has none."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("audio_ms") - 1, F.lit(max(1000, plan.every_ms)).cast("bigint"))
    rows = books.filter("audio_ms > 0").select("key", "audio_ms", F.explode(starts).alias("start_ms"))
    return rows.select("key", "start_ms", F.least(F.lit(max(1000, plan.window_ms)), F.col("audio_ms") - F.col("start_ms")).cast("bigint").alias("duration_ms"))


def place(anchors: list[tuple[int, int]], covered: list[tuple[int, int]], audio_ms: int, limit: int, plan: Plan = Plan()) -> list[tuple[int, int]]:
    """(start, duration) of up to `limit` probes, widest stretch first, each in the middle of the widest free part of its stretch.

    anchors are (ms, place in the text) in order, covered are (start, duration). A stretch between anchors counts if it
    is long and its rate differs from the median rate, or is not above 0; one before the first or after the last anchor, if it is long.
    """
    win = max(1000, plan.window_ms)
    long = max(2 * win, math.floor(plan.every_ms / 3 + 0.5))
    if not anchors or limit <= 0:
        return []
    rated = [(a, b, (q - p) / (b - a)) for (a, p), (b, q) in zip(anchors, anchors[1:]) if b - a >= long]
    rising = sorted(r for *_, r in rated if r > 0)
    median = rising[len(rising) // 2] if rising else 0.0
    bound = math.log(1 + max(0.01, plan.tolerance))
    odd = [(a, b) for a, b, r in rated if r <= 0 or median <= 0 or abs(math.log(r / median)) > bound]
    ends = [(a, b) for a, b in ((0, anchors[0][0]), (anchors[-1][0], audio_ms)) if b - a >= long]

    free, at = [], 0  # the timeline without what has been heard
    for start, duration in sorted(covered):
        if start > at:
            free.append((at, start))
        at = max(at, start + duration)
    free.append((at, max(at, audio_ms)))

    made: list[tuple[int, int]] = []
    for a, b in sorted(ends + odd, key=lambda s: s[0] - s[1]):
        if len(made) == limit:
            break
        parts = [(max(a, x), min(b, y)) for x, y in free if x < b and y > a]
        x, y = max(parts, key=lambda p: p[1] - p[0], default=(0, 0))
        if y - x < win:
            continue
        start = max(0, min(math.floor((x + y) / 2 - win / 2 + 0.5), audio_ms - win))
        probe = (start, min(win, audio_ms - start))
        made.append(probe)
        free = [part for x, y in free for part in ((x, min(y, probe[0])), (max(x, sum(probe)), y)) if part[0] < part[1]]
    return made


def refine(anchors: DataFrame, covered: DataFrame, books: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Probes (key, start_ms, duration_ms) to add: anchors(key, ms, pos), covered(key, start_ms, duration_ms), books(key, audio_ms, allowed). A group is one book."""

    def run(found: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        if found.empty:
            return pd.DataFrame({"key": [], "start_ms": [], "duration_ms": []}, dtype="int64")
        found = found.sort_values(["ms", "pos"], kind="stable")
        marks = list(zip(found["ms"].tolist(), found["pos"].tolist(), strict=True))
        done = list(zip(heard["start_ms"].tolist(), heard["duration_ms"].tolist(), strict=True))
        first = found.iloc[0]
        rows = place(marks, done, int(first["audio_ms"]), int(first["allowed"]), plan)
        return pd.DataFrame([(int(first["key"]), *r) for r in rows], columns=["key", "start_ms", "duration_ms"]).astype("int64")

    left = anchors.join(books.filter("allowed > 0"), "key").select("key", "ms", "pos", "audio_ms", "allowed")
    # names of their own: both sides may come from one table
    mine, theirs = left.toDF("key", "ms", "pos", "audio_ms", "allowed"), covered.toDF("key", "start_ms", "duration_ms")
    return mine.groupBy("key").cogroup(theirs.groupBy("key")).applyInPandas(run, WINDOWS)


def rounds(books: DataFrame, listen: Callable[[DataFrame], DataFrame], plan: Plan = Plan()) -> DataFrame:
    """All probes of books(key, audio_ms), with the round that asked for them: the grid is round 0.

    `listen` gives the anchors of all probes so far. All books take part in a round together; rounds end when none asks for more.
    Lineage is cut after each round by checkpoint(), in the folder of spark.checkpoint.dir.
    """
    first = grid(books, plan)
    heard = first.withColumn("round", F.lit(0)).checkpoint()
    allowed = heard.groupBy("key").agg(F.floor(F.count(F.lit(1)) * F.lit(max(0.0, plan.budget))).cast("bigint").alias("most"))
    for turn in range(1, plan.rounds + 1):
        spent = heard.groupBy("key").agg(F.count_if(F.col("round") > 0).alias("spent"))
        left = books.join(allowed, "key").join(spent, "key").select("key", "audio_ms", (F.col("most") - F.col("spent")).alias("allowed"))
        extra = refine(listen(heard), heard.select("key", "start_ms", "duration_ms"), left, plan).withColumn("round", F.lit(turn)).checkpoint()
        if extra.isEmpty():
            break
        heard = heard.unionByName(extra).checkpoint()
    return heard
