"""Exact n-gram matching: grams that occur once on either side, and the longest chain of them in both orders."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram, pos): every run of n code points of lower-cased letters and digits, from place 0."""
    plain = df.select(F.col(key).alias("key"), F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", "").alias("t")).filter(F.length("t") >= n)
    every = F.regexp_extract_all("t", F.lit(rf"(?=(.{{{n}}}))"), F.lit(1))  # overlapping, in one pass over the text
    return plain.select("key", F.posexplode(every).alias("pos", "gram"))


def once(rows: DataFrame) -> DataFrame:
    """Grams of a side that occur exactly once on it, with key and place; counts are combined before the shuffle."""
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("pos").alias("pos")).filter("n = 1").drop("n")


def unique_matches(left: DataFrame, right: DataFrame, key_left: str, key_right: str, text: str, n: int = 14) -> DataFrame:
    """(left_key, right_key, left_pos, right_pos) for grams that occur once on each side; left is the shorter side."""
    short = once(grams(left, key_left, text, n)).select("gram", F.col("key").alias("left_key"), F.col("pos").alias("left_pos"))
    # only grams of the short side are counted on the long one
    long = once(grams(right, key_right, text, n).join(short.select("gram"), "gram", "left_semi")).select("gram", F.col("key").alias("right_key"), F.col("pos").alias("right_pos"))
    return short.join(long, "gram").select("left_key", "right_key", "left_pos", "right_pos")


def longest_increasing(values: list[int]) -> list[int]:
    """Places of one longest strictly increasing subsequence, by patience piles: n log n."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def monotone_anchors(matches: DataFrame) -> DataFrame:
    """Per pair of texts the matches of one longest chain that rises on both sides. A group is one pair of texts."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["right_pos", "left_pos"], kind="stable")
        return rows.iloc[longest_increasing(rows["left_pos"].tolist())]

    return matches.groupBy("left_key", "right_key").applyInPandas(chain, matches.schema)


def monotone_filter(rows: DataFrame, by: str, order: str, start: str, end: str, slack: int = 1500) -> DataFrame:
    """rows without those that start more than `slack` before the end of the last row kept; dropped rows don't move that end."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        kept, last = [], -1
        for i, (s, e) in enumerate(zip(g[start], g[end], strict=True)):
            if s >= last - slack:
                kept.append(i)
                last = max(s, e)
        return g.iloc[kept]

    return rows.groupBy(by).applyInPandas(fold, rows.schema)
