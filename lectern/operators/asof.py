"""As-of and interval joins: one union and window for as-of, bucketed equi-joins for intervals; never a nested-loop join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: list[str], at: str, start: str, columns: list[str], forward: bool = False) -> DataFrame:
    """left with `columns` of the right row that starts last at or before `at` (forward: first after it), null if none.

    The rows of one key meet in one sort; each side is read once.
    """
    l = left.select("*", F.col(at).alias("__at"), F.lit(1).alias("__probe"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__r_{c}") for c in columns])
    r = right.select(*on, F.col(start).alias("__at"), F.lit(0).alias("__probe"), *[F.col(c).alias(f"__r_{c}") for c in columns])
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("__at", "__probe")
    w = w.rowsBetween(Window.currentRow, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.first if forward else F.last
    row = pick(F.when(F.col("__probe") == 0, F.struct(*[F.col(f"__r_{c}").alias(c) for c in columns])), ignorenulls=True).over(w)
    return both.withColumn("__row", row).filter("__probe = 1").select(*left.columns, *[F.col(f"__row.{c}").alias(c) for c in columns])


def interval_join(points: DataFrame, spans: DataFrame, on: list[str], at: str, low: str, high: str, width: int, closed: bool = False) -> DataFrame:
    """points joined with the spans of their key that hold `at`: low < at < high, or low <= at < high if closed.

    Spans are listed once for each bucket of `width` they touch, so the join is by equality; choose width
    near the usual length of a span.
    """
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    p = points.withColumn("__b", bucket(F.col(at)))
    s = spans.filter(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    inside: Column = (F.col(low) <= F.col(at)) if closed else (F.col(low) < F.col(at))
    return p.join(s, [*on, "__b"]).filter(inside & (F.col(at) < F.col(high))).drop("__b")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of spans of one key that overlap; each pair once, in the first bucket both touch."""
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    (a, b), (c, d) = left_span, right_span
    l = left.withColumn("__b", F.explode(F.sequence(bucket(F.col(a)), bucket(F.col(b)))))
    r = right.withColumn("__b", F.explode(F.sequence(bucket(F.col(c)), bucket(F.col(d)))))
    first = F.greatest(bucket(F.col(a)), bucket(F.col(c)))
    return l.join(r, [*on, "__b"]).filter((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("__b") == first)).drop("__b")
