"""Prefix sums in a seeded total order, without ever sorting a whole group in one task.

Rows are dealt to 4096 buckets by the first digits of an MD5 of their key; sums of buckets are summed over
the small bucket table (at most 4096 rows a group), and each bucket is ordered by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def seeded(key: str, seed: int) -> Column:
    """The place of a row in the order: a hex string that is the same in every run and engine."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}")))


def prefix_sum(df: DataFrame, group: list[str], key: str, value: Column, out: str, seed: int = 0, tie: str | None = None) -> DataFrame:
    """df with `out`: the sum of value over the rows of its group that come before it.

    The order is the seeded hash of `key`, then `key`, then the value, then `tie`. Null groups and null keys are like any others.
    """
    h, b, v, base = "__hash", "__bucket", "__value", "__base"
    rows = df.withColumn(h, seeded(key, seed)).withColumn(b, F.substring(h, 1, BUCKET_DIGITS)).withColumn(v, value.cast("long"))
    per_bucket = rows.groupBy(*group, b).agg(F.sum(v).alias(base))
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bucket.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(b).alias("__b"), F.coalesce(F.sum(base).over(before), F.lit(0)).cast("long").alias(base)
    )
    on = F.col(b) == F.col("__b")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inner = Window.partitionBy(*group, b).orderBy(h, key, v, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__in", F.coalesce(F.sum(v).over(inner), F.lit(0))).join(bases, on)
    return placed.select(*[F.col(c) for c in df.columns], (F.col(base) + F.col("__in")).cast("long").alias(out))


def row_index(df: DataFrame, group: list[str], key: str, out: str, seed: int = 0) -> DataFrame:
    """df with `out`: 0, 1, 2, ... within each group, in the seeded order of key."""
    return prefix_sum(df, group, key, F.lit(1), out, seed)
