"""Mixing sources to target weights by capped water-filling, in built-in functions only.

A source's target is its weight's share of all words, but at most `max_epochs` times its own words; what
that leaves over is reshared by weight until no target is above its cap. With sources in order of
cap / weight that fixed point has a closed form: the water level is the largest of
(total - caps before) / (weights from here on). A document is then taken floor(target / source words)
times, and the rest of the target is taken in a seeded order, the last document in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import prefix_sum
from .scratch import Scratch
from .words import words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 8


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, weight, target. Sources by code point, null last, take the weights in turn.

    Only this table of one row a source is ordered as a whole. Without words every target is 0.
    """
    each = sizes.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(source).asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), nth % len(weights) + 1))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col(source).asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    each = each.withColumn("cap", F.col("source_size") * max_epochs)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double") / F.sum(
        "weight"
    ).over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    each = each.withColumn("__level", level).withColumn("__level", F.max("__level").over(whole))
    return each.select(source, "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("__level") * F.col("weight")).alias("target"))


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, row: str | None = None
) -> DataFrame:
    """One row a document: key, source, size, source_size, target, taken, whole, part, and `row` (a number of the row) if it is given.

    taken = whole * size + part words; part < size only for the one document of a source at which its target
    is reached. Null texts have size 0 and are taken 0 words. Rows repeated as they are share the words of
    their turns; rows without a key are documents like any others. Other columns of df are left out.
    """
    sizes = Scratch(df.sparkSession, "mix").table(df.select(F.col(key).alias("__key"), F.col(source).alias("__source"), F.size(words(F.col(text))).cast("long").alias("__size"), *([F.col(row).alias("__row")] if row else [])))
    goals = targets(sizes, "__source", "__size", weights, max_epochs).withColumnRenamed("__source", "__s")
    rows = prefix_sum(sizes, ["__source"], "__key", F.col("__size"), "__before", seed, "__row" if row else None)
    rows = rows.join(goals, F.col("__source").eqNullSafe(F.col("__s")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("whole", whole)
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__before"))).cast("long"))
    return rows.select(
        F.col("__key").alias(key), F.col("__source").alias(source), F.col("__size").alias("size"), "source_size", "target",
        (F.col("whole") * F.col("__size") + F.col("part")).alias("taken"), "whole", "part", *([F.col("__row").alias(row)] if row else []),
    )


def sample(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed corpus: df's columns, a row for each time a document is taken; a part is its first words, one blank between them.

    Rows are numbered in a scratch table first and the plan comes back by that number, so repeated rows and rows
    without a key are taken as often as the mix says, like any others. Documents without words are never taken.
    """
    rows = Scratch(df.sparkSession, "sample").table(df.withColumn("__nth", F.monotonically_increasing_id()))
    plan = mix(rows, key, text, source, **how, row="__nth").select(F.col("__nth").alias("__id"), F.col("size").alias("__n"), F.col("whole").alias("__whole"), F.col("part").alias("__part"))
    rows = rows.join(plan.filter("__whole > 0 or __part > 0"), F.col("__nth") == F.col("__id"))
    takes = F.concat(F.array_repeat(F.col("__n"), F.col("__whole").cast("int")), F.when(F.col("__part") > 0, F.array("__part")).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("__take", F.explode(takes))
    head = F.array_join(F.slice(words(F.col(text)), F.lit(1), F.col("__take").cast("int")), " ")
    cut = F.when(F.col("__take") < F.col("__n"), head).otherwise(F.col(text))
    return rows.select(*[(cut.alias(c) if c == text else F.col(c)) for c in df.columns])
