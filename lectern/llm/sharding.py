"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in a shard by its place in a seeded order, so
counts are at most one apart; then rounds of joins move linked documents towards the shard that holds most
of their group. A round only swaps: a document moves from s to t against one that wants from t to s, or
against a document of t without links. So counts stay as they are, and no link is ever listed as a pair:
a group is known by its counts per shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .order import row_index
from .scratch import Scratch

ROUNDS = 8
SEED = 5


def _swaps(wants: dict[tuple[int, int], int], free: dict[int, int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many of those who want from s to t may go, and how many unlinked documents of t go to s for it."""
    go: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    rest: dict[tuple[int, int], int] = {}
    for (s, t), n in sorted(wants.items()):
        go[s, t] = min(n, wants.get((t, s), 0))
        rest[s, t] = n - go[s, t]
    for t in sorted({t for _, t in wants}):
        left, asked = free.get(t, 0), sum(n for (_, b), n in rest.items() if b == t)
        share = min(1.0, left / asked) if asked else 0.0
        for (s, b), n in sorted(rest.items()):
            if b == t and n:
                x = min(left, n if share >= 1 else int(n * share) + (1 if left else 0), n)
                go[s, t] += x
                back[t, s] = x
                left -= x
    return go, back


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of at most shards * shards rows: a bound set by a parameter, whatever the data."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def propagate(nodes: DataFrame, shards: int, key: str = "id", group: str = "group", rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """nodes (key, group; group null: no links) with `shard`, counts at most one apart.

    Each round writes its labels under the shared folder. Rounds end when nothing can move any more. Ties of
    a group go to the shard of the lowest number. Rows repeated as they are may come apart like any others.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "shards")
    state = scratch.table(row_index(nodes.select(key, group), [], key, "__i", seed).select(key, group, (F.col("__i") % shards).cast("int").alias("shard")))
    for turn in range(rounds):
        linked = state.filter(F.col(group).isNotNull())
        per = linked.groupBy(group, "shard").agg(F.count(F.lit(1)).alias("n"))
        free = {r["shard"]: r["n"] for r in state.filter(F.col(group).isNull()).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        shut = [s for s in range(shards) if not free.get(s)]
        # a shard without unlinked documents attracts nobody but in exchange; a group's documents there stay
        open_n = F.when(F.col("shard").isin(shut), 0).otherwise(F.col("n")) if shut else F.col("n")
        best = per.groupBy(group).agg(
            F.max(F.struct(open_n.alias("n"), (-F.col("shard")).alias("s"))).alias("top"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held")
        )  # a group has at most one entry a shard
        best = best.select(F.col(group).alias("__g"), F.col("top.n").alias("__n"), (-F.col("top.s")).alias("__to"), "held")
        moving = linked.join(best, F.col(group) == F.col("__g"))
        here = F.element_at("held", F.col("shard"))
        moving = moving.filter((F.col("shard") != F.col("__to")) & ((F.col("__n") > here) | ((F.col("__n") == here) & (F.col("__to") < F.col("shard")))))
        moving = scratch.table(moving.select(key, group, "shard", F.col("__to").alias("to")))
        wants = {(r["shard"], r["to"]): r["n"] for r in moving.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        go, back = _swaps(wants, free)
        if not any(go.values()):
            break
        quota = _small(spark, [(s, t, n) for (s, t), n in go.items() if n], "`from` int, dest int, quota long")
        movers = row_index(moving, ["shard", "to"], key, "__i", seed + turn + 1).join(quota, (F.col("shard") == F.col("from")) & (F.col("to") == F.col("dest")) & (F.col("__i") < F.col("quota")))
        moved = movers.select(F.col(key).alias("__k"), F.col("to").alias("__to"))
        spans, at = [], {}
        for (t, s), n in sorted(back.items()):
            if n:
                spans.append((t, s, at.get(t, 0), at.get(t, 0) + n))
                at[t] = at.get(t, 0) + n
        if spans:
            ranges = _small(spark, spans, "`from` int, dest int, lo long, hi long")
            loose = row_index(state.filter(F.col(group).isNull()), ["shard"], key, "__i", seed + turn + 1)
            loose = loose.join(ranges, (F.col("shard") == F.col("from")) & (F.col("__i") >= F.col("lo")) & (F.col("__i") < F.col("hi")))
            moved = moved.unionAll(loose.select(F.col(key).alias("__k"), F.col("dest").alias("__to")))
        after = state.join(moved, F.col(key) == F.col("__k"), "left").select(key, group, F.coalesce("__to", "shard").alias("shard"))
        before, state = state, scratch.table(after)
        scratch.drop(before, moving)
    return state


def shard(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row a document: key, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law).

    size: UTF-8 bytes and 8; a null text has 8 and the CRC of no bytes, and is linked with nothing; empty
    texts are equal texts. Slots run from 0 in each shard, in a seeded order. As many rows come out as went in:
    rows that share a key, or have none, are numbered apart by text and place among their equals.
    """
    t = F.col(text)
    spark = df.sparkSession
    rows = df.select(
        F.col(key).alias("id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(t.cast("binary")).alias("digest"),
    )
    nth = F.row_number().over(Window.partitionBy("id", "digest").orderBy("size"))
    base = Scratch(spark, "texts").table(rows.withColumn("uid", F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("none")), F.coalesce("digest", F.lit("none")), nth.cast("string"))))
    twins = base.filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("group"))
    nodes = base.select("uid", "digest").join(twins, F.col("digest") == F.col("group"), "left").select("uid", "group")
    placed = row_index(propagate(nodes, shards, "uid", "group", rounds, seed), ["shard"], "uid", "slot", seed)
    placed = placed.select(F.col("uid").alias("__id"), "shard", "slot")
    return base.join(placed, F.col("uid") == F.col("__id")).select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
