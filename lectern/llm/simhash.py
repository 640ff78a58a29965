"""Document fingerprints: SimHash over weighted word pairs, and permuted block tables, in built-in functions only.

Terms are pairs of neighbouring words (the last word stands alone); a term of eight or more characters
weighs 2, others 1. Each term's 128-bit hash votes for its set bits with its weight; a bit of the
fingerprint is set if more than half of the weight votes for it. Votes are added four to a long (16 bits
each, for at most 16,384 terms), then two to a long, so a text of any length is counted whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import words

BITS = 128
CHUNK = 16_384
LANES4, LANES2, LANE = 0x0001000100010001, 0x0000FFFF0000FFFF, 0xFFFFFFFF
#: Bits that near fingerprints may differ in, and whole blocks that they then share.
RADIUS, AGREE = 3, 2


def terms(text: Column) -> Column:
    """The terms of a text as structs (h, w); none for null and blank texts."""

    def term(tokens: Column) -> Column:
        return F.transform(
            tokens,
            lambda x, i: F.struct(F.xxhash64(x, F.get(tokens, i + 1)).alias("h"), F.when(F.length(x) + F.coalesce(F.length(F.get(tokens, i + 1)), F.lit(0)) >= 8, 2).otherwise(1).alias("w")),
        )

    return F.element_at(F.transform(F.array(words(text)), term), 1)


def fingerprints(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """One row for each row of `by` (a key of rows): by, fingerprint (32 hex digits; all 0 without words).

    If rows are already dealt out by some of `by`, nothing is shuffled.
    """
    each = rows.select(*by, F.posexplode_outer(terms(F.col(text))).alias("__p", "__t"))
    each = each.select(*by, F.expr(f"cast(coalesce(__p, 0) div {CHUNK} as int)").alias("__chunk"), F.col("__t.h").alias("__h"), F.coalesce(F.col("__t.w"), F.lit(0)).cast("long").alias("__w"))
    each = each.withColumn("__h1", F.xxhash64("__h", F.lit(1)))
    votes = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES4)) * F.col("__w")).alias(f"{h}_{k}") for h in ("__h", "__h1") for k in range(16)]
    packed = each.groupBy(*by, "__chunk").agg(F.sum("__w").alias("__all"), *[F.coalesce(v, F.lit(0)).alias(f"__v{i}") for i, v in enumerate(votes)])
    wide = []
    for i in range(32):
        wide.append(F.sum(F.col(f"__v{i}").bitwiseAND(F.lit(LANES2))).alias(f"__a{i}"))
        wide.append(F.sum(F.shiftrightunsigned(f"__v{i}", 16).bitwiseAND(F.lit(LANES2))).alias(f"__b{i}"))
    total = packed.groupBy(*by).agg(F.sum("__all").alias("__all"), *wide)
    halves = []
    for half in (0, 16):
        word = F.lit(0).cast("long")
        for k in range(16):
            for lane in range(4):
                lanes = F.col(f"__{'ab'[lane % 2]}{half + k}")
                count = (F.shiftrightunsigned(lanes, 32) if lane >= 2 else lanes).bitwiseAND(F.lit(LANE))
                word = word.bitwiseOR(F.when(count * 2 > F.col("__all"), F.lit(_signed(1 << (16 * lane + k)))).otherwise(F.lit(0).cast("long")))
        halves.append(F.lpad(F.lower(F.hex(word)), 16, "0"))
    return total.select(*by, F.concat(*halves).alias("fingerprint"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    part = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    out = F.lit(0)
    for i in range(BITS // 32):
        out = out + F.bit_count(part(a, i).bitwiseXOR(part(b, i)))
    return out


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the distance stands for: 1 for equal fingerprints, 0 for unrelated ones."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793) * distance(a, b) / BITS))


def near(prints: DataFrame, asked: Column | None = None, radius: int = RADIUS, agree: int = AGREE) -> DataFrame:
    """(a, b, distance, members): for each fingerprint a of a row that is `asked` (null: all) the others at most `radius` bits away.

    Permuted block tables: the 32 digits are cut into radius + agree blocks, and two such fingerprints agree in
    `agree` whole blocks at least. Each choice of so many blocks is a table, keyed by them together (51 of 128 bits
    for radius 3 and two blocks of five), so that only near fingerprints meet. Equal fingerprints are one class,
    `members` the rows of b's: copies are never listed as pairs. Rows without a fingerprint are left out.
    """
    asks = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    classes = prints.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("members"), F.max(asks).alias("asked"))
    edges = [round(i * BITS / 4 / (radius + agree)) for i in range(radius + agree + 1)]
    cut = [F.substring("fingerprint", edges[i] + 1, edges[i + 1] - edges[i]) for i in range(radius + agree)]
    tables = F.array(*[F.concat_ws(":", F.lit(str(t)), *[cut[i] for i in chosen]) for t, chosen in enumerate(combinations(range(radius + agree), agree))])
    table = classes.select("fingerprint", "members", "asked", F.explode(tables).alias("block"))
    a = table.filter("asked").select(F.col("fingerprint").alias("a"), "block")
    b = table.select(F.col("fingerprint").alias("b"), F.col("block").alias("__block"), "members")
    pairs = a.join(b, F.col("block") == F.col("__block")).filter("a <> b").withColumn("distance", distance(F.col("a"), F.col("b"))).filter(F.col("distance") <= radius)
    return pairs.select("a", "b", "distance", "members").distinct()


def with_near(prints: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """prints with n_near: for rows that are `asked`, the rows of other fingerprints within the radius; null for the others.

    prints is read several times: pass a written table.
    """
    found = near(prints, asked, radius).groupBy("a").agg(F.sum("members").cast("long").alias("n_near"))
    asks = F.coalesce(asked, F.lit(False))
    with_count = prints.filter(asks).join(found, F.col("fingerprint") == F.col("a"), "left").select(*prints.columns, F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
    return with_count.unionAll(prints.filter(~asks).withColumn("n_near", F.lit(None).cast("long")))


def _ranges(ids: DataFrame, low: int, high: int, n: int, per: int) -> Callable[[DataFrame], DataFrame]:
    """How to put rows by `__ord` into ranges (`bucket`) of about `per` rows, however unevenly the ids lie.

    Ranges of equal width first; those with more than 8 * per rows are cut again between their own ends.
    """
    scratch, cuts = Scratch(ids.sparkSession, "ranges"), []
    width = max(1, (high - low + 1) * per // max(1, n))

    def deal(df: DataFrame) -> DataFrame:
        df = df.withColumn("bucket", F.expr(f"cast((__ord - ({low}L)) div {width}L as string)"))
        for i, cut in enumerate(cuts):  # at most n / (8 * per) rows each: half the root of the rows
            at = F.concat_ws(".", "bucket", F.expr(f"cast((__ord - __lo{i}) div __width{i} as string)"))
            df = df.join(F.broadcast(cut), F.col("bucket") == F.col(f"__of{i}"), "left").withColumn("bucket", F.when(F.col(f"__of{i}").isNull(), F.col("bucket")).otherwise(at))
            df = df.drop(f"__of{i}", f"__lo{i}", f"__width{i}")
        return df

    for i in range(8):
        heavy = deal(ids).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("__ord").alias("lo"), F.max("__ord").alias("hi")).filter((F.col("n") > 8 * per) & (F.col("lo") < F.col("hi")))
        step = F.greatest(F.lit(1).cast("long"), F.floor((F.col("hi").cast("double") - F.col("lo") + 1) * per / F.col("n")))
        heavy = scratch.table(heavy.select(F.col("bucket").alias(f"__of{i}"), F.col("lo").alias(f"__lo{i}"), step.alias(f"__width{i}")))
        if not heavy.limit(1).count():
            scratch.drop(heavy)
            break
        cuts.append(heavy)
    return deal


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, rn, key, text, extra, next_text): next by descending key, after the last the first.

    Keys are dealt to ranges of about sqrt(rows) / 4 rows, so both a range and the table of ranges stay small.
    The row after a range's last one comes in as an `extra` row at its end, so one shuffle by range is enough.
    Rows repeated as they are follow each other; rows without a key come after all others.
    """
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    lo, hi = (lo or 0) - 1, hi or 0
    per = max(64, int(n**0.5) // 4)
    own = df.select(F.coalesce(F.col(key), F.lit(lo)).cast("long").alias("__ord"), F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    deal = _ranges(own.select("__ord"), lo, hi, n, per)
    every = Window.partitionBy(F.lit(0))
    ends = deal(own.select("__ord")).groupBy("bucket").agg(F.max("__ord").alias("top"))
    ends = ends.select("bucket", F.coalesce(F.lead("top").over(every.orderBy(F.desc("top"))), F.max("top").over(every)).alias("after"))
    # at most 4 sqrt(rows) + 1 ranges of some 30 bytes: 12 MB for 10 billion rows
    after = own.join(F.broadcast(ends), F.col("__ord") == F.col("after"))
    both = deal(own).select("bucket", "__ord", key, text, F.lit(False).alias("extra")).unionByName(after.select("bucket", "__ord", key, text, F.lit(True).alias("extra")))
    w = Window.partitionBy("bucket").orderBy("extra", F.desc("__ord"), F.desc(text))
    return both.select("bucket", key, text, "extra", F.row_number().over(w).alias("rn"), F.lead(text).over(w).alias("next_text"))


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third of code points replaced by the first as many of the next document.
    Null texts count as empty; rows without a key come last in the order, repeated rows follow each other.
    """
    t, n = F.col(text), F.length(F.col(text))
    third = F.expr(f"cast(length(`{text}`) div 3 as int)")
    edited = F.concat(F.substring(t, F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = with_next(df, key, text).select("bucket", "rn", "extra", key, n.cast("long").alias("n_chars"), t.alias("__text"), edited.alias("__edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("__edited").cast("binary"), 256))
    by = ["bucket", "rn", "extra", key, "n_chars", "edited_sha256"]
    each = rows.select(*by, F.posexplode(F.array("__text", "__edited")).alias("__which", "__text"))
    prints = fingerprints(each, [*by, "__which"], "__text")
    prints = prints.groupBy(*by).agg(*[F.max(F.when(F.col("__which") == i, F.col("fingerprint"))).alias(c) for i, c in enumerate(("fingerprint", "edited_fingerprint"))])
    prints = prints.withColumn("__next", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("rn"))).filter("not extra")
    return prints.select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__next")).alias("near_next"),
    )
