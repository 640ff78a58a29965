"""Quality rules: line-first cleaning, in built-in functions only.

Every line is judged by itself: does it close with punctuation, is it navigation (separators, link lists),
is it boilerplate or noise (symbols, shouting, one word over and over)? Lines that fail are removed; a
document that loses more than `max_lost` of its word characters, or keeps fewer than `min_words` words, is
rejected. Documents without a word are rejected. Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACE_RUN, SPACES, let, words

#: Phrases of site furniture, matched without case anywhere in a line.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript",
    "lorem ipsum", "click here", "sign up for our newsletter", "read more", "share this", "log in to", "powered by",
)


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACES))) > 0


def line_ok(line: Column, phrases: Column | None = None) -> Column:
    """The verdict on one line that has a word; a phrase of boilerplate only counts against lines of 40 words at most.

    phrases: whether the line's text holds such a phrase anywhere, where that is known.
    """

    def core_ok(core: Column) -> Column:
        n_chars = F.length(core)
        closes = core.rlike(r"[\p{L}\p{N})\]][.!?…:;][\"'”’»)\]]*$")
        noise = n_chars - F.length(F.translate(core, "#*$%&|<>", ""))
        shouted = n_chars - F.length(F.regexp_replace(core, r"\p{Lu}{2,}", ""))
        bangs = n_chars - F.length(F.regexp_replace(core, r"[!?]{2,}", ""))
        stutter = core.rlike(r"(?<![^\x20\x09])([^\x20\x09-\x0D]+)(?:[\x20\x09]\1){3,}(?![^\x20\x09])")
        furniture = core.rlike("(?i)" + "|".join(BOILERPLATE)) & (F.size(F.split(core, SPACE_RUN)) <= 40)
        if phrases is not None:
            furniture = phrases & furniture
        return closes & (noise * 20 <= n_chars) & (bangs * 20 <= n_chars) & (shouted * 3 <= n_chars) & ~furniture & ~stutter

    return let(F.btrim(line, F.lit(SPACES)), core_ok)


def clean_lines(df: DataFrame, text: str = "text", out: str = "clean_text") -> DataFrame:
    """df with `out`: the text without the lines that fail; blank lines stay where they are."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return df.withColumn(out, F.array_join(F.filter(lines, lambda x: ~has_word(x) | line_ok(x)), "\n"))


def repeat_words(tokens: Column, width: int = 8) -> Column:
    """Words that lie in a window of `width` words found twice or more in the array."""

    def covered(rows: Column) -> Column:
        same = F.filter(
            rows,
            lambda s, j: ((j > 0) & (F.get(rows, j - 1)["h"] == s["h"])) | (F.coalesce(F.get(rows, j + 1)["h"] == s["h"], F.lit(False))),
        )
        starts = F.sort_array(F.transform(same, lambda s: s["i"]))
        return let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width)))), F.lit(0).cast("long"), lambda a, x: a + x
            ),
        )

    def count(t: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(t) - (width - 1)), lambda i: F.xxhash64(F.slice(t, i, width)))
        found = let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
            ),
        )
        return F.when(F.size(t) > width, found).otherwise(F.lit(0).cast("long"))

    return let(tokens, count)


def judge(df: DataFrame, text: str = "text", max_lost: float = 0.3, min_words: int = 20, max_repeat: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document: `keep`, the counts, base_failed, kept, n_lines, n_bad_lines, lost, clean_text.

    base_failed: fewer than `min_words` words, or more than `max_repeat` of the words in repeated 8-word
    windows. kept: not base_failed, and the line rules leave `min_words` words and lose at most `max_lost`
    of the characters in words. Repeated rows are judged alike; other columns of df are left out.

    Words and lines are bound once a text, and the verdict comes out of a generator of one row: a filter on it
    stays above that generator, so the optimizer can't put the text's words in place of their column again.
    """
    bare = lambda c: F.length(F.translate(c, SPACES, "")).cast("long")

    def of_lines(t: Column, w: Column, every: Column) -> Column:
        def verdict(lines: Column, good: Column) -> Column:
            clean = F.array_join(good, "\n")
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeat_words(w).alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.filter(good, has_word))).cast("long").alias("n_bad_lines"),
                clean.alias("clean_text"),
            )

        lower = F.lower(t)
        some = reduce(lambda a, b: a | b, (lower.contains(p) for p in BOILERPLATE))
        good = let(some, lambda phrases: F.filter(every, lambda x: ~has_word(x) | line_ok(x, phrases)))
        return let(F.filter(every, has_word), lambda lines: let(good, lambda g: verdict(lines, g)))

    t = F.coalesce(F.col(text), F.lit(""))
    counted = let(t, lambda x: let(words(x), lambda w: let(F.split(x, "\n"), lambda every: of_lines(x, w, every))))
    rows = df.select(*keep, F.inline(F.array(counted)))
    whole = F.col("n_bad_lines") == 0  # nothing went: nothing to count again
    clean_words = F.when(whole, F.col("n_words")).otherwise(F.size(words(F.col("clean_text"))))
    lost = F.when(F.col("word_chars") == 0, F.lit(1.0)).when(whole, F.lit(0.0)).otherwise(1 - bare(F.col("clean_text")) / F.col("word_chars"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "lost": lost})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost) & (clean_words >= min_words))
