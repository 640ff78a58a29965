"""The thin queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, jaccard_join, mixing, quality, sharding, simhash, substring_dedup, token_count, toxicity
from .scratch import Scratch


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir), width=3, num=90, den=100)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_chunks", "repeat_words", "removed_words", "removed_chars", "first_ids", "text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = Scratch(spark, "prints").table(simhash.compare_edited(_documents(spark, sf_dir)))
    return simhash.with_near(prints, F.col("doc_id") % 100 == 0)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_substring_dedup, op3_html_extraction, op4_simhash, op5_sharding, op6_quality_rules, op7_bpe, op8_mixing, op9_token_counts, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    """op6 and op8; the others are held against brute force in tests/llm."""
    word = r"[^\x20\x09-\x0D]+"
    op8 = f"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{word}')) as bigint) as size from documents),
        s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
        w as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
        r as (select *, row_number() over (order by cast(3 * source_size as double) / weight, source asc nulls last) as nth from w),
        l as (select *, cast(sum(source_size) over () - coalesce(sum(3 * source_size) over (order by nth rows between unbounded preceding and 1 preceding), 0) as double)
            / cast(sum(weight) over (order by nth rows between current row and unbounded following) as double) as level from r),
        t as (select source, source_size, least(cast(3 * source_size as double), (select max(level) from l) * weight) as target from l),
        p as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole,
            coalesce(sum(d.size) over (partition by d.source order by md5(cast(d.doc_id as varchar) || '|8'), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
            from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target, cast(whole * size + greatest(0, least(size, floor(target - whole * source_size) - before)) as bigint) as taken from p"""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    phrases = "|".join(quality.BOILERPLATE)
    bare = "regexp_replace(x, '[#*$%&|<>]', '', 'g')"
    good = f"""(regexp_matches(x, '[\\p{{L}}\\p{{N}})\\]][.!?…:;][\"\'\'”’»)\\]]*$') and (length(x) - length({bare})) * 20 <= length(x)
        and (length(x) - length(regexp_replace(x, '\\p{{Lu}}{{2,}}', '', 'g'))) * 3 <= length(x) and (length(x) - length(regexp_replace(x, '[!?]{{2,}}', '', 'g'))) * 20 <= length(x)
        and not (n <= 40 and regexp_matches(x, '(?i){phrases}')) and not stutters)"""
    op6 = f"""with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{word}') as w from documents),
        g as (select doc_id, i, count(*) over (partition by doc_id, h) as n from (select doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: hash(list_slice(w, i, i + 7)))) as h, unnest(range(1, len(w) - 6)) as i from d where len(w) > 8) a),
        c as (select doc_id, count(distinct i + k) as n from (select doc_id, i, unnest(range(0, 8)) as k from g where n > 1) b group by doc_id),
        l as (select *, regexp_split_to_array(x, '[ \\t]') as s from (select doc_id, line, trim(line, {spaces}) as x from (select doc_id, unnest(string_split(t, chr(10))) as line from d) e) y),
        m as (select *, len(regexp_extract_all(x, '{word}')) as n, len(list_filter(range(1, greatest(1, len(s) - 2)),
            lambda i: s[i] = s[i + 1] and s[i] = s[i + 2] and s[i] = s[i + 3] and s[i] <> '')) > 0 as stutters from l where x <> ''),
        v as (select doc_id, count(*) as lines, count(distinct line) as kinds, count(*) filter (where not {good}) as bad, sum(n) filter (where {good}) as good_words,
            sum(length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))) filter (where {good}) as good_chars from m group by doc_id),
        f as (select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
            cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(v.lines - v.kinds, 0) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
            cast(coalesce(v.lines, 0) as bigint) as n_lines, cast(coalesce(v.bad, 0) as bigint) as n_bad_lines, coalesce(good_words, 0) as gw, coalesce(good_chars, 0) as gc from d left join v on d.doc_id = v.doc_id left join c on d.doc_id = c.doc_id)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
            not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and gw >= 20 and 1 - gc / cast(word_chars as double) <= 0.3 as kept, n_lines, n_bad_lines from f"""
    return {"op6_quality_rules": op6, "op8_mixing": op8}
