"""Queries over DataFrame operators: n-gram matching, longest chains, monotone filters, progress folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import DIGITS
from lectern.functions.columns import between, slugged
from lectern.functions.romanize import romanized, spelt
from lectern.functions.sanitize import sanitized
from lectern.operators import asof, ngrams, probes, progress
from lectern.sources import audio, portable
from lectern.sources.views import GAP_MIN_MS, NOW_MS, Duck, Spark, with_views

from . import catalog, folds


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(with_views(Spark(sf_dir), sql))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, heard = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ngrams.unique_matches(heard, docs, "item_id", "doc_id", "text")


def join_22_unique_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


def agg_12_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).groupBy("left_key", "right_key").agg(F.count(F.lit(1)).alias("n"), F.min("left_pos").alias("first_pos"), F.max("left_pos").alias("last_pos"))


def win_05_longest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.monotone_anchors(_matches(spark, sf_dir)).groupBy("left_key", "right_key").agg(F.count(F.lit(1)).alias("n"))


def win_08_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, "select conv_id, ord, case when ord % 3 = 2 then start_ms - 40000 else start_ms end as start_ms, end_ms from v_segments")
    return ngrams.monotone_filter(rows, "conv_id", "ord", "start_ms", "end_ms")


def join_13_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = _view(spark, sf_dir, catalog.probes(Spark(sf_dir)))
    segments = _view(spark, sf_dir, "select * from v_segments")
    return asof.asof(probes, segments, ["conv_id"], "t", "start_ms", ["ord", "end_ms"])


def join_15_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Spark(sf_dir)
    probes, gaps = _view(spark, sf_dir, catalog.probes(d)), _view(spark, sf_dir, catalog.gaps())
    return asof.interval_join(probes, gaps, ["conv_id"], "t", "from_ms", "to_ms", GAP_MIN_MS)


def join_26_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _view(spark, sf_dir, "select conv_id, ord, start_ms - 2000 as lo, end_ms + 2000 as hi from v_segments")
    return asof.overlap_join(a, _view(spark, sf_dir, catalog.gaps()), ["conv_id"], ("lo", "hi"), ("from_ms", "to_ms"), GAP_MIN_MS).select("conv_id", "ord", "from_ms")


def stm_01_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _view(spark, sf_dir, f"select *, cast(null as bigint) as base_revision from {folds.LOG} l")
    return progress.reconcile(events, NOW_MS).select("user_id", "book_id", "event_id", "outcome")


def str_09_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as inert HTML and plain text; links to pages of the same folder count as files of the book."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumns({"chapter": F.lit("text/page.xhtml"), "known": F.array(F.lit("text/index.html"))})
    clean = sanitized(pages, "html", "chapter", "known").select("page_id", "clean.*")
    return clean.select("page_id", "html", "text", F.size("assets").cast("bigint").alias("assets"), F.size("anchor_ids").cast("bigint").alias("anchors"))


def str_16_romanize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", romanized(F.col("text")).alias("r")).select("doc_id", "r.chars", F.length("r.chars").cast("bigint").alias("n_chars"))


#: The last book of each shelf goes between its first two, of those that are shown; i and j are the places of these two in the whole shelf.
MOVES = """select shelf_id, max_by(book_id, rank) as book_id, cast(max(case when nth = 1 then rank end) as bigint) as i, cast(max(case when nth = 2 then rank end) as bigint) as j
    from (select *, row_number() over (partition by shelf_id order by rank) as nth from v_shelf where book_id % 10 <> 3) x group by shelf_id having count(*) > 2"""


def _digit(n: Column) -> Column:
    return F.substring(F.lit(DIGITS), (n % len(DIGITS)).cast("int") + 1, F.lit(1))


def snk_12_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row that a move writes: the moved book and its new rank; ranks are places in three digits."""
    rank = lambda n: F.concat(_digit(F.floor(n / 3844)), _digit(F.floor(n / 62)), _digit(n))
    return _view(spark, sf_dir, MOVES).select("shelf_id", "book_id", between(rank(F.col("i")), rank(F.col("j"))).alias("rank"))


def str_13_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank between two digits of each order's, next to each other or not."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 60).alias("i"), F.col("o_custkey").alias("c"))
    low, high = F.col("i"), F.col("i") + 1 + F.col("c") % (61 - F.col("i"))
    return orders.select("id", between(_digit(low), _digit(high)).alias("rank"))


def str_12_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", slugged(F.col("text")).alias("slug"))


def str_17_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of each document as it is read aloud in its language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", romanized(F.col("text"), F.col("lang")).alias("r")).select("doc_id", "r.chars", F.length("r.chars").cast("bigint").alias("n_chars"))


def str_17_cardinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of each order, in whole units up to 12,000, in English words; null above those that are spelt."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") % 12_000).cast("bigint").alias("n"))
    return orders.select("id", "n", spelt(F.col("n"), F.lit("en")).alias("words"))


def src_07_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a prober would show it, its segments as chapters, and what is read out of that; every seventh text is cut short."""
    clock = lambda ms: F.format_string("%.3f", ms / 1000)
    title = lambda x: F.create_map(F.when(x["ord"] % 2 == 0, F.lit("TITLE")).otherwise(F.lit("title")), F.concat(F.lit("part "), x["ord"].cast("string"))).alias("tags")
    seg = _view(spark, sf_dir, "select conv_id, cast(ord as bigint) as ord, start_ms, end_ms from v_segments")
    books = seg.groupBy("conv_id").agg(F.max("end_ms").alias("end_ms"), F.sort_array(F.collect_list(F.struct("ord", "start_ms", "end_ms"))).alias("x"))
    chapters = F.transform("x", lambda x: F.struct(clock(x["start_ms"]).alias("start_time"), clock(x["end_ms"]).alias("end_time"), title(x)))
    tags = F.create_map(F.lit("Album_Artist"), F.concat(F.lit("author "), F.col("conv_id")), F.lit("GENRE"), F.lit(" a ; b/a,, c"), F.lit("Date"), F.concat((F.col("conv_id") % 2000 + 500).cast("string"), F.lit("-01-02")))
    stream = lambda kind, codec, pic: F.struct(F.lit(kind).alias("codec_type"), F.lit(codec).alias("codec_name"), F.struct(pic.cast("int").alias("attached_pic")).alias("disposition"))
    shown = F.struct(
        F.struct(clock(F.col("end_ms")).alias("duration"), tags.alias("tags")).alias("format"),
        F.array(stream("video", "mjpeg", F.col("conv_id") % 3 == 0), stream("audio", "aac", F.lit(0))).alias("streams"), chapters.alias("chapters"),
    )
    json = F.to_json(shown)
    read = audio.probed(books.select("conv_id", F.when(F.col("conv_id") % 7 == 0, F.substring(json, 2, 40)).otherwise(json).alias("json")), this_year=2024)
    ends = F.aggregate("probe.chapters", F.lit(0).cast("bigint"), lambda a, c: a + c["end_ms"])
    return read.select("conv_id", "probe.duration_ms", "probe.artist", F.array_join("probe.genres", "|").alias("genres"), "probe.year", "probe.codec", "probe.has_cover",
        F.when(F.col("probe").isNotNull(), F.size("probe.chapters")).cast("bigint").alias("chapters"), ends.alias("ends"), F.try_element_at("probe.chapters", F.lit(-1))["title"].alias("last_title"))


def str_18_source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the places of the first and last letter that is heard, and whether places never fall."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", romanized(F.col("text")).alias("r")).select("doc_id", "r.source")
    rising = F.forall(F.arrays_zip(F.expr("slice(source, 1, greatest(size(source) - 1, 0))").alias("a"), F.expr("slice(source, 2, size(source))").alias("b")), lambda x: x["b"].isNull() | (x["a"] <= x["b"]))
    return docs.select("doc_id", F.try_element_at("source", F.lit(1)).alias("first_place"), F.try_element_at("source", F.lit(-1)).alias("last_place"), rising.alias("rising"))


#: What is done to each document before it is packed, by conv_id % 10, and the reason that a reader then has to give.
DAMAGE = {1: "other-format", 2: "newer-version", 3: "text-scheme", 4: "timeline-scheme", 5: "ragged:endMs", 6: "not-json", 7: "not-gzip", 8: "no-version"}


def src_09_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of each conversation packed as a portable file, some of them damaged, and read again: the reason of a refusal, and the segments."""
    seg = _view(spark, sf_dir, "select * from v_segments").select("conv_id", F.struct(
        F.concat(F.lit("s"), F.col("ord").cast("string")).alias("sentenceIds"), F.lit(0).cast("bigint").alias("spineIdx"), F.col("ord").cast("bigint").alias("sentenceOrd"), F.col("start_ms").alias("startMs"),
        F.col("end_ms").alias("endMs"), "confidence", "source", F.col("uncertainty_ms").cast("bigint").alias("uncertaintyMs")).alias("x"))
    books = seg.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("x.sentenceOrd").alias("o"), "x"))).alias("s")).select("conv_id", F.transform("s", lambda y: y["x"]).alias("s"))
    case, key = F.col("conv_id") % 10, F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 24)
    scheme = lambda bad, good: F.when(case == bad, "z9:x").otherwise(f"{good}x")
    packed = books.withColumn("json", portable.document("alignment", key, scheme(3, portable.TEXT_SCHEME), scheme(4, portable.TIME_SCHEME), F.col("s")))
    edit = lambda old, new: F.replace(F.col("json"), F.lit(old), F.lit(new))
    json = F.when(case == 1, edit('"format":"alignment"', '"format":"other"')).when(case == 2, edit('"formatVersion":1', '"formatVersion":2')).when(case == 5, edit('"endMs":[', '"endMs":[1,'))
    packed = packed.withColumn("json", json.when(case == 6, F.lit("{")).when(case == 8, edit('"formatVersion":1', '"formatVersion":"1"')).otherwise(F.col("json")))
    raw = F.when(case == 7, F.encode("json", "UTF-8")).otherwise(portable.zipped("json"))
    read = portable.decoded(packed.select("conv_id", raw.alias("content")), "alignment")
    last = F.aggregate("segments", F.lit(None).cast("bigint"), lambda a, x: F.greatest(a, x["endMs"]))
    return read.select("conv_id", "reason", F.when(F.col("segments").isNotNull(), F.size("segments")).cast("bigint").alias("n"), last.alias("end_ms"))


#: Fixed values for the SQL of str_17_cardinals, apart from the rules that the query reads.
EN_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
EN_TENS = "twenty thirty forty fifty sixty seventy eighty ninety"

#: Conversations are minutes long, so probes are closer together than on books of hours.
PROBE_PLAN = probes.Plan(window_ms=1_000, every_ms=9_000)


def win_18_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second probes of each conversation, from its segments as anchors, after the grid has been heard."""
    anchors = _view(spark, sf_dir, "select conv_id as key, start_ms as ms, cast(ord as bigint) * 100 + start_ms % 700 as pos from v_segments")
    books = _view(spark, sf_dir, "select conv_id as key, max(end_ms) as audio_ms, cast(20 as bigint) as allowed from v_segments group by conv_id")
    return probes.refine(anchors, probes.grid(books, PROBE_PLAN), books, PROBE_PLAN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (join_13_operator, join_15_operator, join_22_unique_ngrams, join_26_operator, agg_12_match_stats, win_05_longest_chain, win_08_monotone, stm_01_reconcile)
    found += (str_09_sanitise, str_16_romanize, str_18_source_index, src_09_portable, win_18_refine, src_07_probe, str_17_spoken, str_17_cardinals, snk_12_move, str_12_slug, str_13_between)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    d = Duck()
    once = """(select gram, min(k) as k, min(pos) as pos from (select k, i as pos, substring(t, cast(i + 1 as bigint), 14) as gram from (select k, t, unnest(range(0, length(t) - 13)) as i from
        (select {key} as k, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') as t from {table}) a where length(t) >= 14) b) c group by gram having count(*) = 1)"""
    matches = f"""select l.k as left_key, r.k as right_key, l.pos as left_pos, r.pos as right_pos from {once.format(key='item_id', table='benchmark')} l join {once.format(key='doc_id', table='documents')} r on l.gram = r.gram"""
    segments = "select conv_id, ord, start_ms, end_ms from v_segments"
    below = lambda x: f"case when {x} < 20 then u[{x} + 1] when {x} % 10 = 0 then t[{x} // 10 - 1] else t[{x} // 10 - 1] || ' ' || u[{x} % 10 + 1] end"
    units, tens = (f"string_split('{x}', ' ')" for x in (EN_UNITS, EN_TENS))
    return {
        "str_17_cardinals": f"""select id, n, case when n > 9999 then null when n = 0 then 'zero' else concat_ws(' ', case when n >= 1000 then u[n // 1000 + 1] || ' thousand' end,
            case when n % 1000 >= 100 then u[n % 1000 // 100 + 1] || ' hundred' end, case when n % 100 > 0 then {below("(n % 100)")} end) end as words
            from (select o_orderkey as id, cast(floor(o_totalprice) as bigint) % 12000 as n, {units} as u, {tens} as t from orders) x""",
        "snk_12_move": with_views(d, f"""select shelf_id, book_id, '00' || case when j - i > 1 then substring('{DIGITS}', (i + j) // 2 + 1, 1) else substring('{DIGITS}', i + 1, 1) || 'V' end as rank from ({MOVES}) m"""),
        "str_13_between": f"""select id, case when j - i > 1 then substring('{DIGITS}', cast((i + j) // 2 + 1 as bigint), 1) else substring('{DIGITS}', cast(i + 1 as bigint), 1) || 'V' end as rank
            from (select o_orderkey as id, o_orderkey % 60 as i, o_orderkey % 60 + 1 + o_custkey % (61 - o_orderkey % 60) as j from orders) x""",
        "str_12_slug": """select doc_id, coalesce(nullif(trim(substring(trim(regexp_replace(strip_accents(coalesce(text, '')), '[^A-Za-z0-9]+', ' ', 'g')), 1, 60)), ''), 'Untitled') as slug from documents""",
        "src_07_probe": with_views(d, """select conv_id, case when ok then end_ms end as duration_ms, case when ok then 'author ' || conv_id end as artist, case when ok then 'a|b|c' end as genres,
            case when ok and y between 1000 and 2026 then y end as year, case when ok then 'aac' end as codec, case when ok then conv_id % 3 = 0 end as has_cover, case when ok then n end as chapters,
            case when ok then ends end as ends, case when ok then 'part ' || last end as last_title from (select conv_id, conv_id % 7 <> 0 as ok, cast(conv_id % 2000 + 500 as integer) as y,
            max(end_ms) as end_ms, count(*) as n, cast(sum(end_ms) as bigint) as ends, max(ord) as last from v_segments group by conv_id) x"""),
        "join_13_operator": with_views(d, f"select p.conv_id, p.t, s.ord, s.end_ms from ({catalog.probes(d)}) p asof left join ({segments}) s on p.conv_id = s.conv_id and p.t >= s.start_ms"),
        "join_15_operator": with_views(d, catalog.QUERIES["join_15_gap_containment"](d)),
        "join_26_operator": with_views(d, catalog.QUERIES["join_26_overlap"](d)),
        "stm_01_reconcile": with_views(d, folds.outcomes()),
        "src_09_portable": with_views(d, f"""select conv_id, reason, case when reason is null then n end as n, case when reason is null then end_ms end as end_ms from (select conv_id, count(*) as n, max(end_ms) as end_ms,
            case conv_id % 10 {' '.join(f"when {k} then '{v}'" for k, v in DAMAGE.items())} end as reason from v_segments group by conv_id) x"""),
        "win_08_monotone": with_views(d, folds.monotone(d)),
        "join_22_unique_ngrams": matches,
        "agg_12_match_stats": f"select left_key, right_key, count(*) as n, min(left_pos) as first_pos, max(left_pos) as last_pos from ({matches}) m group by left_key, right_key",
    }
