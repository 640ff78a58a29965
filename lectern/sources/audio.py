"""What a prober says about audio files, out of its JSON. The prober itself isn't run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = "map<string, string>"
SHOWN = (
    f"format struct<duration: string, tags: {TAGS}>, streams array<struct<codec_type: string, codec_name: string, disposition: struct<attached_pic: int>>>, "
    f"chapters array<struct<start_time: string, end_time: string, tags: {TAGS}>>"
)
LONGEST_TAG = 60


def _tag(tags: Column, *names: str) -> Column:
    """The value of the first of the names that there is, without case; of keys that differ in case only, the last."""
    held = lambda name: F.filter(F.map_entries(tags), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(*(F.try_element_at(held(name), F.lit(-1))["value"] for name in names))


def _ms(seconds: Column) -> Column:
    return F.floor(F.coalesce(seconds.try_cast("double"), F.lit(0.0)) * 1000 + 0.5).cast("bigint")


def _listed(value: Column) -> Column:
    """One tag with several values, as taggers write them."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[,;/]"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t).between(1, LONGEST_TAG)))


def _year(value: Column, latest: int) -> Column:
    year = F.nullif(F.regexp_extract(value, "[0-9]{4}", 0), F.lit("")).cast("int")
    return F.when(year.between(1000, latest), year)


def probed(df: DataFrame, json: str = "json", *, this_year: int) -> DataFrame:
    """df with `probe`: duration_ms, title, artist, album, language, narrator, genres, year, codec, has_cover, chapters.

    Keys of tags count without case. A text that isn't JSON, or null, gives a null probe; what is missing in one that
    is gives nulls, 0 ms and empty lists. Years from 1000 to two years ahead of `this_year` count.
    """
    x = F.from_json(json, SHOWN)
    tags = x["format"]["tags"]
    streams = F.coalesce(x["streams"], F.array())
    audio = F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(1))
    cover = F.exists(streams, lambda s: F.coalesce((s["codec_type"] == "video") & (s["disposition"]["attached_pic"] == 1), F.lit(False)))
    chapter = lambda c: F.struct(_tag(c["tags"], "title").alias("title"), _ms(c["start_time"]).alias("start_ms"), _ms(c["end_time"]).alias("end_ms"))
    probe = F.struct(
        _ms(x["format"]["duration"]).alias("duration_ms"),
        _tag(tags, "title").alias("title"),
        _tag(tags, "artist", "album_artist", "composer").alias("artist"),
        _tag(tags, "album").alias("album"),
        _tag(tags, "language").alias("language"),
        _tag(tags, "narrator", "composer").alias("narrator"),
        _listed(_tag(tags, "genre")).alias("genres"),
        _year(_tag(tags, "date", "year", "originalyear"), this_year + 2).alias("year"),
        audio["codec_name"].alias("codec"),
        cover.alias("has_cover"),
        F.transform(F.coalesce(x["chapters"], F.array()), chapter).alias("chapters"),
    )
    is_object = F.get_json_object(json, "$").startswith("{")
    return df.withColumn("probe", F.when(is_object, probe))
