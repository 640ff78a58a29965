"""Alignments as portable files: gzipped JSON with one array per column of the segments. What is wrong with a file is a value, not an error."""

from __future__ import annotations

import gzip
import os
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from lectern.functions import slug

#: The ending, the version read, fingerprint schemes, the columns in order with the type each holds.
EXTENSION, VERSION = ".rpalign", 1
TEXT_SCHEME, TIME_SCHEME = "t1:", "a1:"
COLUMNS = {
    "sentenceIds": "string", "spineIdx": "bigint", "sentenceOrd": "bigint", "startMs": "bigint", "endMs": "bigint", "confidence": "double", "source": "string", "uncertaintyMs": "bigint",
}
KEY_IN_NAME = 12
#: What schema_of_variant says of an array whose values have the type; an empty array is one of VOID.
_SHAPES = {"string": "STRING", "bigint": "BIGINT", "double": r"(BIGINT|DOUBLE|DECIMAL\([0-9, ]+\))"}


@F.pandas_udf(StringType())
def unzipped(raw: pd.Series) -> pd.Series:
    """The text of gzipped UTF-8, null where it isn't that."""

    def text(b: bytes | None) -> str | None:
        try:
            return gzip.decompress(b).decode("utf-8", errors="replace") if b else None
        except (OSError, EOFError, zlib.error):
            return None

    return raw.map(text).astype(object).where(lambda s: s.notna(), None)


@F.pandas_udf(BinaryType())
def zipped(text: pd.Series) -> pd.Series:
    """Gzip of UTF-8 text, the same for the same text."""
    return text.map(lambda t: gzip.compress((t or "").encode(), mtime=0))


def _within(values: Column, top: float) -> Column:
    return F.forall(values, lambda x: (x >= 0) & (x <= top))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, content) of the alignment files right in the folder, sorted by path; names with a leading dot are left out, the ending's case doesn't matter."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.filter(F.lower("name").endswith(EXTENSION) & ~F.col("name").startswith(".")).orderBy("path")


def of_pair(files: DataFrame, key: Column) -> Column:
    """Whether a file of listed() holds the pair with this key, whatever the book is called now."""
    return F.col("name").endswith(F.concat(F.lit("["), F.substring(key, 1, KEY_IN_NAME), F.lit("]" + EXTENSION)))


def decoded(files: DataFrame, tag: str, content: str = "content") -> DataFrame:
    """files with `reason` (null: readable), `doc` (the document as a variant) and `segments` (array of structs, null if refused).

    `tag` is the format the files have to name. Reasons, the first that holds: not-gzip, not-json, not-object, no-format,
    other-format, no-version, newer-version, shape, text-scheme, timeline-scheme, ragged:<column>. All but gzip is native.
    """
    v = F.col("doc")
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    shape = lambda path: F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))
    rows = files.withColumn("json", unzipped(F.col(content))).withColumn("doc", F.try_parse_json("json"))
    version, count = get("formatVersion", "bigint"), get("segmentCount", "bigint")
    fine = [shape("segmentCount") == "BIGINT", count >= 0, shape("pairKey") == "STRING", shape("ebook.textFingerprint") == "STRING", shape("audio.timelineFingerprint") == "STRING"]
    ragged = []
    for name, kind in COLUMNS.items():
        path = f"segments.{name}"
        values = get(path, f"array<{kind}>")
        fine += [shape(path).rlike(f"^ARRAY<(VOID|{_SHAPES[kind]})>$"), ~F.exists(values, lambda x: x.isNull())]
        if kind != "string":
            fine.append(_within(values, 1.0 if kind == "double" else 2.0**62))
        ragged.append(F.when(F.size(values) != count, f"ragged:{name}"))
    ok = F.lit(True)
    for test in fine:
        ok = ok & F.coalesce(test, F.lit(False))
    format_shape, version_shape = F.coalesce(shape("format"), F.lit("")), F.coalesce(shape("formatVersion"), F.lit(""))
    reason = F.coalesce(
        F.when(F.col("json").isNull(), "not-gzip"), F.when(v.isNull(), "not-json"), F.when(~F.schema_of_variant(v).startswith("OBJECT"), "not-object"),
        F.when(format_shape != "STRING", "no-format"), F.when(get("format", "string") != tag, "other-format"),
        F.when((version_shape != "BIGINT") | (version < 1), "no-version"), F.when(version > VERSION, "newer-version"), F.when(~ok, "shape"),
        F.when(~get("ebook.textFingerprint", "string").startswith(TEXT_SCHEME), "text-scheme"),
        F.when(~get("audio.timelineFingerprint", "string").startswith(TIME_SCHEME), "timeline-scheme"), *ragged,
    )
    zip_ = F.arrays_zip(*[get(f"segments.{name}", f"array<{kind}>").alias(name) for name, kind in COLUMNS.items()])
    return rows.withColumn("reason", reason).withColumn("segments", F.when(F.col("reason").isNull(), zip_)).drop("json")


def document(tag: str, pair_key: Column, text_print: Column, time_print: Column, segments: Column) -> Column:
    """The JSON of a pair from an array of structs with the fields of COLUMNS in reading order."""
    columns = F.struct(*[F.transform(segments, _field(name)).alias(name) for name in COLUMNS])
    return F.to_json(F.struct(
        F.lit(tag).alias("format"), F.lit(VERSION).alias("formatVersion"), F.struct(text_print.alias("textFingerprint")).alias("ebook"),
        F.struct(time_print.alias("timelineFingerprint")).alias("audio"), pair_key.alias("pairKey"), F.size(segments).alias("segmentCount"), columns.alias("segments"),
    ))


def file_name(author: str | None, title: str | None, key: str) -> str:
    return f"{slug(author, 'Unknown Author')} - {slug(title)} [{key[:KEY_IN_NAME]}]{EXTENSION}"


def write(pairs: DataFrame, folder: str) -> DataFrame:
    """Writes pairs(key, author, title, json) as one file each into a folder that all executors share; (key, name, bytes).

    A file comes into being by a rename, so a task that runs again leaves the same; older files of the same pair go.
    Nothing is written before the result is read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            old: dict[str, list[str]] = {}
            for name in os.listdir(folder):
                if name.endswith(EXTENSION) and not name.startswith("."):
                    old.setdefault(name[-KEY_IN_NAME - len(EXTENSION) - 2 :], []).append(name)
            made = []
            for key, author, title, json in zip(batch["key"], batch["author"], batch["title"], batch["json"], strict=True):
                name, raw = file_name(author, title, key), gzip.compress((json or "").encode(), mtime=0)
                part = os.path.join(folder, f".{key}.{os.getpid()}.part")
                with open(part, "wb") as f:
                    f.write(raw)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(part, os.path.join(folder, name))
                for stale in old.get(name[-KEY_IN_NAME - len(EXTENSION) - 2 :], []):
                    if stale != name and os.path.exists(os.path.join(folder, stale)):
                        os.remove(os.path.join(folder, stale))
                made.append((key, name, len(raw)))
            yield pd.DataFrame(made, columns=["key", "name", "bytes"])

    return pairs.select("key", "author", "title", "json").mapInPandas(run, "key string, name string, bytes bigint")
