"""Folders of books as tables: listing, quick hashes, grouping of tracks, and what a book's archive holds.

Files are read with Spark's binaryFile source, so any store that Spark reads will do. Listings don't read contents.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is looked for, and how deep.
EBOOKS, AUDIO = ("epub",), ("mp3", "m4a", "m4b", "aac", "ogg", "opus", "flac", "wav")
MAX_DEPTH = 8
EDGE = 65_536
#: Limits on an archive, in bytes, entries and times its own size.
MAX_ARCHIVE, MAX_ENTRY, MAX_TOTAL, MAX_ENTRIES, MAX_RATIO = 400 << 20, 96 << 20, 900 << 20, 20_000, 150
MAX_SPINE = 1_500


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """(root, rel, dir, ext, size, mtime_ms, supported, content) of the files under root that are no deeper than MAX_DEPTH folders; names with a leading dot are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    rel = F.substring(plain(F.col("path")), F.length(plain(F.lit(base.rstrip("/")))) + 2, F.length("path"))
    rows = files.select(F.lit(root).alias("root"), rel.alias("rel"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    parts = F.split("rel", "/")
    rows = rows.filter((F.size(parts) <= MAX_DEPTH + 1) & ~F.exists(parts, lambda x: x.startswith(".")))
    folder = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).otherwise(F.lit("."))
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    return rows.select("root", "rel", folder.alias("dir"), ext.alias("ext"), "size", "mtime_ms", ext.isin(*extensions).alias("supported"), "content")


def quick_hash() -> Column:
    """Changes with a file's size, time, first or last 64 KiB; of rows of scan()."""
    stamp = F.concat_ws(":", F.col("size").cast("string"), F.col("mtime_ms").cast("string")).cast("binary")
    tail = F.when(F.col("size") > EDGE, F.substring("content", -EDGE, EDGE)).otherwise(F.lit(b""))
    return F.substring(F.sha2(F.concat(stamp, F.substring("content", 1, EDGE), tail), 256), 1, 32)


def natural(name: Column) -> Column:
    """A key that sorts '2' before '10', without case."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 18, "0")).otherwise(x)), "")


def audiobooks(files: DataFrame) -> DataFrame:
    """(root, rel, size, hash, tracks): a loose file of the root is a book, and so is each folder, its tracks in natural order."""
    found = files.filter("supported").withColumn("hash", quick_hash()).withColumn("book", F.when(F.col("dir") == ".", F.col("rel")).otherwise(F.col("dir")))
    track = F.struct(natural(F.col("rel")).alias("key"), "rel", F.col("size").alias("bytes"), "hash")
    books = found.groupBy("root", "book", (F.col("dir") == ".").alias("loose")).agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(track)).alias("t"))
    whole = F.substring(F.sha2(F.array_join(F.transform("t", lambda x: x["hash"]), ""), 256), 1, 32)
    return books.select("root", F.col("book").alias("rel"), "size", F.when(F.col("loose"), F.col("t")[0]["hash"]).otherwise(whole).alias("hash"), F.transform("t", lambda x: x["rel"]).alias("tracks"))


def mounts(lines: DataFrame, exclude: tuple[str, ...] = (), column: str = "value") -> DataFrame:
    """(path) of the folders mounted here, out of the lines of a kernel's mountinfo: not the root, the system's own or those under `exclude`. Whether a path is a folder isn't looked up."""
    path = F.get(F.split(column, " "), 4)
    under = [(F.col("path") == e) | F.col("path").startswith(f"{e}/") for e in (x.rstrip("/") for x in exclude)]
    found = lines.select(path.alias("path")).filter("path <> '' and path <> '/'").filter(~F.col("path").rlike("^/(proc|sys|dev|run)(/|$)"))
    for inside in under:
        found = found.filter(~inside)
    return found.distinct()


def folders(files: DataFrame, mounted: DataFrame | None = None, root: str = "") -> DataFrame:
    """(dir, files, bytes, books, mounted, mounts_inside) of each folder that holds files of scan(); paths of `mounted` are compared with root/dir. The few mounts of a machine are listed by their parents, so the join is by equality."""
    counted = files.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if("supported").alias("books"))
    if mounted is None:
        return counted.withColumns({"mounted": F.lit(False), "mounts_inside": F.lit(0).cast("bigint")})
    path = F.when(F.col("dir") == ".", F.lit(root.rstrip("/"))).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("dir")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at"), (n == F.size(parts)).alias("itself")))
    marks = mounted.select(F.inline(above)).groupBy("at").agg(F.bool_or("itself").alias("mounted"), F.count_if(~F.col("itself")).alias("mounts_inside"))
    joined = counted.withColumn("at", path).join(marks, "at", "left").drop("at")
    return joined.fillna({"mounted": False, "mounts_inside": 0})


def check(files: DataFrame) -> DataFrame:
    """One row: (matches, problem) of a folder's listing; problem is null where there is a book."""
    return files.agg(F.count_if("supported").alias("matches")).withColumn("problem", F.when(F.col("matches") == 0, F.lit("readable, but no books were found")))


def image_kind(content: Column) -> Column:
    """The media type that the first bytes tell: JPEG, PNG or null."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head == "89504E470D0A1A0A", "image/png")


def entries(raw: bytes) -> dict[str, bytes]:
    """The files of an archive by name; the first of a name counts, names that leave the archive don't. ValueError beyond a limit."""
    if len(raw) > MAX_ARCHIVE:
        raise ValueError("archive too large")
    out: dict[str, bytes] = {}
    total = 0
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        listed = archive.infolist()
        if len(listed) > MAX_ENTRIES:
            raise ValueError("too many entries")
        for entry in listed:
            name = posixpath.normpath(entry.filename.replace("\\", "/"))
            if entry.is_dir() or name in out or name.startswith(("/", "..")):
                continue
            total += entry.file_size
            if entry.file_size > MAX_ENTRY or total > MAX_TOTAL or total > MAX_RATIO * max(1, len(raw)):
                raise ValueError("archive unpacks to too much")
            with archive.open(entry) as f:
                out[name] = f.read(MAX_ENTRY + 1)
            if len(out[name]) > entry.file_size:
                raise ValueError("entry larger than it says")
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(node: ElementTree.Element | None, name: str) -> list[ElementTree.Element]:
    return [] if node is None else [x for x in node.iter() if _local(x.tag) == name]


def _text(node: ElementTree.Element | None, name: str) -> str | None:
    return next((t for x in _all(node, name) if (t := " ".join("".join(x.itertext()).split()))), None)


def _xml(raw: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in raw:
        raise ValueError("entities are not read")
    return ElementTree.fromstring(raw)


def package(raw: bytes) -> dict:
    """Title, author, language, publisher, subjects, spine (hrefs of the chapters in order) and toc (label, spine place) of a book's archive."""
    files = entries(raw)
    where = next((x.get("full-path") for x in _all(_xml(files["META-INF/container.xml"]), "rootfile")), None)
    if where is None:
        raise ValueError("no package")
    root = _xml(files[posixpath.normpath(where)])
    base = posixpath.dirname(where)
    at = lambda href, of=base: posixpath.normpath(posixpath.join(of, unquote(href)))
    metadata = next(iter(_all(root, "metadata")), None)
    manifest = {x.get("id"): x for x in _all(next(iter(_all(root, "manifest")), None), "item") if x.get("id") and x.get("href")}
    spine_node = next(iter(_all(root, "spine")), None)
    spine = []
    for ref in _all(spine_node, "itemref"):
        item = manifest.get(ref.get("idref"))
        if item is not None and ref.get("linear") != "no" and "html" in item.get("media-type", ""):
            spine.append(at(item.get("href")))
    if not spine or len(spine) > MAX_SPINE:
        raise ValueError("no spine" if not spine else "spine too long")
    place = {}
    for i, href in enumerate(spine):
        place.setdefault(href, i)
    links: list[tuple[str, str]] = []
    nav = next((i for i in manifest.values() if "nav" in i.get("properties", "").split()), None)
    ncx = manifest.get(spine_node.get("toc")) if spine_node is not None else None
    if nav is not None and at(nav.get("href")) in files:
        own = at(nav.get("href"))
        for node in _all(_xml(files[own]), "nav"):
            if any(_local(k) == "type" and "toc" in v.split() for k, v in node.attrib.items()):
                links = [(" ".join("".join(a.itertext()).split()), at(a.get("href"), posixpath.dirname(own))) for a in _all(node, "a") if a.get("href")]
                break
    if not links and ncx is not None and at(ncx.get("href")) in files:
        own = at(ncx.get("href"))
        for point in _all(_xml(files[own]), "navPoint"):
            src = next((c.get("src") for c in point if _local(c.tag) == "content"), None)
            if src:
                links.append((_text(next((c for c in point if _local(c.tag) == "navLabel"), None), "text") or "", at(src, posixpath.dirname(own))))
    toc = [{"label": label, "spine": place[href.partition("#")[0]]} for label, href in links if href.partition("#")[0] in place]
    return {
        "title": _text(metadata, "title"), "author": _text(metadata, "creator"), "language": _text(metadata, "language"), "publisher": _text(metadata, "publisher"),
        "subjects": [t for x in _all(metadata, "subject") if (t := " ".join("".join(x.itertext()).split()))], "spine": spine, "toc": toc,
    }


PACKAGE = "rel string, title string, author string, language string, publisher string, subjects array<string>, spine array<string>, toc array<struct<label: string, spine: int>>, error string"


def packages(files: DataFrame) -> DataFrame:
    """One row a book of scan(): its package, or `error` and nulls where it can't be read. A book is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = "rel title author language publisher subjects spine toc error".split()
        for batch in batches:
            rows = []
            for rel, content in zip(batch["rel"], batch["content"], strict=True):
                try:
                    rows.append(dict.fromkeys(names) | {"rel": rel} | package(bytes(content)))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError) as e:
                    rows.append(dict.fromkeys(names) | {"rel": rel, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.filter("supported").select("rel", "content").mapInPandas(run, PACKAGE)
