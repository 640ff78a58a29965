"""N-gram Jaccard join: rarest shingles first, parity sketches, whole sets.

A document is the set of its word shingles. Two sets of a and b elements with Jaccard similarity t or more
differ in at most d = (1 - t) / (1 + t) * (a + b) elements. Parity sketches toggle one bit for each element,
so two sketches differ in no more bits than the sets in elements.

Candidates share a block, a shingle that stands early in both sets under one order for all: the first that
two such sets share stands among the first (1 - t) * a + 1 of one and (1 - t) * b + 1 of the other, and with
places i and j (from 0) the sets differ in at least max(a - b + 2 * j, b - a + 2 * i) elements. The order is by
the exact number of documents that have the shingle, so what sets two edits of one text apart comes before
what they share, and texts around one passage don't meet. Shingles of one document alone need no block: only
their number counts. (Pigeonhole over blocks of the sketch itself made every pair of edits of one text a
candidate; README.md has the figures.)

Counting: shingle hashes go in packed blobs to buckets of about BUCKET elements, where equal ones meet; those
of two documents or more go to their documents' parts, which number them. Very common shingles (slots of a
fixed table that are met far more often than others in one task) are not counted but come last in the order:
only documents with too few others have blocks of them. So no bucket holds a row for each document.

Groups of equal blocks are not paired up. Each member is paired with one hub (first place, then smallest id);
pairs whose sizes, places or narrow sketches (1,024 bits) rule a link out go, the others are verified on whole
sets. Links join most groups into one component. In the others, members outside the hub's component are paired
with the members of other components that place and size still allow. Documents with equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .tokens import mix, word_hashes

BATCH = 2000
SLOT_BITS = 22
COMMON = 1 << 18
NARROW = 1024
#: Elements of a blob's slice and of a bucket: 8 MB of hashes, 16 MB.
SLICE, BUCKET = 1 << 20, 1 << 21
MOST_BROADCAST = 500_000


class Sets:
    """The distinct shingle hashes of a batch of texts: one sorted run a text."""

    def __init__(self, texts: list[str | None], width: int):
        h, bounds = word_hashes(texts)
        n_words = np.diff(bounds)
        odd = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0xD6E8FEB86659FD93 & (1 << 64) - 1 | 1) for k in range(width)]
        m = max(0, len(h) - width + 1)
        rolled = np.zeros(m, np.uint64)
        for k in range(width):
            rolled += h[k : k + m] * odd[k]
        rolled = mix(rolled)
        runs = []
        for i, n in enumerate(n_words.tolist()):
            at = int(bounds[i])
            if n >= width:
                x = np.sort(rolled[at : at + n - width + 1])
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif n:
                x = mix(np.array([sum(int(h[at + k]) * int(odd[k]) for k in range(n)) + n & (1 << 64) - 1], np.uint64))
            else:
                x = np.zeros(0, np.uint64)
            runs.append(x)
        self.runs = runs
        self.sizes = np.array([len(x) for x in runs], np.int64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _digest(r: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return int(r.sum()), int(np.bitwise_xor.reduce(mix(r + np.uint64(1)))) if len(r) else 0


def narrow_sketch(runs: list[np.ndarray]) -> list[bytes]:
    """The parity of each set's elements in each of NARROW bits."""
    out = []
    for r in runs:
        out.append(np.packbits((np.bincount((r >> np.uint64(20)).astype(np.int64) & (NARROW - 1), minlength=NARROW) & 1).astype(np.uint8)).tobytes())
    return out


def set_digests(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, n_shingles, d1, d2, sketch, slot) for every row: the size of its set, a 128-bit digest that equal sets share, the narrow sketch.

    Rows with a slot are no documents: a task reports the slots of shingles that are met in 8 of its documents at
    least and 4 times the mean more, with their count as n_shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int32)
        names = [key, "n_shingles", "d1", "d2", "sketch", "slot"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                sets = Sets(part.column(1).to_pylist(), width)
                for r in sets.runs:
                    counts[_slot(r)] += 1
                d = np.array([_digest(r) for r in sets.runs], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets.sizes), *(pa.array(d[:, k].copy().view(np.int64)) for k in (0, 1)), pa.array(narrow_sketch(sets.runs), pa.binary()), pa.nulls(part.num_rows, pa.int32())], names
                )
        many = np.flatnonzero(counts >= 8 + 4 * counts.mean())
        if kind is not None and len(many):
            none = pa.nulls(len(many), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(many), kind), pa.array(counts[many].astype(np.int64)), none, none, pa.nulls(len(many), pa.binary()), pa.array(many.astype(np.int32))], names)

    return df.select(key, F.col(text).alias("t")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_shingles long, d1 long, d2 long, sketch binary, slot int")


def common_levels(found: DataFrame) -> np.ndarray:
    """By slot 0, or the bit length of how often its shingles were reported, for COMMON slots at most (a table of fixed size)."""
    rows = found.filter("slot is not null").groupBy("slot").agg(F.sum("n_shingles").alias("n")).orderBy(F.desc("n"), "slot").limit(COMMON).toArrow()
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    levels[np.asarray(rows.column("slot"))] = np.minimum(60, np.log2(np.maximum(1, np.asarray(rows.column("n")))).astype(np.uint8) + 1)
    return levels


BLOB = "bucket int, kind int, ids binary, a binary, b binary, c binary"
#: Kinds of blobs: shingles by bucket; sizes of documents; blocks of very common shingles; counted shingles by document.
SHINGLES, SIZES, COMMONS, COUNTED = range(4)


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "kind", "ids", "a", "b", "c"])


def _by(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places of its members in order)."""
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(groups[at[0]]), at


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _part(ids: np.ndarray, bits: int) -> np.ndarray:
    return _bucket(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(3)), bits)


def _pack(h: np.ndarray, bits: int) -> bytes:
    """48 bits of each hash after those that name its bucket."""
    return ((h << np.uint64(bits)) >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes, bucket: int, bits: int) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    low = (wide.reshape(-1).view("<u8") << np.uint64(16)) >> np.uint64(bits)
    return low | np.uint64((bucket << (64 - bits)) & ((1 << 64) - 1))


def _prefix(n: np.ndarray | int, num: int, den: int):
    """How many of the first elements of a set of n hold one that is shared with any set as alike as num / den."""
    return n * (den - num) // den + 1


def _dealt(df: DataFrame, width: int, num: int, den: int, levels, bits: int) -> DataFrame:
    """Blobs of the documents (id, t): shingles by bucket, and by part the sizes and blocks of very common shingles. Copies within a task are left out."""

    def flush(ids: list[int], sizes: list[int], cold: list[np.ndarray], commons: list[tuple[int, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        own, n, c0 = np.array(ids, np.int64), np.array(sizes, np.uint32), np.array([len(x) for x in cold], np.uint32)
        rows = [(-1 - part, SIZES, own[at].tobytes(), n[at].tobytes(), c0[at].tobytes(), b"") for part, at in _by(_part(own, bits))]
        if commons:
            whose, h = np.repeat(np.array([i for i, _, _ in commons], np.int64), [len(x) for _, x, _ in commons]), np.concatenate([x for _, x, _ in commons])
            place = np.concatenate([np.arange(first, first + len(x)) for _, x, first in commons]).astype(np.uint32)
            rows += [(-1 - part, COMMONS, whose[at].tobytes(), h[at].tobytes(), place[at].tobytes(), b"") for part, at in _by(_part(whose, bits))]
        yield _blobs(rows)
        h, doc = np.concatenate(cold), np.repeat(np.arange(len(cold)), c0)
        rows = []
        for bucket, at in _by(_bucket(h, bits)):
            d = doc[at]
            first = np.concatenate([[True], d[1:] != d[:-1]])
            rows.append((bucket, SHINGLES, own[d[first]].tobytes(), (np.cumsum(first) - 1).astype(np.uint16).tobytes(), _pack(h[at], bits), b""))
            if len(rows) == 64:
                yield _blobs(rows)
                rows = []
        if rows:
            yield _blobs(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        ids, sizes, cold, commons, held = [], [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                for i, r in zip(part.column(0).to_pylist(), Sets(part.column(1).to_pylist(), width).runs, strict=True):
                    if not len(r) or (d := _digest(r)) in seen:
                        continue
                    seen.add(d)
                    lv = level[_slot(r)]
                    rare = r[lv == 0]
                    if (want := _prefix(len(r), num, den) - len(rare)) > 0:
                        most, lv = r[lv > 0], lv[lv > 0]
                        commons.append((i, most[np.lexsort((mix(most + np.uint64(7)), lv))[:want]], len(rare)))
                    ids.append(i)
                    sizes.append(len(r))
                    cold.append(rare)
                    held += len(rare)
                    if held >= SLICE or len(ids) == 1 << 16:
                        yield from flush(ids, sizes, cold, commons)
                        ids, sizes, cold, commons, held = [], [], [], [], 0
        if ids:
            yield from flush(ids, sizes, cold, commons)

    return df.select("id", "t").mapInArrow(run, BLOB)


def _counted(blobs: DataFrame, bits: int) -> DataFrame:
    """By part of the documents: the shingles that two documents or more have, with their number; the other blobs as they are."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:
            return table.set_column(0, "bucket", pa.array(np.full(table.num_rows, -1 - bucket, np.int32)))
        ids, doc, h, docs = [], [], [], 0
        for own, at, raw in zip(*(table.column(c).to_pylist() for c in ("ids", "a", "b")), strict=True):
            ids.append(np.frombuffer(own, np.int64))
            doc.append(np.frombuffer(at, np.uint16).astype(np.int32) + docs)
            h.append(_unpack(raw, bucket, bits))
            docs += len(ids[-1])
        ids, doc, h = np.concatenate(ids), np.concatenate(doc), np.concatenate(h)

        def shared() -> np.ndarray:
            """Places, in order of h, of hashes that are there twice."""
            twin = h[1:] == h[:-1]
            return np.concatenate([[False], twin]) | np.concatenate([twin, [False]]) if len(h) else np.zeros(0, bool)

        order = np.argsort(h)
        h, own = h[order], ids[doc[order]]
        two = shared()
        h, own = h[two], own[two]
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (own[1:] == own[:-1])]) if len(h) else np.zeros(0, bool)  # a row repeated with its key
        h, own = h[~again], own[~again]
        two = shared()
        h, own = h[two], own[two]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        run_of = np.cumsum(first) - 1
        n = np.minimum(np.bincount(run_of, minlength=1)[run_of] if len(h) else np.zeros(0, np.int64), 65535).astype(np.uint16)
        rows = []
        for part, at in _by(_part(own, bits)):
            at = at[np.argsort(own[at], kind="stable")]
            o = own[at]
            begin = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            rows.append((part, COUNTED, o[begin].tobytes(), h[at].tobytes(), n[at].tobytes(), np.diff(np.append(begin, len(o))).astype(np.uint32).tobytes()))
        return pa.Table.from_batches([_blobs(rows)])

    return blobs.groupBy("bucket").applyInArrow(run, BLOB)


def _places(counted: DataFrame, num: int, den: int) -> DataFrame:
    """(key, id, place, n): the blocks of each document that some other document may have too, with their places in its order."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        read = {k: [[] for _ in range(4)] for k in (SIZES, COMMONS, COUNTED)}
        for kind, *raw in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "a", "b", "c")), strict=True):
            for held, x in zip(read[kind], raw, strict=True):
                held.append(x)

        def column(kind: int, i: int, of: str) -> np.ndarray:
            return np.frombuffer(b"".join(read[kind][i]), of)

        ids, first = np.unique(column(SIZES, 0, "i8"), return_index=True)
        n, c0 = column(SIZES, 1, "u4")[first].astype(np.int64), column(SIZES, 2, "u4")[first].astype(np.int64)
        own = np.searchsorted(ids, np.repeat(column(COUNTED, 0, "i8"), column(COUNTED, 3, "u4")))
        h, many = column(COUNTED, 1, "u8"), column(COUNTED, 2, "u2")
        order = np.lexsort((mix(h + np.uint64(7)), many, own))
        own, h = own[order], h[order]
        per = np.bincount(own, minlength=len(ids))
        place = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per) + (c0 - per)[own]
        keep = place < _prefix(n[own], num, den)
        most = np.searchsorted(ids, column(COMMONS, 0, "i8"))
        own, h, place = np.concatenate([own[keep], most]), np.concatenate([h[keep], column(COMMONS, 1, "u8")]), np.concatenate([place[keep], column(COMMONS, 2, "u4")])
        return pa.table({"key": h.view(np.int64), "id": ids[own], "place": place.astype(np.int32), "n": n[own].astype(np.int32)})

    return counted.groupBy("bucket").applyInArrow(run, "key long, id long, place int, n int")


def _may_link(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose narrow sketches differ in no more bits than their sets may in elements."""
    left, right = (sketches.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, NARROW // 64) for c in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            a, b = (np.asarray(batch.column(c)) for c in (2, 3))
            keep = pa.array((differ * (den + num) <= (den - num) * (a + b)) & (num * np.maximum(a, b) <= den * np.minimum(a, b)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """pairs (a, b) with `linked`: whether den * intersection >= num * union of their shingle sets."""
    left, right = texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                a, b, ta, tb = (c.to_pylist() for c in part.columns)
                known = dict(zip(a, ta, strict=True)) | dict(zip(b, tb, strict=True))
                runs = dict(zip(known, Sets(list(known.values()), width).runs, strict=True))
                linked = []
                for i, j in zip(a, b, strict=True):
                    x, y = runs[i], runs[j]
                    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    linked.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def _merge(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, comp) after more links (a, b) between nodes."""
    a, b = (labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab")
    top = components(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch)
    top = top.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    return scratch.table(labels.join(top, F.col("comp") == F.col("n"), "left").select("node", F.coalesce("c", "comp").alias("comp")))


def linked_components(df: DataFrame, stats: DataFrame, levels: np.ndarray, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(node, comp) for the documents (id, t) that have a link: comp is the smallest id reachable. stats: set_digests() of them."""
    twins = stats.filter("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("id").alias("rep"), F.max("id").alias("top")).filter("rep < top").select("n_shingles", "d1", "d2", "rep")
    alias = scratch.table(stats.join(twins, ["n_shingles", "d1", "d2"]).filter("id <> rep").select("id", "rep").distinct())
    labels = _linked(df, stats.select("id", "n_shingles", "sketch").dropDuplicates(["id"]), alias, levels, width, num, den, scratch)
    classes = alias.select(F.col("rep").alias("__r")).distinct().join(labels, F.col("__r") == F.col("node"), "left_anti").select(F.col("__r").alias("node"), F.col("__r").alias("comp"))
    own = scratch.table(labels.unionByName(classes))
    copies = alias.join(own, F.col("rep") == F.col("node")).select(F.col("id").alias("node"), "comp")
    out = scratch.table(own.unionByName(copies))
    scratch.drop(alias, labels, own)
    return out


def _check(pairs: DataFrame, df: DataFrame, sketches: DataFrame, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link: sketches first, then whole sets."""
    close = scratch.table(_may_link(pairs, sketches, num, den))
    ids = scratch.table(close.select("a").union(close.select("b")).distinct())
    few = ids.count() <= MOST_BROADCAST  # 8 bytes an id; with more, the join shuffles
    texts = scratch.table(df.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("a"), "left_semi").groupBy("id").agg(F.min("t").alias("t")))
    links = scratch.table(_verify(close, texts, width, num, den).filter("linked").select("a", "b"))
    scratch.drop(close, ids, texts)
    return links


def _linked(df: DataFrame, sketches: DataFrame, alias: DataFrame, levels: np.ndarray, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """linked_components() of the documents that stand for their class of equal sets."""
    total = sketches.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(0, min(30, int(total // BUCKET).bit_length()))
    shared = df.sparkSession.sparkContext.broadcast(levels)
    keyed = scratch.table(_places(_counted(_dealt(df, width, num, den, shared, bits), bits), num, den), release=True)
    blocks = keyed.join(alias.withColumnRenamed("id", "__i"), F.col("id") == F.col("__i"), "left").select("key", F.coalesce("rep", "id").alias("id"), "place", "n").dropDuplicates(["key", "id"])
    hubs = blocks.groupBy("key").agg(F.min(F.struct("place", "id")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    hubs = hubs.select(F.col("key").alias("k"), F.col("hub.place").alias("hub_place"), F.col("hub.id").alias("hub"), "size")
    # the hub's place is the lowest: who can't reach it can reach nobody of its group
    reach = f"(place + hub_place) * {den + num} <= {den - num} * (n + n * {den} div {num})"
    blocks, before = scratch.table(blocks.join(hubs, F.col("key") == F.col("k")).filter(f"id = hub or {reach}").drop("k")), keyed
    scratch.drop(before)
    pairs = blocks.filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = _check(pairs, df, sketches, width, num, den, scratch)
    labels = components(links, scratch)
    # where a group of three or more is not one component, the rest of it
    now = blocks.filter("size > 2").join(labels, F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "id")).select("key", "id", "place", "n", "hub", "comp")
    split = now.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("id") == F.col("hub"), F.col("comp"))).alias("main")).filter("lo < hi")
    now = scratch.table(now.join(split.select("k", "main"), F.col("key") == F.col("k")).drop("k"))
    apart = now.filter("comp <> main").select(F.col("key").alias("k"), F.col("id").alias("other"), F.col("place").alias("op"), F.col("n").alias("on"), F.col("comp").alias("oc"))
    d = f"{den - num} * (n + on)"
    near = f"comp <> oc and id <> hub and {num} * greatest(n, on) <= {den} * least(n, on) and (n - on + 2 * op) * {den + num} <= {d} and (on - n + 2 * place) * {den + num} <= {d}"
    rest = now.join(apart, (F.col("key") == F.col("k")) & F.expr(near)).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    more = _check(rest, df, sketches, width, num, den, scratch)
    out = components(links.union(more), scratch)
    scratch.drop(blocks, now, links, more, labels)
    return out


def _components(df: DataFrame, key: str, text: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(df.sparkSession, "jaccard")
    found = scratch.table(set_digests(df, key, text, width))
    stats = found.filter("slot is null").drop("slot")
    docs = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    known = stats.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "n_shingles", "d1", "d2", "sketch")
    return stats, linked_components(docs, known, common_levels(found), width, num, den, scratch)


def join(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row a document: key, n_shingles, component_id (the smallest key of its component, its own if it has no link).

    Two documents link if den * intersection >= num * union. Null, empty and blank texts have an empty set and
    no links; a text of fewer than `width` words is one shingle. Rows repeated with their key are one document.
    """
    stats, comps = _components(df, key, text, width, num, den)
    return stats.join(comps, F.col(key) == F.col("node"), "left").select(key, "n_shingles", F.coalesce("comp", key).alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """df with one document of each component: the one of the smallest key; of rows repeated with their key one stays, rows without a key all do."""
    stats, comps = _components(df, key, text, width, num, den)
    scratch = Scratch(df.sparkSession, "copies")
    gone = scratch.table(comps.filter("node <> comp").select("node"))
    kept = df.join(gone, F.col(key) == F.col("node"), "left_anti")
    again = scratch.table(stats.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node"))
    if not again.limit(1).count():
        return kept
    same = F.col(key) == F.col("node")
    return kept.join(again, same, "left_anti").unionAll(kept.join(again, same, "left_semi").dropDuplicates([key]))
