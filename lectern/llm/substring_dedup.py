"""Substring dedup: content-defined chunking with a gear rolling hash, chunks deduplicated by digest.

A word begins a new chunk if the gear hash of the eight bytes before it is below 1 / `CHUNK_WORDS` of its
range: chunks have about CHUNK_WORDS words, and an insertion moves no cut but those beside it. A chunk is a
repeat if its digest is met in another document with a smaller id; repeats next to each other make a
passage, and passages of at least `min_words` words are removed. What repeats inside one document only stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import STRETCH, mix, powers

CHUNK_WORDS = 5
MIN_WORDS = 20
WINDOW = 8
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


class Chunks:
    """Chunks of a batch of texts: number of the text, byte offsets of the first word's start and the last word's end in it, words, digest."""

    def __init__(self, texts: list[str | None]):
        found: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            if len(raw) > 2 * STRETCH:
                found += self._long(i, raw)
            else:
                held.append((i, raw))
                size += len(raw)
                if size >= STRETCH:
                    found.append(self._joined(held))
                    held, size = [], 0
        if held:
            found.append(self._joined(held))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        order = np.lexsort((columns[1], columns[0]))
        self.text, self.start, self.end, self.words, self.digest = (c[order] for c in columns)

    @staticmethod
    def _cut(raw: bytes, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """Chunks of raw, whose texts begin at `begins`, each after WINDOW line ends."""
        b = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        own = start >= begins[0]  # what lies before is the lead of the hash only
        start, end = start[own], end[own]
        if not len(start):
            return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
        h = GEAR[b]
        for d in (1, 2, 4):
            h[d:] += h[:-d] << np.uint32(d)
        cut = h[start - 1] < np.uint32((1 << 32) // CHUNK_WORDS)
        text = np.searchsorted(begins, start, "right") - 1
        cut |= np.diff(text, prepend=-1) > 0
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(start)) - 1
        up, down = powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
        s, e = start[first], end[last]
        return text[first], s - begins[text[first]], e - begins[text[first]], last - first + 1, mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))

    @classmethod
    def _joined(cls, held: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        gap = b"\n" * WINDOW
        begins = np.cumsum([WINDOW] + [len(r) + WINDOW for _, r in held[:-1]])
        text, *rest = cls._cut(gap + gap.join(r for _, r in held), begins)
        return np.array([i for i, _ in held])[text], *rest

    @classmethod
    def _long(cls, i: int, raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """A long text part by part: a part's last chunk is found again at the head of the next part."""
        at, size = 0, STRETCH
        while at < len(raw):
            lead = raw[max(0, at - WINDOW) : at].rjust(WINDOW, b"\n")
            _, s, e, n, d = cls._cut(lead + raw[at : at + size], np.array([WINDOW]))
            if at + size >= len(raw):
                yield np.full(len(s), i), s + at, e + at, n, d
                return
            if len(s) < 2:
                size *= 2
                continue
            yield np.full(len(s) - 1, i), s[:-1] + at, e[:-1] + at, n[:-1], d[:-1]
            at, size = at + int(s[-1]), STRETCH


def chunk_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, id, pos): one row a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                c = Chunks(part.column(1).to_pylist())
                pos = np.arange(len(c.text)) - np.searchsorted(c.text, c.text)
                yield pa.RecordBatch.from_arrays([pa.array(c.digest.view(np.int64)), part.column(0).take(pa.array(c.text)), pa.array(pos.astype(np.int32))], ["digest", "id", "pos"])

    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, "digest long, id long, pos int")


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, repeats): per document the chunks that other documents have too, as structs (pos, first: the smallest id that has it)."""
    chunks = chunk_rows(df, key, text)
    spread = chunks.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("top")).filter("first < top").select(F.col("digest").alias("d"), "first")
    hits = chunk_rows(df, key, text).join(spread, F.col("digest") == F.col("d"))
    return hits.groupBy("id").agg(F.collect_list(F.struct("pos", "first")).alias("repeats"))  # bounded by the document's own length


def _runs(flags: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """flags without the runs that have fewer than `least` words."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    out = np.zeros(len(flags), bool)
    total = np.concatenate([[0], np.cumsum(words)])
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if total[b] - total[a] >= least:
            out[a:b] = True
    return out


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with its text cut (null stays null), and columns n_chunks, repeat_words, removed_words, removed_chars, first_ids.

    repeat_words: words in passages that some other document has too, the one that keeps them included;
    removed_*: of passages whose chunks a document with a smaller id has; first_ids: the ids of those.
    Rows repeated with their id are one document. Texts that lose everything are empty. Rows without a key
    stay as they are.
    """
    found = Scratch(df.sparkSession, "repeats").table(repeated(df, key, text), release=True).select(F.col("id").alias("__id"), F.col("repeats").alias("__repeats"))
    names = [c for c in df.columns if c != text]
    extra = ["n_chunks", "repeat_words", "removed_words", "removed_chars", "first_ids"]
    names = [c for c in names if c not in extra]
    both = df.join(found, F.col(key) == F.col("__id"), "left").select(*names, F.col(text), "__repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, texts, repeats = (part.column(i).to_pylist() for i in (names.index(key), len(names), len(names) + 1))
                c = Chunks(texts)
                cuts = np.searchsorted(c.text, np.arange(len(texts) + 1))
                rows: dict[str, list] = {k: [] for k in ("text", *extra)}
                for i, (own, t, r) in enumerate(zip(ids, texts, repeats, strict=True)):
                    a, b = cuts[i], cuts[i + 1]
                    words, lost, firsts, n = c.words[a:b], 0, [], 0
                    raw = None
                    if r:
                        pos, first = np.array([x["pos"] for x in r]), np.array([x["first"] for x in r])
                        shared = np.zeros(b - a, bool)
                        shared[pos] = True
                        n = int(words[_runs(shared, words, min_words)].sum())
                        gone = np.zeros(b - a, bool)
                        gone[pos[first != own]] = True
                        gone = _runs(gone, words, min_words)
                        if gone.any():
                            raw = t.encode()
                            lost = int(words[gone].sum())
                            firsts = sorted(set(first[gone[pos]].tolist()))
                            start = np.append(c.start[a:b], len(raw))
                            start[0] = 0
                            raw = b"".join(raw[start[k] : start[k + 1]] for k in np.flatnonzero(~gone))
                    cut = t if raw is None else raw.decode().strip()
                    for k, v in zip(rows, (cut, int(b - a), n, lost, len(t or "") - len(cut or ""), firsts), strict=True):
                        rows[k].append(v)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *(pa.array(v, kind) for v, kind in zip(rows.values(), kinds, strict=True))], [*names, text, *extra])

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)
    return both.mapInArrow(run, f"{kept}`{text}` string, n_chunks long, repeat_words long, removed_words long, removed_chars long, first_ids array<long>")
