"""Byte-level BPE encoding and decoding by ranked merges over the byte arrays of distinct words.

The rank map (the fixed 50,256 entries of the vocabulary) goes to the workers as a broadcast of the file's
bytes. A worker folds the merges once for a distinct word - all new words of a batch and length together,
one merge a step, lowest rank first - and keeps the packed ids for later occurrences in a cache of bounded
size. Decoding concatenates the binary pieces of the ids. Texts are worked through in stretches cut at safe
blanks, so a very long text needs little more than its own size. README.md says why this runs in Arrow
functions and not in Spark's higher-order functions.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import stretches, unicode_pattern

CACHE = 400_000
STRETCH = 1 << 18
LEARN_CHARS = 1 << 21
LONG = 64
SHIFT = 20
NONE = np.int32(2**31 - 1)


class Merges:
    """Folds byte strings to ids. pairs: (left id << SHIFT | right id) -> rank; made: the id that a rank makes."""

    def __init__(self, byte_ids: list[int], pairs: dict[int, int], made: dict[int, int], whole: dict[bytes, int] | None = None):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.pairs, self.whole = pairs, whole or {}
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.made = np.zeros(max(made, default=0) + 1, np.int32)
        self.made[list(made)] = list(made.values())
        grid = np.full((256, 256), NONE, np.int32)
        at = {b: i for i, b in enumerate(byte_ids)}
        for k, r in pairs.items():
            if (a := at.get(k >> SHIFT)) is not None and (b := at.get(k & ((1 << SHIFT) - 1))) is not None:
                grid[a, b] = r
        self.grid = grid

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left.astype(np.int64) << SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def fold(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as packed little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.whole.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = np.array(self._fold_long(w), "<u4").tobytes()
            elif w:
                by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            self._fold_equal(n, np.array(at), np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, n), out)
        return out

    def _fold_equal(self, n: int, at: np.ndarray, raw: np.ndarray, out: list[bytes]) -> None:
        """Words of one length: each step merges in every word its leftmost pair of lowest rank; words without one are done."""
        ids = self.byte_ids[raw]
        rank = self.grid[raw[:, :-1], raw[:, 1:]]
        while True:
            if n > 1:
                rows = np.arange(len(at))
                j = rank.argmin(1)
                low = rank[rows, j]
                done = low == NONE
            else:
                done = np.ones(len(at), bool)
            if done.any():
                packed = ids[done].astype("<u4").tobytes()
                for k, i in enumerate(at[done].tolist()):
                    out[i] = packed[4 * n * k : 4 * n * (k + 1)]
                if done.all():
                    return
                going = ~done
                ids, rank, at, j, low = ids[going], rank[going], at[going], j[going], low[going]
                rows = np.arange(len(at))
            column = np.arange(n - 1)
            ids = np.take_along_axis(ids, column + (column > j[:, None]), 1)
            ids[rows, j] = self.made[low]
            n -= 1
            if n > 1:
                column = np.arange(n - 1)
                rank = np.take_along_axis(rank, column + (column > j[:, None]), 1)
                k = np.flatnonzero(j < n - 1)
                rank[k, j[k]] = self._rank(ids[k, j[k]], ids[k, j[k] + 1])
                k = np.flatnonzero(j > 0)
                rank[k, j[k] - 1] = self._rank(ids[k, j[k] - 1], ids[k, j[k]])

    def _fold_long(self, word: bytes) -> list[int]:
        """The same by a heap and links: n log n for a word of n bytes."""
        part = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(part), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := pairs.get(part[i] << SHIFT | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue  # one side has changed since; its new pairs are in the heap
            part[i], part[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pairs.get(part[i] << SHIFT | part[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, part[i], part[after[i]]))
            if (h := before[i]) >= 0 and (x := pairs.get(part[h] << SHIFT | part[i])) is not None:
                heapq.heappush(heap, (x, h, part[h], part[i]))
        return [p for p in part if p >= 0]


class Coder:
    """Encodes texts to packed ids and back under one vocabulary, given as the bytes of its file.

    kind 'ranks': lines of base64 and rank, where two pieces merge if their concatenation has a rank.
    kind 'json': a tokenizer file of a byte-level BPE, whose list of merges holds; its added tokens are found
    in the text first.
    """

    def __init__(self, raw: bytes, kind: str, pattern: str):
        self.find = regex.compile(unicode_pattern(pattern)).findall
        self.words: dict[str, bytes] = {}
        self.added: dict[str, bytes] = {}
        if kind == "ranks":
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
            pairs = {}
            for b, r in ranks.items():
                for i in range(1, len(b)):
                    if (x := ranks.get(b[:i])) is not None and (y := ranks.get(b[i:])) is not None:
                        pairs[x << SHIFT | y] = r
            self.merges = Merges([ranks[bytes([i])] for i in range(256)], pairs, {r: r for r in ranks.values()}, ranks)
            self.pieces = {r: b for b, r in ranks.items()}
        else:
            spec = json.loads(raw)
            vocab, letters = spec["model"]["vocab"], byte_letters()
            pairs, made = {}, {}
            for r, m in enumerate(spec["model"]["merges"]):
                a, b = m.split(" ") if isinstance(m, str) else m
                pairs.setdefault(vocab[a] << SHIFT | vocab[b], r)
                made[r] = vocab[a + b]
            self.merges = Merges([vocab[letters[i]] for i in range(256)], pairs, made)
            self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in spec.get("added_tokens", [])}
            value = {c: i for i, c in enumerate(letters)}
            self.pieces = {i: bytes(map(value.__getitem__, s)) for s, i in vocab.items() if all(c in value for c in s)}
            self.pieces |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def cut(self, stretch: str) -> list[str]:
        """The words of a stretch: the matches of the pattern, and the added tokens."""
        if not self.split_added:
            return self.find(stretch)
        return [w for part in self.split_added(stretch) for w in ((part,) if part in self.added else self.find(part))]

    def learn(self, new: list[str]) -> None:
        """Folds words that are not known yet."""
        plain = [w for w in new if w not in self.added]
        self.words.update(zip(plain, self.merges.fold([w.encode() for w in plain]), strict=True))
        self.words.update(self.added)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; new words of about LEARN_CHARS are learnt together."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            new = set().union(*(found for _, found in held))
            if len(self.words) + len(new) > CACHE:
                self.words = {w: self.words[w] for w in new if w in self.words}
            self.learn([w for w in new if w not in self.words])
            for i, found in held:
                out[i].append(b"".join(map(self.words.__getitem__, found)))
            held.clear()

        for i, text in enumerate(texts):
            for stretch in stretches(text, STRETCH):
                held.append((i, self.cut(stretch)))
                size += len(stretch)
                if size >= LEARN_CHARS:
                    flush()
                    size = 0
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in tokenizer files: printable Latin-1 itself, the others from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in printable}
    letters |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


_coders: dict[tuple[str, str, str], Coder] = {}


def coder_of(raw: bytes, kind: str, pattern: str) -> Coder:
    """One coder a worker process and vocabulary, so that later tasks find the words of earlier ones."""
    key = (hashlib.sha256(raw).hexdigest(), kind, pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(raw, kind, pattern)
    return _coders[key]


def _each(df: DataFrame, keep: list[str], column: str, rank_file: str, pattern: str, schema: str, make: Callable[[Coder, list], dict[str, pa.Array]]) -> DataFrame:
    """mapInArrow of make(coder, values) -> columns, beside `keep`; the file is read on the driver."""
    with open(rank_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    kind = "json" if rank_file.endswith(".json") else "ranks"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(raw.value, kind, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = make(coder, part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *rows.values()], [*keep, *rows])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(column).alias("__value")).mapInArrow(run, f"{kept}, {schema}")


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, ids (binary: little-endian unsigned 32-bit integers), n_tokens. Null texts count as empty: no ids."""

    def make(coder: Coder, texts: list) -> dict[str, pa.Array]:
        ids = coder.encode([t or "" for t in texts])
        return {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}

    return _each(df, list(keep), text, rank_file, pattern, "ids binary, n_tokens long", make)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, decoded (binary). Null ids count as none."""

    def make(coder: Coder, values: list) -> dict[str, pa.Array]:
        return {"decoded": pa.array([coder.decode(v or b"") for v in values], pa.binary())}

    return _each(df, list(keep), ids, rank_file, pattern, "decoded binary", make)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: the digests of the ids and of what they decode to, in one pass."""

    def make(coder: Coder, texts: list) -> dict[str, pa.Array]:
        ids = coder.encode([t or "" for t in texts])
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]),
        }

    return _each(df, [key], text, rank_file, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
