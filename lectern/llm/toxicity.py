"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give scores and spans.

Labels mark documents, a CRF learns from tokens. So tokens are labelled first: in toxic documents, those whose
word or word beginning is met in far more surroundings in toxic than in clean documents. The CRF then learns states
clean / toxic from the word, its beginnings and end, and its dress (capitals, exclamation marks), which also
finds words it never saw. A document's score is a logistic function of what the forward-backward marginals
add up to. The CRF is fitted on the driver from at most `max_toxic` and `max_clean` labelled documents, the
lowest by hash of the id; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import Words, gathered

MAX_TOXIC, MAX_CLEAN = 1500, 2500
#: Windows of a labelled text that the CRF learns from at most: around toxic tokens, and others.
MAX_TOXIC_WINDOWS, MAX_WINDOWS = 8, 8
SLOTS = 1 << 18
HALF = 10
BLOCK = 64
#: ASCII marks that are cut from the ends of words.
MARKS = np.zeros(256, bool)
MARKS[np.frombuffer(b".,!?;:\"'()[]{}*%$#&|-_<>~`/\\", np.uint8)] = True


def features(w: Words) -> np.ndarray:
    """For each word of the stretch the slots of its six features."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        end = end - (MARKS[w.bytes[np.maximum(end - 1, 0)]] & (end - start > 1))
        start = start + (MARKS[w.bytes[start]] & (end - start > 1))
    bangs = (w.end - end >= 2).astype(np.uint64)
    columns = [w.hashes(start, end)]
    columns += [w.hashes(start, np.minimum(start + n, end)) for n in (4, 5, 6)]
    columns.append(w.hashes(np.maximum(end - 4, start), end))
    columns.append(bangs * np.uint64(2) + (w.end - w.start > 12))
    salt = np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return (((np.stack(columns, 1) + salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)).astype(np.int32)


class Crf:
    """Two states; `weights` by feature slot for state 1 against state 0, `move` the log scores between states, `first` of the first word."""

    def __init__(self):
        self.weights = np.zeros(SLOTS, np.float32)
        self.move = np.array([[0.0, -2.0], [0.0, -1.0]])
        self.first = np.array([0.0, -2.0])
        self.scale = np.zeros(4)

    def emission(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(1, dtype=np.float64)

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability of state 1 for each word of texts of these lengths (each 1 at least), by exact forward-backward.

        Texts are cut into blocks. The matrices of a block are multiplied first, for all blocks at once; then
        the blocks of a text hand on their states, and each block is gone through from its true state.
        """
        if not len(emission):
            return np.zeros(0)
        blocks = -(-lengths // BLOCK)
        first_block = np.cumsum(blocks) - blocks
        text_of = np.repeat(np.arange(len(lengths)), lengths)
        within = np.arange(len(emission)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        row, col = first_block[text_of] + within // BLOCK, within % BLOCK
        n = int(blocks.sum())
        e = np.full((n, BLOCK), np.nan)
        e[row, col] = np.exp(np.clip(emission, -30, 30))
        t = np.exp(self.move)
        lead = np.exp(self.first)
        m = np.empty((BLOCK, n, 2, 2))  # m[k][b]: from the state before word k of block b to its own
        for k in range(BLOCK):
            x, there = e[:, k], ~np.isnan(e[:, k])
            step = np.where(there, x, 1.0)
            m[k, :, :, 0] = np.where(there[:, None], t[None, :, 0], [1.0, 0.0])
            m[k, :, :, 1] = np.where(there[:, None], t[None, :, 1] * step[:, None], [0.0, 1.0])
        head = np.zeros(n, bool)
        head[first_block] = True
        m[0][head, :, 0] = lead[0]
        m[0][head, :, 1] = lead[1] * e[head, 0][:, None]
        whole = m[0].copy()
        for k in range(1, BLOCK):
            whole = whole @ m[k]
            whole /= whole.max(axis=(1, 2), keepdims=True)
        before, after = np.full((n, 2), 0.5), np.full((n, 2), 0.5)
        for k in range(1, int(blocks.max())):
            b = first_block[blocks > k] + k
            v = np.einsum("bi,bij->bj", before[b - 1], whole[b - 1])
            before[b] = v / v.sum(1, keepdims=True)
        for k in range(int(blocks.max()) - 1, 0, -1):
            b = first_block[blocks > k] + k
            v = np.einsum("bij,bj->bi", whole[b], after[b])
            after[b - 1] = v / v.sum(1, keepdims=True)
        ahead = np.empty((BLOCK, n, 2))
        v = before
        for k in range(BLOCK):
            v = np.einsum("bi,bij->bj", v, m[k])
            v /= v.sum(1, keepdims=True)
            ahead[k] = v
        out = np.empty((n, BLOCK))
        v = after
        for k in range(BLOCK - 1, -1, -1):
            both = ahead[k] * v
            out[:, k] = both[:, 1] / both.sum(1)
            v = np.einsum("bij,bj->bi", m[k], v)
            v /= v.sum(1, keepdims=True)
        return out[row, col]

    def fit(self, windows: np.ndarray, states: np.ndarray, rounds: int = 12, rate: float = 0.25, seed: int = 10) -> None:
        """Maximum likelihood by AdaGrad. windows: (n, width, 6) slots; states: (n, width) of 0 and 1."""
        rng = np.random.default_rng(seed)
        seen_w, seen_m, seen_f = np.full(SLOTS, 1e-3), np.full((2, 2), 1e-3), np.full(2, 1e-3)
        width = windows.shape[1]
        for _ in range(rounds):
            order = rng.permutation(len(windows))
            for at in np.array_split(order, max(1, len(order) // 256)):
                x, y = windows[at], states[at]
                e = np.exp(np.clip(self.weights[x].sum(2, dtype=np.float64), -30, 30))
                t = np.exp(self.move)
                a = np.empty((width, len(at), 2))
                v = np.stack([np.full(len(at), np.exp(self.first[0])), np.exp(self.first[1]) * e[:, 0]], 1)
                a[0] = v / v.sum(1, keepdims=True)
                for k in range(1, width):
                    v = (a[k - 1] @ t) * np.stack([np.ones(len(at)), e[:, k]], 1)
                    a[k] = v / v.sum(1, keepdims=True)
                p = np.empty((len(at), width))
                moves = np.zeros((2, 2))
                b = np.full((len(at), 2), 1.0)
                for k in range(width - 1, -1, -1):
                    both = a[k] * b
                    p[:, k] = both[:, 1] / both.sum(1)
                    if k:
                        right = b * np.stack([np.ones(len(at)), e[:, k]], 1)
                        pair = a[k - 1][:, :, None] * t[None] * right[:, None, :]
                        moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                        b = right @ t.T
                        b /= b.sum(1, keepdims=True)
                g = (p - y) / len(at)
                grad = np.bincount(x.ravel(), np.repeat(g.ravel(), x.shape[2]), SLOTS)
                hit = np.flatnonzero(grad)
                grad = grad[hit] + 1e-6 * self.weights[hit]
                seen_w[hit] += grad**2
                self.weights[hit] -= (rate * grad / np.sqrt(seen_w[hit])).astype(np.float32)
                true = np.zeros((2, 2))
                np.add.at(true, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
                gm = (moves - true) / len(at)
                seen_m += gm**2
                self.move -= rate * 0.2 * gm / np.sqrt(seen_m)
                gf = np.array([(y[:, 0] - p[:, 0]).mean(), (p[:, 0] - y[:, 0]).mean()])
                seen_f += gf**2
                self.first -= rate * 0.2 * gf / np.sqrt(seen_f)

    def tag(self, texts: list[str | None], spans: bool = False) -> tuple[np.ndarray, list]:
        """Per text: words, sum and maximum of the marginals; and, if asked for, (start, end) in code points of runs of tokens of 0.5 or more."""
        held: list[list[np.ndarray]] = [[] for _ in texts]
        places: list[list[np.ndarray]] = [[] for _ in texts]
        passed = [0] * len(texts)
        for at, lengths, raw in gathered(texts):
            w = Words(raw)
            e = self.emission(features(w))
            cuts = np.searchsorted(w.start, np.cumsum(lengths))[:-1]
            for i, part in zip(at, np.split(e, cuts), strict=True):
                held[i].append(part)
            if spans:
                points = np.concatenate([[0], np.cumsum((w.bytes & 0xC0) != 0x80)])
                begins = np.concatenate([[0], np.cumsum(lengths)])
                for i, a, s, t in zip(at, begins, np.split(points[w.start], cuts), np.split(points[w.end], cuts), strict=False):
                    places[i].append(np.stack([s, t], 1) - points[a] + passed[i])
                    if len(at) == 1:
                        passed[i] += int(points[-1])
        each = [np.concatenate(x) if x else np.zeros(0) for x in held]
        sizes = np.array([len(x) for x in each])
        full = sizes > 0
        p = self.marginals(np.concatenate(each) if each else np.zeros(0), sizes[full])
        out = np.zeros((len(texts), 3))
        out[:, 0] = sizes
        found: list = [[] for _ in texts]
        if full.any():
            begin = np.cumsum(sizes[full]) - sizes[full]
            out[full, 1], out[full, 2] = np.add.reduceat(p, begin), np.maximum.reduceat(p, begin)
        if spans:
            for i, b in zip(np.flatnonzero(full), np.cumsum(sizes[full]) - sizes[full], strict=True):
                where = np.concatenate(places[i])
                toxic = np.flatnonzero(p[b : b + sizes[i]] >= 0.5)
                if len(toxic):  # neighbours make one span
                    heads = np.concatenate([[True], np.diff(toxic) > 1])
                    found[i] = np.stack([where[toxic[heads], 0], where[toxic[np.append(np.flatnonzero(heads)[1:] - 1, len(toxic) - 1)], 1]], 1).tolist()
        return out, found

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_doc_features(sums) @ self.scale, -30, 30)))


def _doc_features(sums: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(sums)), np.log1p(10 * sums[:, 1]), sums[:, 2], sums[:, 1] / np.sqrt(sums[:, 0] + 10)], 1)


def _contexts(slots: list[np.ndarray]) -> np.ndarray:
    """For each slot, in how many different surroundings (word before, word after) it is met: copies of a passage count once."""
    seen = []
    for s in slots:
        around = np.zeros(len(s) + 2, np.int64)
        around[1:-1] = s[:, 0] + 1
        pair = ((around[:-2] << 19) | around[2:])[:, None]
        seen.append(np.unique((s[:, :4].astype(np.int64) << 40) ^ pair))
    return np.bincount(np.unique(np.concatenate(seen)) >> 40, minlength=SLOTS) if seen else np.zeros(SLOTS)


def label_tokens(slots: list[np.ndarray], toxic: np.ndarray, least: int = 3, share: float = 0.01, odds: float = 20.0) -> list[np.ndarray]:
    """States of the words of each text: 1 in toxic texts where the word, or a beginning of it, tells toxic from clean texts."""
    p, c = (_contexts([s for s, y in zip(slots, toxic, strict=True) if y == state]) for state in (1, 0))
    telling = (p >= max(least, share * toxic.sum())) & ((p + 0.5) / (toxic.sum() + 1) >= odds * (c + 0.5) / ((1 - toxic).sum() + 1))
    return [telling[s[:, :4]].any(1).astype(np.int8) if y else np.zeros(len(s), np.int8) for s, y in zip(slots, toxic, strict=True)]


def train(texts: list[str | None], toxic: np.ndarray, seed: int = 10, per_toxic: int = MAX_TOXIC_WINDOWS, per_text: int = MAX_WINDOWS) -> Crf:
    """The CRF from two thirds of the texts, the scale of scores from the others. Without toxic texts all scores are low.

    Of each text at most `per_toxic` windows around toxic tokens and `per_text` others (drawn at random) are learnt
    from; a text of fewer words than a window is repeated until it fills one. Texts without a word teach nothing.
    """
    model = Crf()
    toxic = np.asarray(toxic, np.int8)
    slots = []
    for t in texts:
        parts = [features(Words(raw)) for _, _, raw in gathered([t])]
        slots.append(np.concatenate(parts))
    fitted = np.arange(len(texts)) % 3 > 0
    chosen = [s for s, f in zip(slots, fitted, strict=True) if f]
    rng = np.random.default_rng(seed)
    windows, states = [], []
    width = 2 * HALF + 1
    for s, y in zip(chosen, label_tokens(chosen, toxic[fitted]), strict=True):
        if not len(s):
            continue
        if len(s) < width:
            s, y = np.resize(s, (width, s.shape[1])), np.resize(y, width)
        hits = np.flatnonzero(y)
        hits = rng.permutation(hits)[:per_toxic] if len(hits) > per_toxic else hits
        centres = np.concatenate([hits, rng.integers(0, len(s), per_text)])
        begin = np.clip(centres - HALF, 0, len(s) - width)
        at = begin[:, None] + np.arange(width)
        windows.append(s[at])
        states.append(y[at])
    model.scale = np.array([-4.0, 0.0, 0.0, 0.0])
    if not windows or not toxic.any():
        return model
    model.fit(np.concatenate(windows), np.concatenate(states).astype(np.int64), seed=seed)
    rest = [t for t, f in zip(texts, fitted, strict=True) if not f]
    sums, y = model.tag(rest)[0], toxic[~fitted].astype(float)
    x = _doc_features(sums)
    for _ in range(60):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ model.scale, -30, 30)))
        grad = x.T @ (p - y) + 0.05 * model.scale
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4), grad)
        model.scale = model.scale - np.clip(step, -2, 2)
    return model


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Crf:
    """Fits on the labelled documents that are not held out: the first by hash of the id, at most so many of each label.

    A null label is no label; of several labels of one document the largest counts.
    """
    known = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).filter("__k is not null and __y is not null").groupBy("__k").agg(F.max("__y").alias("__y"))
    known = known.filter(~held_out("__k")).withColumn("__h", F.md5(F.col("__k").cast("string")))
    some = [known.filter(F.col("__y") == y).orderBy("__h", "__k").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    some = F.broadcast(some[0].unionAll(some[1]))  # max_toxic + max_clean rows at most
    rows = docs.select(F.col(key).alias("__d"), F.col(text).alias("__t")).join(some, F.col("__d") == F.col("__k")).select("__h", "__y", "__t").collect()
    rows.sort(key=lambda r: (r["__h"], r["__t"] or ""))
    return train([r["__t"] for r in rows], np.array([r["__y"] for r in rows], np.int8))


def score(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """One row a document: key, score, n_words, expected (sum of marginals), spans (start, end in code points of runs of toxic tokens).

    Null texts count as empty: no words, no spans, and the score of a text without evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.move, model.first, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf()
        crf.weights, crf.move, crf.first, crf.scale = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sums, found = crf.tag(part.column(1).to_pylist(), spans)
                columns = [part.column(0), pa.array(crf.score(sums)), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1])]
                places = pa.array([[{"start": a, "end": b} for a, b in x] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*columns, places], [key, "score", "n_words", "expected", "spans"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, n_words long, expected double, spans array<struct<start: long, end: long>>"
    return docs.select(key, F.col(text).alias("__value")).mapInArrow(run, schema)
