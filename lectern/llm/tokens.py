"""Words of UTF-8 texts and hashes of any part of them, by array operations instead of loops over words.

A part's hash is polynomial over its bytes: with running sums S of byte * BASE**i modulo 2**64,
(S[end] - S[start]) * BASE**-start doesn't depend on where the part lies. mix() spreads it over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are worked through in stretches of about so many bytes, cut at white space.
STRETCH = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    if len(_powers[0]) < n:
        n = max(n, STRETCH + 4096)
        for at, b in enumerate((BASE, INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[at] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3: every bit of the input sways every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words of one stretch of bytes, A-Z lowered: start and end of each, and hashes of their parts."""

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw, np.uint8)
        self.bytes = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, self.down = powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def stretches(raw: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """The bytes in parts of at least `size`, cut at a blank or line end; a part is longer only where there is none."""
    at = 0
    while len(raw) - at > 2 * size:
        cuts = [x for x in (raw.find(b" ", at + size), raw.find(b"\n", at + size)) if x >= 0]
        if not cuts:
            break
        yield raw[at : min(cuts)]
        at = min(cuts)
    yield raw[at:]


def gathered(texts: list[str | None], size: int = STRETCH) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Texts joined by line ends to stretches of about `size` bytes: numbers of the texts, their lengths with the line end, the bytes.

    A longer text comes alone, in several stretches, after the texts before it.
    """
    at, lengths, parts, total = [], [], [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode() + b"\n"
        if len(raw) > 2 * size:
            if at:
                yield at, lengths, b"".join(parts)
                at, lengths, parts, total = [], [], [], 0
            for part in stretches(raw, size):
                yield [i], [len(part)], part
            continue
        at.append(i)
        lengths.append(len(raw))
        parts.append(raw)
        total += len(raw)
        if total >= size:
            yield at, lengths, b"".join(parts)
            at, lengths, parts, total = [], [], [], 0
    if at:
        yield at, lengths, b"".join(parts)


def word_hashes(texts: list[str | None], size: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and where each text's words begin (one more at the end)."""
    found, counts = [], np.zeros(len(texts) + 1, np.int64)
    for at, lengths, raw in gathered(texts, size):
        w = Words(raw)
        found.append(w.hashes(w.start, w.end))
        ends = np.searchsorted(w.start, np.cumsum(lengths))
        np.add.at(counts, np.array(at) + 1, np.diff(ends, prepend=0))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(counts)
