"""Small pure functions: fractional ranks, slugs, natural sort keys."""

from __future__ import annotations

import re
import unicodedata

#: Fixed value: digits of ranks in ASCII order, so that ranks compare byte by byte.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _scaled(rank: str, places: int) -> tuple[int, bool]:
    """The rank as a fraction, in units of the last of so many digits, rounded down; and whether that is exact."""
    units = 0
    for digit in rank[:places].ljust(places, DIGITS[0]):
        units = units * len(DIGITS) + DIGITS.index(digit)
    return units, not rank[places:].strip(DIGITS[0])


def rank_between(low: str | None, high: str | None) -> str:
    """The middle of the shortest ranks that sort strictly between two ranks; None is an open end.

    Ranks are fractions of 1 in base 62. With the fewest digits that leave a fraction between the two, none of
    those ends in the lowest digit, as it would be there with a digit less.
    """
    if low is not None and high is not None and low >= high:
        raise ValueError("the lower rank must sort first")
    places = 0
    while True:
        places += 1
        first = 1 + (_scaled(low, places)[0] if low is not None else 0)
        end = len(DIGITS) ** places
        if high is not None:
            units, exact = _scaled(high, places)
            end = units if exact else units + 1
        if first < end:
            middle, digits = (first + end - 1) // 2, []
            for _ in range(places):
                middle, digit = divmod(middle, len(DIGITS))
                digits.append(DIGITS[digit])
            return "".join(reversed(digits))


def move(ranks: list[str], at: int, to: int) -> str:
    """The new rank of item `at` of a list in order of rank, so that it stands at place `to`; no other item changes."""
    rest = ranks[:at] + ranks[at + 1 :]
    return rank_between(rest[to - 1] if to else None, rest[to] if to < len(rest) else None)


def slug(text: str | None, fallback: str = "Untitled", longest: int = 60) -> str:
    """ASCII letters and digits, joined by single spaces, for names of files."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.category(c).startswith("M"))
    return re.sub(r"[^A-Za-z0-9]+", " ", plain).strip()[:longest].strip() or fallback


def natural_key(text: str) -> tuple:
    """Sorts '2' before '10', without case."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|\D+", text.lower()))
