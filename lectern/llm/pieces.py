"""Cutting long texts where byte-level BPE never merges, so that the parts can be encoded alone.

The pattern of these vocabularies starts a new match at a single blank between two characters that are not
white space: no match holds a blank anywhere but at its start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: The White_Space property of Unicode, as \s stands for it in the libraries' pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


def unicode_pattern(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out: Python's \\s also holds U+001C to U+001F."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def stretches(text: str, size: int) -> Iterator[str]:
    """The text in parts of about `size` characters, cut at safe blanks; a part is longer only where there is none."""
    at = 0
    while len(text) - at > size:
        cut = SAFE_BLANK.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text
