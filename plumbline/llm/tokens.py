"""Cutting a text into units that every byte-level pre-tokenizer pattern treats separately.

A unit is a run of non-space with the one blank before it, or a run of white space. No match of the pattern crosses
a unit's end, so that whatever is worked out for a unit holds wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex

#: Code points with the Unicode property White_Space.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

UNIT = re.compile(f"\\x20?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_BREAK = re.compile(f"(?<=[^{WHITE}])\\x20(?=[^{WHITE}])")


def segments(text: str, chars: int = 2_000_000) -> Iterator[str]:
    """The text in pieces of about so many characters, cut where units meet, so that memory stays bounded."""
    start = 0
    while len(text) - start > chars:
        cut = _BREAK.search(text, start + chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def units(text: str) -> list[str]:
    return UNIT.findall(text)


#: Code points that are letters or numbers since Unicode 17 or 18. The tokenizer libraries know Unicode 16,
#: in which they are neither; the regex module may know them.
LATER = (
    "\\u0558\\u058b\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb"
    "\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8"
    "\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20"
    "\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6"
    "\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de"
    "\\U0001e6e0-\\U0001e6e2\\U0001e6e4\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe\\U0001e6ff"
    "\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
_LATER = re.compile(f"[{LATER}]")
#: A code point that is never assigned, so neither letter nor number nor white space in any version.
_NEITHER = "\U0003fffe"


def pieces(pattern: regex.Pattern, unit: str) -> list[str]:
    """The pattern's matches in a unit, with the character classes of Unicode 16."""
    if unit.isascii() or _LATER.search(unit) is None:
        return pattern.findall(unit)
    return [unit[m.start() : m.end()] for m in pattern.finditer(_LATER.sub(_NEITHER, unit))]
