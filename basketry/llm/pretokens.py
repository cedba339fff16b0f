"""Pieces into which the two byte-pair vocabularies cut a text before merging."""

from __future__ import annotations

import re
import unicodedata

# The White_Space characters of Unicode below U+0100; letters and numbers by general category.
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
LATIN = [chr(i) for i in range(256)]
LETTER = "".join(c for c in LATIN if unicodedata.category(c)[0] == "L")
NUMBER = "".join(c for c in LATIN if unicodedata.category(c)[0] == "N")
S, L, N = re.escape(SPACE), re.escape(LETTER), re.escape(NUMBER)
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"

# The patterns of the vocabulary files, spelled out for Latin-1 text.
# Letters stand first, as most pieces are words; no contraction begins with a letter, a number or a blank.
SPACED_PIECES = re.compile(f" ?[{L}]+|{SHORT}| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
WORD_PIECES = re.compile(f"{SHORT}|[{L}]+|[{N}]|[^{S}{L}{N}]+")


def is_latin(text: str) -> bool:
    """True where the patterns above give the same pieces as the library's own Unicode classes."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(i if i in plain else next(spare)) for i in range(256)]
