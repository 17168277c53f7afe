"""Word runs shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower-cased, accents removed."""
    low = text.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """Longest runs of letters and digits after lower-casing and removing accents."""
    return _WORD.findall(plain(text))
