"""Word normalisation shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

#: Format characters and variation selectors: nothing of them is seen.
INVISIBLE = frozenset(chr(c) for c in (*range(0x2FFF), *range(0xF000, 0x10000), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(c)) == "Cf" or 0xFE00 <= c <= 0xFE0F or c == 0x34F)
_BREAK = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """Without invisible characters, in compatibility composition, case folded."""
    if not text.isascii():
        for c in INVISIBLE.intersection(text):
            text = text.replace(c, "")
        text = unicodedata.normalize("NFKC", text)
        return unicodedata.normalize("NFC", text.casefold())
    return text.lower()


def words_line(text: str | None) -> str:
    """The words (runs of letters and digits) of a text, folded and joined by single spaces."""
    return _BREAK.sub(" ", folded(text)).strip() if text else ""
