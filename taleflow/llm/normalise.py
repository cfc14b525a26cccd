"""Normalisation shared by the text matchers: letters, entities, invisible characters, words."""

from __future__ import annotations

import html
import re
import unicodedata

#: Two-byte UTF-8 sequences that were read as Latin-1 or Windows-1252.
_MOJIBAKE = re.compile("[Â-ß][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]")
_WORD = re.compile(r"[^\W_]+")
#: Soft hyphen, zero-width characters, joiners, byte order mark.
_INVISIBLE = (0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF)
_DROP = re.compile(f"[{''.join(map(chr, _INVISIBLE))}]+")


def _repair(m: re.Match) -> str:
    for encoding in ("latin-1", "cp1252"):
        try:
            return m[0].encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]


def repair(text: str) -> str:
    """Entities resolved, broken encodings mended, letters composed, invisible characters removed."""
    if "&" in text:
        text = html.unescape(text)
    if "Ã" in text or "Â" in text:
        text = _MOJIBAKE.sub(_repair, text)
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return _DROP.sub("", text)


def spelt(text: str) -> str:
    """Lower-case text with æ, ø, å written as ae, oe, aa."""
    return text.replace("æ", "ae").replace("ø", "oe").replace("å", "aa")


def words(text: str | None) -> list[str]:
    """Words in lower case with æ, ø, å written as ae, oe, aa; null and blank texts have none."""
    return _WORD.findall(spelt(repair(text).lower())) if text else []
