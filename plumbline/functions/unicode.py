"""Character classes for Java regular expressions, derived from the Unicode names of letters."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

#: Scripts by the first word of a letter's Unicode name, and the language each decides.
SCRIPT_LANGS = {
    "HIRAGANA": "ja", "KATAKANA": "ja", "HANGUL": "ko", "HAN": "zh", "CYRILLIC": "ru", "ARABIC": "ar",
    "DEVANAGARI": "hi", "THAI": "th", "HEBREW": "he", "GREEK": "el", "BENGALI": "bn",
}
SCRIPTS = (*SCRIPT_LANGS, "LATIN")


def chars(*spans: tuple[int, int]) -> str:
    """The inside of a Java character class, of code point ranges."""
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


#: White space as Python's ``\s`` has it; Java's lacks some of these.
SPACE_CHARS = chars((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SPACE = f"[{SPACE_CHARS}]"
#: White space as browsers have it.
BROWSER_SPACE = "[" + chars((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)) + "]"
#: Texts of these characters only are unchanged by NFKC.
NFKC_STABLE = r"\A[" + chars((0x00, 0x7F), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x400, 0x481), (0x48A, 0x52F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFC), (0xAC00, 0xD7A3)) + r"]*\z"
#: Invisible characters that are removed.
ZERO_WIDTH = chars((0x200B, 0x200F), (0x2028, 0x202E), (0x2060, 0x2064), (0xFEFF, 0xFEFF))
SOFT_HYPHEN = chars((0xAD, 0xAD))
#: The letters of ASCII are all Latin.
ASCII, ASCII_LETTER = chars((0x00, 0x7F)), "[A-Za-z]"
LETTER, LETTER_OR_DIGIT = r"\p{L}", r"\p{L}\p{N}"


def script_of(ch: str) -> str:
    """The first word of a letter's Unicode name, HAN for CJK; OTHER without a name."""
    return unicodedata.name(ch, "OTHER").split(" ", 1)[0].replace("CJK", "HAN")


@lru_cache(maxsize=1)
def _ranges() -> dict[str, list[list[int]]]:
    out: dict[str, list[list[int]]] = {s: [] for s in SCRIPTS}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if not ch.isalpha():
            continue
        spans = out.get(script_of(ch))
        if spans is None:
            continue
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return out


@lru_cache(maxsize=None)
def script_class(script: str) -> str:
    """A Java character class of the letters of one script."""
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges()[script]) + "]"
