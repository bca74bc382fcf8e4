"""Characters that look alike: tables and folding shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

#: Cyrillic and Greek letters whose shape is that of a Latin letter.
_CYRILLIC = "аеорсхуіѕјԁһԛԝАВЕКМНОРСТХУІЅЈԌԚԜ"
_CYRILLIC_AS = "aeopcxyisjdhqwABEKMHOPCTXYISJGQW"
_GREEK = "ονιαρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
_GREEK_AS = "oviapuABEZHIKMNOPTYX"

TO_LATIN = dict(zip(_CYRILLIC + _GREEK, _CYRILLIC_AS + _GREEK_AS, strict=True))
LATIN_TO = {
    "Cyrillic": dict(zip(_CYRILLIC_AS, _CYRILLIC, strict=True)),
    "Greek": dict(zip(_GREEK_AS, _GREEK, strict=True)),
}
_LATIN_TABLE = str.maketrans(TO_LATIN)

#: Ranges of characters without a shape of their own: soft hyphen, joiners, fillers, zero widths, marks of
#: direction, variation selectors, byte-order mark.
_SHAPELESS = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB),
]
#: The same as the inside of a character class.
INVISIBLE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _SHAPELESS)
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_BLANK = re.compile(r"[^\S\n ]")
_BREAK = re.compile(f"\r\n|[\r\x85{chr(0x2028)}{chr(0x2029)}]")


def visible(text: str) -> str:
    """Text without characters that have no shape."""
    return _INVISIBLE.sub("", text)


def compatible(text: str) -> str:
    """NFKC of the visible text, with one kind of blank and one kind of line break."""
    if text.isascii():
        out = text
    else:
        out = unicodedata.normalize("NFKC", visible(text))
    out = _BREAK.sub("\n", out)
    return out if out.isascii() and "\t" not in out else _BLANK.sub(" ", out)


def token_key(token: str) -> str:
    """Key under which spellings of a token that look the same are counted, without case."""
    if token.isascii():
        return token.lower()
    return unicodedata.normalize("NFKC", visible(token)).translate(_LATIN_TABLE).lower()
