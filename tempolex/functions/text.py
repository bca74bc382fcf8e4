"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

# Traditional characters and their simplified forms, one to one; the fallback without a dictionary.
TRADITIONAL = "這個說過會時問學來對開關們還給經麼點邊裡後聽覺應該與實際變數據題頁圖樣條習課講請讓長樂東車馬門見貝"
SIMPLIFIED = "这个说过会时问学来对开关们还给经么点边里后听觉应该与实际变数据题页图样条习课讲请让长乐东车马门见贝"
# Marks that do not count as text in a score.
MARKS = "，。！？、；：“”‘’（）《》【】…—,.!?;:\"'()[]-~·"
_HALF = "".join(map(chr, range(0x21, 0x7F)))
_FULL = "".join(chr(ord(c) + 0xFEE0) for c in _HALF)


def simplify(text: Column, mode: str = "auto", converter: Callable[[pd.Series], pd.Series] | None = None) -> tuple[Column, str]:
    """Simplified characters and the mode that took effect: off, converter (the caller's), or fallback (the table above).

    `on` needs a converter; `auto` takes one if given.
    """
    if mode not in ("auto", "on", "off"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "off":
        return text, "off"
    if converter is not None:
        return _converted(text, converter), "converter"
    if mode == "on":
        raise RuntimeError("no conversion dictionary is installed; use auto or give a converter")
    return F.translate(text, TRADITIONAL, SIMPLIFIED), "fallback"


def _converted(text: Column, converter: Callable[[pd.Series], pd.Series]) -> Column:
    def run(t: pd.Series) -> pd.Series:
        return converter(t)

    return F.pandas_udf(run, "string")(text)


def half_width(text: Column) -> Column:
    """Full-width ASCII and the ideographic blank in their usual width."""
    return F.translate(text, _FULL + "　", _HALF + " ")


def bare(text: Column) -> Column:
    """Text without marks and blanks."""
    return F.regexp_replace(F.translate(text, MARKS, ""), r"\s+", "")


def is_blank(text: Column) -> Column:
    """True for a text of nothing but blanks of any kind; null for null."""
    return text.rlike(r"(?U)^\s*$")


def norm_for_score(text: Column) -> Column:
    """Form in which texts are compared: usual width, no marks, small letters, simplified characters."""
    return F.lower(simplify(bare(half_width(text)))[0])


def timecode(t: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm of milliseconds."""
    h, m, s = F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h.cast("bigint"), m.cast("bigint"), s.cast("bigint"), (t % 1000).cast("bigint"))


def wrap(text: Column, width: int) -> Column:
    """Lines of at most `width` characters, nothing lost."""
    return F.regexp_replace(text, f"(.{{{int(width)}}})(?=.)", "$1\n")


# Digits and units of Chinese numerals.
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_UNITS = {"十": 10, "百": 100, "千": 1000}
_BIG = {"万": 10_000, "亿": 100_000_000}
_NUMERAL = re.compile("[零〇一二两三四五六七八九十百千万亿]+")


def arabic(numeral: str) -> str:
    """A Chinese numeral in Arabic digits; a row of bare digits is read digit by digit, what is none stays."""
    if not any(c in _UNITS or c in _BIG for c in numeral):
        return "".join(str(_DIGITS[c]) for c in numeral)
    total = part = digit = 0
    for c in numeral:
        if c in _DIGITS:
            digit = _DIGITS[c]
        elif c in _UNITS:
            part += (digit or (1 if part == 0 else 0)) * _UNITS[c]
            digit = 0
        else:
            if total + part + digit == 0:
                return numeral
            total = (total + part + digit) * _BIG[c] if _BIG[c] > total or not total else total + (part + digit) * _BIG[c]
            part = digit = 0
    return str(total + part + digit)


def numerals(text: Column) -> Column:
    """Chinese numerals of the text in Arabic digits."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _NUMERAL.sub(lambda m: arabic(m[0]), t))

    return F.pandas_udf(run, "string")(text)


def redact(text: Column) -> Column:
    """Text without cookies, tokens, signed addresses, keys and paths of a user's machine."""
    out = text
    for pattern, put in REDACTIONS:
        out = F.regexp_replace(out, pattern, put)
    return out


# What must not leave the machine, the same patterns for both engines.
REDACTIONS = [
    (r"(?i)(SESSDATA|bili_jct|sessionid|ttwid|cookie)\s*[=:]\s*[^\s;,]+", "[cookie]"),
    (r"(?i)(access_token|api_key|apikey|secret|authorization)\s*[=:]\s*[^\s;,]+", "[token]"),
    (r"https?://[^\s]*[?&](sign|signature|token|expires|auth_key)=[^\s]*", "[signed-url]"),
    (r"[A-Za-z]:\\Users\\[^\\\s]+", "[home]"),
    (r"/(home|Users)/[A-Za-z0-9_.-]+", "[home]"),
    (r"/tmp/[A-Za-z0-9_./-]+", "[tmp]"),
]
