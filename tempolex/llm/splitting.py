"""Splitting oversized texts where they pause, by lexical cohesion, with overlap."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from math import sqrt

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: The marks that end a sentence for the purpose of a natural cut.
ENDS = ".!?。！？"
_CLOSERS = "\"'”’»)）」』】》〉］]"
_STRETCH = regex.compile(rf"[^\s{regex.escape(ENDS)}]+")
#: A place to cut is the end of a match; the group tells its rank: 3 line break, 2 sentence end, 1 blank, 0 clause mark.
_PAUSE = regex.compile(
    rf"(?P<line>[ \t]*[\r\n]\s*)|(?P<end>[{regex.escape(ENDS)}]+[{regex.escape(_CLOSERS)}]*(?!\p{{N}}))|(?P<blank>\s+)|(?P<clause>[,，;；、:：])"
)
_RANK = {"line": 3, "end": 3, "blank": 1, "clause": 0}
_NAME = {3: "pause", 1: "blank", 0: "clause", -1: "hard"}
_WORD = regex.compile(
    r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{1,2}|[\p{L}\p{N}\p{M}]+"
)


def _places(text: str) -> tuple[list[int], list[int]]:
    """Ends of the pauses inside the text and their ranks, ascending."""
    at, rank = [], []
    n = len(text)
    for m in _PAUSE.finditer(text):
        if 0 < m.end() < n:
            at.append(m.end())
            rank.append(_RANK[m.lastgroup])
    return at, rank


def _similarities(text: str, at: list[int], block: int) -> list[float]:
    """Cosine of the words of the `block` characters on either side of each place of `at`, ascending.

    Two blocks slide over the words of the text; counts, lengths and the product are kept up to date word by word, so
    the cost is that of the words, however many places there are.
    """
    words = [(m.start(), m[0].lower()) for m in _WORD.finditer(text)]
    starts = [p for p, _ in words]
    left: Counter = Counter()
    right: Counter = Counter()
    dot = left_2 = right_2 = 0
    # Words left_lo..middle are in the block before a place, middle..right_hi in the one behind it.
    left_lo = middle = right_hi = 0
    out = []
    for place in at:
        to = bisect_left(starts, place + block, right_hi)
        for _, w in words[right_hi:to]:
            n = right[w]
            right_2 += 2 * n + 1
            dot += left[w]
            right[w] = n + 1
        right_hi = to
        to = bisect_left(starts, place, middle)
        for _, w in words[middle:to]:
            n = right[w]
            right_2 -= 2 * n - 1
            right[w] = n - 1
            m = left[w]
            dot += n - 1 - m
            left_2 += 2 * m + 1
            left[w] = m + 1
        middle = to
        to = bisect_left(starts, place - block, left_lo)
        for _, w in words[left_lo:to]:
            m = left[w]
            left_2 -= 2 * m - 1
            dot -= right[w]
            left[w] = m - 1
        left_lo = to
        out.append(dot / sqrt(left_2 * right_2) if left_2 and right_2 else 0.0)
    return out


def _depths(sims: list[float]) -> list[float]:
    """Depth of the valley at each gap: how far one climbs from it on either side before the curve falls again."""
    n = len(sims)
    left, right = list(sims), list(sims)
    for i in range(1, n):
        if sims[i - 1] >= sims[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            right[i] = right[i + 1]
    return [a + b - 2 * s for a, b, s in zip(left, right, sims)]


def split_text(text: str, max_size: int, overlap: int, block: int = 240) -> tuple[list[tuple[int, int, int, str]], bool]:
    """Pieces (start, end, repeated characters, kind of cut at the end) of a text, and whether it is `forced`.

    Forced: some stretch of more than max_size characters has no blank, line break or sentence-ending mark. A text
    within max_size is one piece. Every piece is within max_size and starts `overlap` characters before the end of the
    one before it (less only where the piece would then have to break a stretch that fits without). Over all sentence
    ends and line breaks of the text the words of the `block` characters on either side are compared; the cut of a
    piece is the deepest valley of that curve within its window, the later one of equal depth. A window without such a
    place is cut at its last blank, else clause mark, and at last at the limit itself.
    """
    n = len(text)
    forced = any(m.end() - m.start() > max_size for m in _STRETCH.finditer(text))
    if n <= max_size:
        return [(0, n, 0, "end")], forced
    overlap = max(0, min(overlap, max_size // 2))
    at, rank = _places(text)
    pauses = [p for p, r in zip(at, rank) if r == 3]
    depth = dict(zip(pauses, _depths(_similarities(text, pauses, block))))
    strong = [k for k, r in enumerate(rank) if r >= 1]
    pieces: list[tuple[int, int, int, str]] = []
    start, fresh, lo = 0, 0, 0
    while True:
        limit = start + max_size
        if limit >= n:
            pieces.append((start, n, fresh - start, "end"))
            return pieces, forced
        while lo < len(at) and at[lo] <= fresh:
            lo += 1
        hi = lo
        while hi < len(at) and at[hi] <= limit:
            hi += 1
        cut, kind = _choose(text, at, rank, lo, hi, fresh, limit, depth)
        if kind < 1 and start < fresh:
            # A stretch that fits into a piece is not broken for the sake of the full overlap.
            ahead = bisect_left(strong, lo)
            nxt = strong[ahead] if ahead < len(strong) else None
            reach = at[nxt] if nxt is not None else n
            if reach - fresh <= max_size:
                start = max(start, reach - max_size)
                pieces.append((start, reach, fresh - start, _NAME[rank[nxt]] if nxt is not None else "end"))
                if reach == n:
                    return pieces, forced
                fresh, start = reach, max(start + 1, reach - overlap)
                continue
        pieces.append((start, cut, fresh - start, _NAME[kind]))
        fresh, start = cut, max(start + 1, cut - overlap)


def _choose(text: str, at: list[int], rank: list[int], lo: int, hi: int, fresh: int, limit: int, depth: dict[int, float]) -> tuple[int, int]:
    """Where the window's places lo..hi, all behind `fresh`, cut it, and the rank of that place; -1 for the limit."""
    pauses = [at[k] for k in range(lo, hi) if rank[k] == 3]
    if pauses:
        return max(pauses, key=lambda p: (depth[p], p)), 3
    for least in (1, 0):
        if some := [at[k] for k in range(lo, hi) if rank[k] >= least]:
            return some[-1], least
    # Not between a character and its marks.
    cut = limit
    while cut > fresh + 1 and unicodedata.category(text[cut]) in ("Mn", "Mc", "Me", "Cf"):
        cut -= 1
    return (cut if limit - cut < 16 else limit), -1


_PIECES = "struct<forced:boolean,pieces:array<struct<start:int,end:int,repeated:int,cut:string>>>"


def split_oversized(df: DataFrame, id_col: str, text_col: str, max_size: int, overlap: int, kind: str) -> DataFrame:
    """Pieces of every text longer than max_size characters.

    Result: unit_kind, unit_id, piece_no, start_char, end_char, n_repeated, cut (pause, blank, clause, hard, end),
    cut_kind (of the whole text: natural or forced) and piece. Null texts, null ids and texts within the limit give no
    row; rows delivered again (equal id) count once; columns besides the two are ignored. Each text is split on its
    own, so there is no shuffle but the one over the oversized rows that removes deliveries.
    """
    if max_size < 2:
        raise ValueError("max_size must be 2 at least")

    @F.pandas_udf(_PIECES)
    def pieces(texts: pd.Series) -> pd.DataFrame:
        forced, out = [], []
        for t in texts:
            p, f = split_text(t, max_size, overlap)
            forced.append(f)
            out.append([{"start": a, "end": b, "repeated": r, "cut": c} for a, b, r, c in p])
        return pd.DataFrame({"forced": forced, "pieces": out})

    long = df.where(F.length(text_col) > max_size).where(F.col(id_col).isNotNull())
    once = long.select(F.col(id_col).alias("unit_id"), F.col(text_col).alias("text")).dropDuplicates(["unit_id"])
    done = once.withColumn("split", pieces("text"))
    flat = done.select("unit_id", "text", F.col("split.forced").alias("forced"), F.posexplode("split.pieces").alias("piece_no", "p"))
    return flat.select(
        F.lit(kind).alias("unit_kind"),
        F.col("unit_id").cast("bigint").alias("unit_id"),
        "piece_no",
        F.col("p.start").alias("start_char"),
        F.col("p.end").alias("end_char"),
        F.col("p.repeated").alias("n_repeated"),
        F.col("p.cut").alias("cut"),
        F.when(F.col("forced"), "forced").otherwise("natural").alias("cut_kind"),
        F.expr("substring(text, p.start + 1, p.end - p.start)").alias("piece"),
    )
