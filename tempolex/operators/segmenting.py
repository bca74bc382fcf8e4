"""Cutting segments anew and putting marks at pauses."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bare, is_blank
from .scan import by_number, scan

# Marks at which a piece ends, particles that make a pause a question or keep it short.
ENDS = "。！？!?"
_ASKS = "吗|呢|么"
_GOES_ON = "但是|所以|因为|然后|而且|不过|如果"


def recut(df: DataFrame, keys: list[str], text: str = "text", most_chars: int = 28) -> DataFrame:
    """Pieces (keys..., piece_no, start_ms, end_ms, text) of segments, cut by characters, also within words.

    Not the cut at words, which is resegment(). A piece ends behind one of the marks 。！？!? or at most_chars characters, whichever is first. Times are shared out
    by characters, so they never run backwards, and the pieces put together are the text. Null and empty texts give no
    piece; null times stay null.
    """
    cut = F.regexp_extract_all(F.col(text), F.lit(f"(?s)[^{ENDS}]{{0,{most_chars - 1}}}[{ENDS}]|[^{ENDS}]{{1,{most_chars}}}"), F.lit(0))
    rows = df.select(*keys, "start_ms", "end_ms", F.length(text).alias("_n"), F.posexplode(cut).alias("piece_no", "text"), cut.alias("_all"))
    before = F.aggregate(F.slice("_all", F.lit(1), F.col("piece_no")), F.lit(0), lambda a, x: a + F.length(x))
    rows = rows.withColumn("_a", before).withColumn("_b", F.col("_a") + F.length("text"))
    span = F.col("end_ms") - F.col("start_ms")
    at = lambda c: F.col("start_ms") + F.floor(span * F.col(c) / F.col("_n")).cast("bigint")
    return rows.select(*keys, "piece_no", at("_a").alias("start_ms"), at("_b").alias("end_ms"), "text")


def cut_words(words: Column, most_chars: int = 28, pause_ms: int = 600) -> Column:
    """An array of words whose text is not at hand cut into an array of pieces (start_ms, end_ms, text, n_words).

    Texts are joined of the words; cut_content() slices a text.

    A piece ends before it would pass most_chars, behind a pause of pause_ms, or behind a mark. One fold over the
    array, so the state is reset at every cut. Null stays null, an empty array gives none.
    """
    zero = F.struct(F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,text:string,n_words:int>>").alias("done"), F.lit(None).cast("struct<start_ms:bigint,end_ms:bigint,text:string,n_words:int>").alias("open"))

    def step(acc: Column, w: Column) -> Column:
        o = acc["open"]
        fresh = F.struct(w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["word"].alias("text"), F.lit(1).alias("n_words"))
        longer = F.struct(o["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), F.concat(o["text"], w["word"]).alias("text"), (o["n_words"] + 1).alias("n_words"))
        cut = (F.length(o["text"]) + F.length(w["word"]) > most_chars) | (w["start_ms"] - o["end_ms"] >= pause_ms) | o["text"].rlike(f"[{ENDS}]$")
        return F.when(o.isNull(), F.struct(acc["done"].alias("done"), fresh.alias("open"))).when(cut, F.struct(F.concat(acc["done"], F.array(o)).alias("done"), fresh.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), longer.alias("open")))

    return F.aggregate(words, zero, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


_WORD_PIECE = "array<struct<start_ms:bigint,end_ms:bigint,text:string,n_words:int>>"


def _cut(text: str, words: list, most_chars: int, pause_ms: int) -> list[tuple[int, int, str, int]] | None:
    """Pieces (start_ms, end_ms, text, n_words) of a text by its words, or None if they do not fit it."""
    spans, at, before = [], 0, None
    for w in words:
        if w is None:
            return None
        said, s, e = (w["word"] or "").strip(), w["start_ms"], w["end_ms"]
        if s is None or e is None or e < s or before is not None and s < before:
            return None
        before = e
        if not said:
            continue
        while at < len(text) and text[at].isspace():
            at += 1
        if not text.startswith(said, at):
            return None
        spans.append((at, at + len(said), s, e))
        at += len(said)
    if not spans or text[at:].strip():
        return None
    # A piece takes the text up to the first character of the next one, so that all of it is kept.
    heads = [0]
    for k in range(1, len(spans)):
        (_, hi, _, e), s = spans[k - 1], spans[k][2]
        if hi - (spans[heads[-1]][0] if heads[-1] else 0) >= most_chars or s - e >= pause_ms or text[hi - 1] in ENDS:
            heads.append(k)
    out = []
    for k, nxt in zip(heads, [*heads[1:], len(spans)]):
        lo, hi = spans[k][0] if k else 0, spans[nxt][0] if nxt < len(spans) else len(text)
        out.append((spans[k][2], spans[nxt - 1][3], text[lo:hi], nxt - k))
    return out


def cut_content(text: Column, words: Column, start_ms: Column, end_ms: Column, most_chars: int = 28, pause_ms: int = 600) -> Column:
    """A segment cut at its words into an array of pieces (start_ms, end_ms, text, n_words).

    A piece ends behind the word with which it reaches most_chars, before a pause of pause_ms, or behind a word that
    ends with one of 。！？!?. Its text is a slice of the segment's, so the pieces put together are the text. A segment
    without words, whose words are not the text but for blanks, or whose times run backwards or leave the segment,
    stays whole, with its own times and n_words 0. A null or empty text gives none.
    """

    def run(texts: pd.Series, lists: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, w, s, e in zip(texts, lists, starts, ends):
            s, e = (None if pd.isna(v) else int(v) for v in (s, e))
            got = _cut(t, list(w), most_chars, pause_ms) if t and w is not None else None
            if got and (s is not None and got[0][0] < s or e is not None and got[-1][1] > e):
                got = None
            out.append([] if not t else got or [(s, e, t, 0)])
        return pd.Series([[dict(zip(("start_ms", "end_ms", "text", "n_words"), p)) for p in o] for o in out])

    return F.pandas_udf(run, _WORD_PIECE)(text, words, start_ms, end_ms)


def resegment(df: DataFrame, keys: list[str], text: str = "text", words: str = "words", most_chars: int = 28, pause_ms: int = 600) -> DataFrame:
    """Pieces (keys..., piece_no, start_ms, end_ms, text) of segments, cut at words only; see cut_content().

    Without a column of words every segment stays whole. Null and empty texts give no piece.
    """
    if words not in df.columns:
        return df.where(F.col(text) != "").select(*keys, F.lit(0).alias("piece_no"), "start_ms", "end_ms", F.col(text).alias("text"))
    pieces = cut_content(F.col(text), F.col(words), F.col("start_ms"), F.col("end_ms"), most_chars, pause_ms)
    return df.select(*keys, F.posexplode(pieces).alias("piece_no", "_p")).select(*keys, "piece_no", "_p.start_ms", "_p.end_ms", "_p.text")


def pause_marks(df: DataFrame, key: str, order: str, id_col: str, text: str = "text", full_ms: int = 600, least_ms: int = 100) -> DataFrame:
    """df with pause_ms to the next segment of the key and the mark to put behind its text; the text stays as it is.

    No mark where the text ends with one, is null or blank, or the pause is below least_ms. From full_ms on, or at the
    end of the key, a full stop, a question mark behind a particle that asks; below it a comma. A text of the next
    segment that begins with a conjunction makes a full stop a comma if the pause is below twice full_ms. mode names the
    method that took effect: rules.
    """
    nxt = F.struct(F.col("start_ms").alias("s"), F.col(text).alias("t"))
    seen = scan(df.where(f"{order} is not null"), [key], by_number(order), [order, id_col], {"_next": ("last", nxt)}, reverse=True)
    pause = F.col("_next.s") - F.col("end_ms")
    goes_on = F.coalesce(F.col("_next.t").rlike(f"^(?:{_GOES_ON})"), F.lit(False))
    stop = F.when(F.col(text).rlike(f"(?:{_ASKS})$"), "？").otherwise("。")
    mark = (
        F.when(F.col(text).isNull() | is_blank(F.col(text)) | F.col(text).rlike("[，。！？、；：,.!?;:…”\"）)」]$"), "")
        .when(F.col("_next").isNull() | (pause >= 2 * full_ms), stop)
        .when(pause.isNull() | (pause < least_ms), "")
        .when((pause >= full_ms) & ~goes_on, stop)
        .otherwise("，")
    )
    return seen.select(*df.columns, pause.alias("pause_ms"), mark.alias("mark"), F.lit("rules").alias("mode"))


def punctuate(df: DataFrame, key: str, order: str, id_col: str, text: str = "text", backend: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """df with `readable`, its text with marks, and the mode that took effect.

    `backend` maps texts to texts with marks (mode `model`); where it gives a null or changes anything but marks and
    blanks, and without one, the pause rules stand (mode `rules`).
    """
    ruled = pause_marks(df, key, order, id_col, text)
    by_rules = F.concat(F.coalesce(text, F.lit("")), "mark")
    if backend is None:
        return ruled.select(*df.columns, by_rules.alias("readable"), "mode")

    def run(t: pd.Series) -> pd.Series:
        return backend(t)

    said = F.pandas_udf(run, "string")(F.col(text))
    both = ruled.withColumn("_said", said)
    sound = F.coalesce(bare(F.col("_said")) == bare(F.col(text)), F.lit(False))
    return both.select(*df.columns, F.when(sound, F.col("_said")).otherwise(by_rules).alias("readable"), F.when(sound, "model").otherwise("rules").alias("mode"))


def topic_chunks(df: DataFrame, key: str, order: str, id_col: str, text: str = "text", most_chars: int = 600) -> DataFrame:
    """df with chunk_no: consecutive segments of a key in chunks of about most_chars, by their running length.

    A chunk is left where the characters so far pass a multiple of most_chars; no segment is cut.
    """
    seen = scan(df.where(f"{order} is not null"), [key], by_number(order), [order, id_col], {"_n": ("sum", F.coalesce(F.length(text), F.lit(0)))})
    return seen.withColumn("chunk_no", F.floor(F.col("_n") / most_chars).cast("bigint")).drop("_n")
