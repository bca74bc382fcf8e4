"""Filters, marks and merges over segments and subtitle cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import counted
from .scan import by_number, by_time, scan

# How overlaid adverts and watermarks read.
NOISE = ["关注", "点赞", "投币", "一键三连", "扫码", "加群", "优惠", "http", "www\\.", "@[A-Za-z0-9_]+", "^[A-Za-z0-9]{1,3}$"]
# Stable misreadings of a recogniser of subtitles, one character each.
MISREAD = {"囗": "口", "曰": "日", "巳": "已", "末": "未"}
# What a failure's text tells, and its code; the first that matches. 0 is success, 1 not known, 20 no
# stream on the page, 21 login needed, 22 network, 23 quality not offered, 24 transcription, 26 browser, 27 no audio.
FAILURES = [(27, "no audio|audio stream"), (21, "403|forbidden|login|cookie"), (22, "timeout|timed out|ssl|connection|412|429|too many requests|rate limit"), (23, "quality|resolution"), (24, "transcri|whisper|cuda"), (26, "browser|cdp|playwright"), (20, "404|not found|deleted|no stream|不存在")]
# Exceptions whose type alone tells the code.
FAILURE_TYPES = {"LoginRequired": 21, "PermissionError": 21, "TimeoutError": 22, "ConnectTimeout": 22, "ReadTimeout": 22, "QualityUnavailable": 23, "TranscriptionError": 24}


def filler_only(df: DataFrame, fillers: DataFrame, text: str = "text") -> DataFrame:
    """Rows that are nothing but one word of `fillers`, with that word. The rest of a cleaned transcript is the anti-join.

    Case, outer blanks and marks do not count. A word within a sentence is no filler here.
    """
    bare = F.lower(F.regexp_replace(F.col(text), r"[\s，。、！？,.!?…~～]", ""))
    words = fillers.where("word is not null").select(F.lower(F.regexp_replace("word", r"\s", "")).alias("_bare"), "word").groupBy("_bare").agg(F.min("word").alias("word"))
    return df.withColumn("_bare", bare).join(counted(words), "_bare").drop("_bare")


def low_confidence_cards(confidence: str, least: float = 0.5) -> Column:
    """True for a card read with too little confidence; false for an unknown one."""
    return F.coalesce(F.col(confidence) < least, F.lit(False))


def noise(text: str, patterns: list[str] | None = None) -> Column:
    """True for watermarks, adverts and short scraps of Latin letters; never by length alone."""
    return F.coalesce(F.col(text).rlike("|".join(f"(?:{p})" for p in (patterns or NOISE))), F.lit(False))


def corrected(text: Column, table: dict[str, str] | None = None) -> Column:
    """Text with known misreadings put right; single characters at once, longer entries in order."""
    table = MISREAD if table is None else table
    one = {k: v for k, v in table.items() if len(k) == len(v) == 1}
    out = F.translate(text, "".join(one), "".join(one.values())) if one else text
    for wrong, right in table.items():
        if wrong not in one:
            out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def quality_marks(df: DataFrame, logprob: str = "avg_logprob", compression: str = "compression_ratio", least_logprob: float = -1.0, most_compression: float = 2.4) -> DataFrame:
    """df with low_confidence and suspected_hallucination; marks only, and null where the measure is unknown."""
    return df.withColumn("low_confidence", F.col(logprob) < least_logprob).withColumn("suspected_hallucination", F.col(compression) > most_compression)


def failure_code(message: Column, kind: Column | None = None) -> Column:
    """Status code of a failure: 0 for none, 1 for one not known. The type of the exception, where given and known,
    decides before the text."""
    known = F.create_map(*(F.lit(x) for pair in FAILURE_TYPES.items() for x in pair))
    out = F.when(message.isNull() if kind is None else message.isNull() & kind.isNull(), 0)
    if kind is not None:
        out = out.when(F.element_at(known, F.element_at(F.split(kind, r"\."), -1)).isNotNull(), F.element_at(known, F.element_at(F.split(kind, r"\."), -1)))
    for code, pattern in FAILURES:
        out = out.when(F.lower(message).rlike(pattern), code)
    return out.otherwise(1)


def audio_code(has_audio: Column) -> Column:
    """0 for a source with an audio track; 27 without one, and where the probe failed, which is a null."""
    return F.when(F.coalesce(has_audio, F.lit(False)), 0).otherwise(27)


def adjacent_duplicates(df: DataFrame, key: str, order: str, id_col: str, text: str = "text") -> DataFrame:
    """Rows whose text equals that of the row before in the same key; two nulls are equal. Rows with null key or order take no part."""
    seen = scan(df.where(f"{order} is not null"), [key], by_number(order), [order, id_col], {"_before": ("last", F.struct(F.col(text).alias("t")))})
    return seen.where(F.col("_before").isNotNull() & F.col("_before.t").eqNullSafe(F.col(text))).drop("_before")


def merge_fragments(df: DataFrame, key: str, order: str, id_col: str, text: str = "text", least_ms: int = 500) -> DataFrame:
    """Pieces (key, piece_no, start_ms, end_ms, n_parts, text): fragments shorter than least_ms join the piece before.

    Fragments at the very start join the first full segment; a key of fragments only is one piece. Rows with null key,
    order or times are left out; a null text adds nothing. No character is lost or moved.
    """
    rows = df.where(f"{key} is not null and {order} is not null and start_ms is not null and end_ms is not null").select(key, order, id_col, "start_ms", "end_ms", text)
    full = (F.col("end_ms") - F.col("start_ms") >= least_ms).cast("int")
    seen = scan(rows, [key], by_number(order), [order, id_col], {"_n": ("sum", full)}, inclusive=True)
    pieces = seen.withColumn("piece_no", F.greatest(F.col("_n"), F.lit(1)).cast("bigint")).groupBy(key, "piece_no").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.count("*").alias("n_parts"),
        F.array_sort(F.collect_list(F.struct(order, id_col, F.coalesce(text, F.lit("")).alias("t")))).alias("_t"),
    )
    return pieces.withColumn("text", F.array_join(F.transform("_t", lambda x: x["t"]), "")).drop("_t")


def change_points(df: DataFrame, key: str, time: str, id_col: str, value: str) -> DataFrame:
    """df with is_change: the first row of a key, and each whose value differs from the one before (nulls are equal)."""
    seen = scan(df.where(f"{time} is not null"), [key], by_time(time), [time, id_col], {"_before": ("last", F.struct(F.col(value).alias("v")))})
    return seen.withColumn("is_change", F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))).drop("_before")


def card_runs(df: DataFrame, key: str, time: str, id_col: str, value: str, until: str) -> DataFrame:
    """Runs (key, run_no, start_ms, end_ms, n_cards, text) of consecutive rows of equal value; single cards stay."""
    marked = change_points(df, key, time, id_col, value)
    numbered = scan(marked, [key], by_time(time), [time, id_col], {"run_no": ("sum", F.col("is_change").cast("bigint"))}, inclusive=True)
    return numbered.groupBy(key, "run_no").agg(
        F.min(time).alias("start_ms"), F.max(until).alias("end_ms"), F.count("*").alias("n_cards"), F.first(value).alias("text")
    )


def peaks(df: DataFrame, key: str, time: str, id_col: str, score: str, least: float) -> DataFrame:
    """Rows whose score is at least `least`, above that of the row before and not below that of the next; null scores count as 0."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    rows = df.where(f"{time} is not null")
    seen = scan(rows, [key], by_time(time), [time, id_col], {"_before": ("last", s)})
    seen = scan(seen, [key], by_time(time), [time, id_col], {"_next": ("last", s)}, reverse=True)
    return seen.where((s >= least) & (s > F.coalesce("_before", F.lit(-1.0))) & (s >= F.coalesce("_next", F.lit(-1.0)))).drop("_before", "_next")
