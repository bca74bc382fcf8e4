"""The same measures over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import MEASUREMENT


def history_stream(spark: SparkSession, path: str) -> DataFrame:
    """Measurements as they are appended, JSON lines below a folder."""
    return spark.readStream.schema(MEASUREMENT).json(path)


def live_trend(history: DataFrame) -> DataFrame:
    """Runs, first and last value by case and norm, for update or complete mode."""
    return history.groupBy("case", "norm").agg(F.count("*").alias("runs"), F.min_by("cer", "timestamp").alias("first"), F.max_by("cer", "timestamp").alias("last"))


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions (key, session_start, session_end, n_events) of a stream or table; a gap ends one.

    The time is cast to a timestamp with zone, which watermarks need. On a stream in append mode a session comes out
    once the watermark has passed its end.
    """
    rows = events.select(F.col(key), F.col(time).cast("timestamp").alias("_t")).where("_t is not null")
    rows = rows.withWatermark("_t", late) if rows.isStreaming else rows
    g = rows.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def delivered_once(segments: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """A stream of segments without repeated deliveries within `late`."""
    rows = segments.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind and tumbling window."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    g = rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), kind, "n")


def recut_stream(segments: DataFrame, key: str, most_chars: int = 28, pause_ms: int = 600) -> DataFrame:
    """A stream of segments (key, start_ms, end_ms, text) joined into pieces (key, piece_no, start_ms, end_ms, text).

    A piece ends behind a mark of 。！？!?, before it would pass most_chars, or before a pause; with it the state of
    the key starts anew, so what is kept is one open piece a key. Segments of a micro-batch are taken by their start;
    those that start before the open piece ends are joined to it. Rows with a null key, time or text are left out. The
    last piece of a key comes out when the next one begins.
    """
    kind = segments.schema[key].dataType.simpleString()
    rows = segments.where(F.col(key).isNotNull()).select(key, "start_ms", "end_ms", "text").where("start_ms is not null and end_ms is not null and text is not null")

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, start, end, text = state.get if state.exists else (0, None, None, "")
        done = []
        rows = [r for f in frames for r in zip(f["start_ms"].tolist(), f["end_ms"].tolist(), f["text"].tolist())]
        for s, e, t in sorted(rows):
            if start is not None and (text[-1:] in "。！？!?" or len(text) + len(t) > most_chars or s - end >= pause_ms):
                done.append((k[0], no, start, end, text))
                no, start, end, text = no + 1, None, None, ""
            start, end, text = s if start is None else start, e if end is None else max(end, e), text + t
        state.update((no, start, end, text))
        yield pd.DataFrame(done, columns=[key, "piece_no", "start_ms", "end_ms", "text"])

    out = f"`{key}` {kind}, piece_no int, start_ms bigint, end_ms bigint, text string"
    return rows.groupBy(key).applyInPandasWithState(run, out, "piece_no int, start_ms bigint, end_ms bigint, text string", "append", GroupStateTimeout.NoTimeout)
