"""Subtitle files as canonical segments: SRT, WebVTT, ASS, and two JSON dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_CLOCK = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})"
_BILI = "struct<body:array<struct<`from`:double,`to`:double,content:string>>>"
_JSON3 = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"


def _ms(text: Column, first: int) -> Column:
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, f"{_CLOCK}.*?{_CLOCK}", first + k), F.lit("")), F.lit("0")).cast("bigint")
    fraction = F.rpad(F.regexp_extract(text, f"{_CLOCK}.*?{_CLOCK}", first + 3), 3, "0").cast("bigint")
    return (part(0) * 3600 + part(1) * 60 + part(2)) * 1000 + fraction


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("seq").cast("int").alias("seq"), "start_ms", "end_ms", "text")


def parse_cues(files: DataFrame, doc_id: str = "path", text: str = "value") -> DataFrame:
    """SRT and WebVTT: blocks parted by blank lines, of which those with a line of two times are cues.

    Markup in angle brackets and position settings go, line breaks within a cue stay. Files with either line ending.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "^﻿", "")
    blocks = files.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(clean, r"\n[ \t]*\n+")).alias("block", "b"))
    timed = blocks.where(F.col("b").rlike(rf"{_CLOCK}\s*-->\s*{_CLOCK}"))
    line = F.regexp_extract("b", r"(?m)^.*-->.*$", 0)
    body = F.regexp_extract("b", r"(?s)-->[^\n]*\n(.*)$", 1)
    rows = timed.select("doc_id", F.col("block").alias("seq"), _ms(line, 1).alias("start_ms"), _ms(line, 5).alias("end_ms"), _stripped(F.regexp_replace(body, r"<[^<>]*>", "")).alias("text"))
    return _out(rows)


def parse_ass(files: DataFrame, doc_id: str = "path", text: str = "value") -> DataFrame:
    """ASS: the Dialogue lines; override tags go, \\N is a line break. The text is all behind the ninth comma."""
    rows = files.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")).alias("seq", "l")).where(F.startswith("l", F.lit("Dialogue:")))
    times = F.regexp_extract("l", r"^Dialogue:[^,]*,([^,]*,[^,]*)", 1)
    said = F.regexp_extract("l", r"^Dialogue:(?:[^,]*,){9}(.*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(said, r"\{[^{}]*\}", ""), r"\\[Nn]", "\n")
    return _out(rows.select("doc_id", "seq", _ms(times, 1).alias("start_ms"), _ms(times, 5).alias("end_ms"), _stripped(plain).alias("text")))


def parse_player_json(files: DataFrame, doc_id: str = "path", text: str = "value") -> DataFrame:
    """The player's JSON: body of from, to, content in seconds."""
    rows = files.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.from_json(text, _BILI)["body"]).alias("seq", "s"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return _out(rows.select("doc_id", "seq", ms("s.from").alias("start_ms"), ms("s.to").alias("end_ms"), F.col("s.content").alias("text")))


def parse_json3(files: DataFrame, doc_id: str = "path", text: str = "value") -> DataFrame:
    """JSON3: events in milliseconds with text in segs; events without text are dropped."""
    rows = files.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.from_json(text, _JSON3)["events"]).alias("seq", "e")).where("e.segs is not null")
    said = F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), "")
    out = rows.select("doc_id", "seq", F.col("e.tStartMs").alias("start_ms"), (F.col("e.tStartMs") + F.coalesce("e.dDurationMs", F.lit(0))).alias("end_ms"), said.alias("text"))
    return _out(out.where(F.trim("text") != ""))


PARSERS = {"srt": parse_cues, "vtt": parse_cues, "ass": parse_ass, "json": parse_player_json, "json3": parse_json3}


def read_subtitles(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Canonical segments of all files at a path, one file being one document."""
    if kind not in PARSERS:
        raise ValueError(f"unknown subtitle format {kind!r}, known: {sorted(PARSERS)}")
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return PARSERS[kind](files)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """A text file without times: one segment per line, times null."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    rows = files.select(F.col("path").alias("doc_id"), F.posexplode(F.split("value", "\n")).alias("seq", "text"))
    none = F.lit(None).cast("bigint")
    return _out(rows.select("doc_id", "seq", none.alias("start_ms"), none.alias("end_ms"), "text").where(F.trim("text") != ""))


#: Nested metadata as fetched and dropped into a folder by another program.
METADATA = "video_id string, title string, duration double, uploader string, subtitles array<struct<lang:string,url:string>>, chapters array<struct<title:string,`from`:double,`to`:double>>, comments array<struct<user:string,text:string,likes:bigint>>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata, subtitle tracks, chapters and comments of media, one JSON object per line; malformed lines fail the job."""
    return spark.read.schema(METADATA).option("mode", "FAILFAST").json(path)


def read_eval(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Input of a score as canonical segments: canonical or asr (JSON lines), txt, or any subtitle format."""
    if kind == "txt":
        return read_plain(spark, path)
    if kind in PARSERS and kind != "json":
        return read_subtitles(spark, path, kind)
    if kind not in ("canonical", "asr"):
        raise ValueError(f"unknown kind {kind!r}")
    fields = "`from` double, `to` double, content string" if kind == "asr" else "`start` double, `end` double, text string"
    rows = spark.read.schema(f"{fields}, doc_id string, seq int").option("mode", "FAILFAST").json(path)
    from ..model import canonical_segments, require_ok

    return _out(require_ok(canonical_segments(rows, "doc_id", "seq")).drop("status"))
