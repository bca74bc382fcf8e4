"""Sinks: subtitles, plain text, notes, cards and tables written for people and for other programs."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import timecode, wrap
from ..operators.scan import by_number, scan
from ..session import counted

#: What the known steps are called in a note.
STEP_LABELS = {"asr_engine": "Recogniser", "asr_coverage": "Coverage", "asr_chunking": "Chunks", "asr_confidence": "Confidence", "asr_hallucination_gate": "Hallucination gate", "simplify": "Simplified characters", "local_video": "Local file"}
FORMATS = ("md", "json", "srt", "txt")


def srt_cues(df: DataFrame, key: str, order: str, id_col: str, text: str = "text", most_chars: int = 0) -> DataFrame:
    """(key, cue_no, cue): numbered cues, lines of at most most_chars (0: as they are). Nothing is lost by wrapping.

    Rows with null key, order or times are left out; a null text is an empty cue.
    """
    rows = df.where(f"{order} is not null and start_ms is not null and end_ms is not null")
    seen = scan(rows, [key], by_number(order), [order, id_col], {"cue_no": ("count", F.lit(1))}, inclusive=True)
    said = F.coalesce(F.col(text), F.lit(""))
    said = wrap(said, most_chars) if most_chars > 0 else said
    cue = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), timecode(F.col("start_ms")), F.lit(" --> "), timecode(F.col("end_ms")), F.lit("\n"), said, F.lit("\n"))
    return seen.select(key, "cue_no", cue.alias("cue"))


def over_limit(df: DataFrame, text: str, most_chars: int) -> DataFrame:
    """One row: n_cues and those longer than one line of most_chars."""
    return df.agg(F.count("*").alias("n_cues"), F.count_if(F.length(text) > most_chars).alias("cues_over_limit"))


def plain_parts(df: DataFrame, key: str, order: str, id_col: str, text: str = "text", size: int = 256) -> DataFrame:
    """(key, part_no, text): the text of a key word for word, in parts of `size` consecutive segments."""
    rows = df.where(f"{key} is not null and {order} is not null").withColumn("part_no", by_number(order, size))
    parts = rows.groupBy(key, "part_no").agg(F.array_sort(F.collect_list(F.struct(order, id_col, F.coalesce(text, F.lit("")).alias("t")))).alias("_t"))
    return parts.select(key, "part_no", F.array_join(F.transform("_t", lambda x: x["t"]), "").alias("text"))


def note(title: Column, fields: dict[str, Column], sections: list[tuple[str, Column]]) -> Column:
    """Markdown with frontmatter; null fields and empty sections are left out."""
    head = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items()]
    body = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"## {name}\n\n"), v)) for name, v in sections]
    top = F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n"))
    return F.concat_ws("\n", top, F.concat(F.lit("# "), F.coalesce(title, F.lit("untitled")), F.lit("\n")), *body)


def templated(notes: DataFrame, templates: DataFrame, builtin: str) -> DataFrame:
    """notes (template, ...) with its body and is_builtin where the named template does not exist."""
    t = templates.groupBy(F.col("name").alias("template")).agg(F.min("body").alias("body"))
    return notes.join(counted(t), "template", "left").withColumn("is_builtin", F.col("body").isNull()).withColumn("body", F.coalesce("body", F.lit(builtin)))


def processing_section(diagnostics: DataFrame, key: str, step: str = "step") -> DataFrame:
    """(key, section): a table of the known steps of each key in the order of their names; unknown ones are left out."""
    labels = diagnostics.sparkSession.createDataFrame(list(STEP_LABELS.items()), "step string, label string")
    rows = diagnostics.select(key, F.col(step).alias("step")).distinct().join(F.broadcast(labels), "step")
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.concat(F.lit("| "), "label", F.lit(" |")))).alias("l"))
    return g.select(key, F.concat(F.lit("| Step |\n| --- |\n"), F.array_join("l", "\n")).alias("section"))


def review_section(top: DataFrame, key: str) -> DataFrame:
    """(key, section) of a shortlist (rank, a_text, b_text, size): one line per difference; no row where there is none."""
    line = F.format_string("- %d. `%s` / `%s` (%d)", "rank", F.coalesce("a_text", F.lit("")), F.coalesce("b_text", F.lit("")), "size")
    g = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("l"))
    return g.select(key, F.array_join(F.transform("l", lambda x: x["l"]), "\n").alias("section"))


def replace_section(body: Column, name: str, section: Column) -> Column:
    """A note with one section put anew, at its place or at the end; doing it twice changes nothing."""
    put = F.concat(F.lit(f"## {name}\n\n"), section, F.lit("\n"))
    parts = F.split(body, r"(?m)(?=^## )")
    is_it = lambda p: F.startswith(p, F.lit(f"## {name}\n"))
    # A section but the last keeps the empty line that parts it from the next.
    there = F.transform(parts, lambda p, i: F.when(is_it(p), F.when(i == F.size(parts) - 1, put).otherwise(F.concat(put, F.lit("\n")))).otherwise(p))
    return F.when(F.exists(parts, is_it), F.array_join(there, "")).otherwise(F.concat(F.rtrim(body), F.lit("\n\n"), put))


def backfill(existing: Column, new: Column) -> Column:
    """Frontmatter as a map: keys that exist keep their values, missing ones are added."""
    return F.map_concat(F.map_filter(new, lambda k, v: ~F.coalesce(F.map_contains_key(existing, k), F.lit(False))), existing)


def vault_pages(notes: DataFrame, topic: str, name: str, body: str) -> DataFrame:
    """(topic, name, value): notes as pages of a wiki folder by topic, for write.partitionBy(topic).text; null topics are `unsorted`.

    Characters that a path does not take become a dash.
    """
    safe = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("unsorted")), r'[\\/:*?"<>|\s]+', "-")
    return notes.select(safe(topic).alias("topic"), safe(name).alias("name"), F.col(body).alias("value"))


def synthesis(notes: DataFrame, topic: str, name: str, title: str, lines_a_part: int = 256) -> DataFrame:
    """(topic, part_no, section): the index of a topic over many media, in parts of about `lines_a_part` lines however
    large the topic is: as many parts as its counted lines need, dealt by a hash of the name."""
    rows = notes.where(F.col(topic).isNotNull()).select(topic, name, title)
    sizes = rows.groupBy(topic).agg(F.ceil(F.count("*") / lines_a_part).cast("int").alias("_n"))
    dealt = rows.join(sizes, topic).withColumn("part_no", F.pmod(F.xxhash64(name), F.col("_n")).cast("int"))
    line = F.concat(F.lit("- [["), F.col(name), F.lit("]] "), F.coalesce(title, F.lit("untitled")))
    return dealt.groupBy(topic, "part_no").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("section"))


def anki_cards(df: DataFrame, front: Column, back: Column, tags: Column) -> DataFrame:
    """One column `value` of tab-separated front, back and tags; tabs and line breaks within become blanks and <br>."""
    flat = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\t", " "), "\r?\n", "<br>")
    return df.select(F.concat_ws("\t", flat(front), flat(back), flat(tags)).alias("value"))


def emit(df: DataFrame, out: str, formats: list[str], key: str, order: str, id_col: str, include_transcript: bool = False) -> None:
    """Write a transcript in several formats below `out`. Subtitles and text hold the whole transcript and need consent."""
    unknown = [f for f in formats if f not in FORMATS]
    if unknown:
        raise ValueError(f"unknown formats {unknown}, known: {FORMATS}")
    if not include_transcript and {"srt", "txt"} & set(formats):
        raise PermissionError("srt and txt hold the full transcript: include_transcript is needed")
    for f in formats:
        if f == "json":
            df.write.mode("overwrite").json(f"{out}/json")
        elif f == "srt":
            _by_key(srt_cues(df, key, order, id_col), key, "cue_no", "cue", f"{out}/srt")
        elif f == "txt":
            _by_key(plain_parts(df, key, order, id_col), key, "part_no", "text", f"{out}/txt")
        else:
            rows = df.groupBy(key).agg(F.count("*").alias("n"), F.max("end_ms").alias("e")).select(key, note(F.col(key).cast("string"), {"segments": F.col("n"), "duration_ms": F.col("e")}, []).alias("value"))
            _by_key(rows.withColumn("n", F.lit(0)), key, "n", "value", f"{out}/md")


def _by_key(df: DataFrame, key: str, order: str, value: str, out: str) -> None:
    """Text below one folder per key, in order within its files."""
    df.select(key, order, F.col(value).alias("value")).repartitionByRange(key, order).sortWithinPartitions(key, order).select(key, "value").write.mode("overwrite").partitionBy(key).text(out)


def append_history(rows: DataFrame, out: str) -> None:
    """Measurements appended as JSON lines."""
    rows.write.mode("append").json(out)


def write_staged(df: DataFrame, out: str, tries: int = 5, wait_s: float = 0.2) -> None:
    """Parquet written beside its place and moved there when whole, so a failure leaves the old table as it was.

    A target that is busy is tried again, `tries` times in all, each wait twice as long as the one before.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(out + ".new"), jvm.org.apache.hadoop.fs.Path(out + ".old")
    at = jvm.org.apache.hadoop.fs.Path(out)
    fs = at.getFileSystem(conf)
    df.write.mode("overwrite").parquet(out + ".new")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    for k in range(tries):
        if k:
            time.sleep(wait_s * 2 ** (k - 1))
        if fs.rename(new, at):
            break
    else:
        fs.rename(old, at)
        raise OSError(f"could not put {out} in place")
    fs.delete(old, True)
