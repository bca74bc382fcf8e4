"""The canonical records and how rows of other shapes become them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .session import free_name

#: One timed piece of text; times in whole milliseconds of the medium's own axis.
SEGMENT = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
#: A word with its own times.
WORD = T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("word", T.StringType())])
#: A step of the pipeline that made a transcript.
DIAGNOSTIC = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("step", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("detail", T.MapType(T.StringType(), T.StringType()))])
#: One measurement of a benchmark case.
MEASUREMENT = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("case", T.StringType()), T.StructField("norm", T.StringType()), T.StructField("cer", T.DoubleType()), T.StructField("coverage", T.DoubleType())])

SHAPES = {("start", "end", "text"): "canonical", ("from", "to", "content"): "asr", ("from_s", "to_s", "content"): "asr", ("shown_s", "gone_s", "text"): "card"}


class TranscriptSchemaError(ValueError):
    """Rows of a shape that is not known; names the fields seen."""


def ms(col: str) -> Column:
    """Seconds as whole milliseconds."""
    return F.round(F.col(col) * 1000).cast("bigint")


def shape_of(df: DataFrame) -> tuple[str, str, str]:
    """The time and text columns of a known shape. A start without an end is an error, not a guess."""
    for fields in SHAPES:
        if set(fields) <= set(df.columns):
            return fields
    raise TranscriptSchemaError(f"unknown segment shape, fields seen: {sorted(df.columns)}")


def canonical_segments(df: DataFrame, *keep: str) -> DataFrame:
    """keep..., start_ms, end_ms, text and status from any known shape.

    status: ok, missing_time (either time null or not a number), reversed (end before start), missing_text. No row is
    dropped and no value made up. Of the columns only those named in `keep` pass.
    """
    start, end, text = shape_of(df)
    a, b = F.when(F.isnan(start), None).otherwise(ms(start)), F.when(F.isnan(end), None).otherwise(ms(end))
    rows = df.select(*keep, a.alias("start_ms"), b.alias("end_ms"), F.col(text).alias("text"))
    status = (
        F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "missing_time")
        .when(F.col("end_ms") < F.col("start_ms"), "reversed")
        .when(F.col("text").isNull(), "missing_text")
        .otherwise("ok")
    )
    return rows.withColumn("status", status)


def require_ok(rows: DataFrame) -> DataFrame:
    """Fails the job at the first row that is not ok; a filter, so that no pruning of columns removes the check."""
    failure = F.raise_error(F.concat(F.lit("segment rejected: "), F.col("status"))).cast("boolean")
    return rows.where(F.when(F.col("status") == "ok", F.lit(True)).otherwise(failure))


def delivered_once(df: DataFrame, key: str) -> DataFrame:
    """Rows without repeated deliveries: one per key. Null keys stay, each row its own, told apart by a random number,
    which spreads them too; so one read and one shuffle do."""
    own = free_name(df, "own")
    return df.withColumn(own, F.when(F.col(key).isNull(), F.rand(7))).dropDuplicates([key, own]).drop(own)


def settings_identity(df: DataFrame, columns: list[str]) -> Column:
    """Hash that is equal for rows of equal settings; null and the empty string differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)
