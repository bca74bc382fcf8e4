"""What a link or share text points to, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def canonical_id(source: Column) -> Column:
    """Video id of a link, share text or bare id: BV..., av..., a numeric id of the other platform, short-link code; null if none."""
    hit = lambda p, prefix="": F.when(F.regexp_extract(source, p, 1) != "", F.concat(F.lit(prefix), F.regexp_extract(source, p, 1)))
    return F.coalesce(
        hit(r"\b(BV[0-9A-Za-z]{10})\b"),
        hit(r"(?i)\bav(\d{1,15})\b", "av"),
        hit(r"douyin\.com/(?:video|note)/(\d{15,20})", "dy"),
        hit(r"(?:b23\.tv|v\.douyin\.com)/([0-9A-Za-z_-]+)", "short:"),
    )


def platform(source: Column) -> Column:
    """bilibili, douyin, local for a path, or null."""
    return (
        F.when(source.rlike(r"(?i)bilibili\.com|b23\.tv|\bBV[0-9A-Za-z]{10}\b|\bav\d+\b|^bl-"), "bilibili")
        .when(source.rlike(r"(?i)douyin\.com|iesdouyin|^dy-"), "douyin")
        .when(source.rlike(r"^(?:/|file:|[A-Za-z]:\\)|^lf-"), "local")
    )


def part(source: Column, n_parts: Column) -> Column:
    """The part a link asks for, 1 without p=. Fails where that part does not exist; it is never replaced by the first."""
    asked = F.regexp_extract(source, r"[?&]p=(\d+)", 1)
    p = F.when(asked == "", 1).otherwise(asked.cast("int"))
    return F.when((p >= 1) & (p <= n_parts), p).otherwise(F.raise_error(F.concat(F.lit("no such part: "), source)).cast("int"))


def inspect(df: DataFrame, source: str, flags: list[str]) -> DataFrame:
    """df with platform, canonical_id and refused: flags that the platform of a row does not offer."""
    only = [f for f in flags if f in ("subtitles", "comments", "ratios")]
    p = platform(F.col(source))
    return df.withColumn("platform", p).withColumn("canonical_id", canonical_id(F.col(source))).withColumn(
        "refused", F.when(p == "douyin", F.array(*map(F.lit, only)).cast("array<string>")).otherwise(F.array().cast("array<string>"))
    )


def local_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as sources: path, length, modified and identity; what is not known of them is not made up."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "length", F.col("modificationTime").alias("modified"))
    return rows.withColumn("identity", F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modified").cast("string")), 256))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Measurements from JSON lines, strict: a malformed line fails the job."""
    from ..model import MEASUREMENT

    return spark.read.schema(MEASUREMENT).option("mode", "FAILFAST").json(path)
