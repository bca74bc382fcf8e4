"""Measurements over time: trends, latest values, regressions, and appending what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def trend(df: DataFrame, keys: list[str], time: str, id_col: str, metric: str) -> DataFrame:
    """Per key: runs, first, last and their times, delta. Rows with a null time or metric are no measurement."""
    at = F.struct(time, id_col)
    return (
        df.where(F.col(time).isNotNull() & F.col(metric).isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("runs"), F.min_by(metric, at).alias("first"), F.max_by(metric, at).alias("last"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
        .withColumn("delta", F.col("last") - F.col("first"))
    )


def latest(df: DataFrame, keys: list[str], time: str, id_col: str) -> DataFrame:
    """The newest row of each key; the larger id of equal times. Partial aggregation, no window."""
    cols = [c for c in df.columns if c not in keys]
    best = df.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(time, id_col)).alias("r"))
    return best.select(*keys, "r.*")


def regressions(df: DataFrame, keys: list[str], time: str, id_col: str, metric: str, worse: float = 0.005) -> DataFrame:
    """Keys whose last value is more than `worse` above the one before it; a single run is not reported.

    The two newest of a key by a ranked window, whose limit the planner applies to each partition before the shuffle,
    so a key of any size sends two rows from each.
    """
    rows = df.where(F.col(time).isNotNull() & F.col(metric).isNotNull())
    newest = W.partitionBy(*keys).orderBy(F.desc(time), F.desc(id_col))
    two = rows.select(*keys, F.col(metric).alias("_m"), F.row_number().over(newest).alias("_r")).where("_r <= 2")
    pair = two.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 2, F.col("_m"))).alias("previous"), F.max(F.when(F.col("_r") == 1, F.col("_m"))).alias("last"), F.count("*").alias("_n"))
    return pair.where("_n = 2").withColumn("delta", F.col("last") - F.col("previous")).where(F.col("delta") > worse).drop("_n")


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the table does not have yet; a version's leading v does not count."""
    norm = lambda df: df.withColumns({f"_{k}": F.regexp_replace(F.col(k).cast("string"), "^v", "") if k == "version" else F.col(k) for k in keys})
    return norm(rows).join(norm(existing).select(*(f"_{k}" for k in keys)).distinct(), [f"_{k}" for k in keys], "left_anti").drop(*(f"_{k}" for k in keys))


def append_release(rows: DataFrame, existing: DataFrame, version: str) -> DataFrame:
    """The rows of a release to append, skipped where recorded; the version must look like 1.29.0."""
    import re

    if not re.fullmatch(r"v?\d+\.\d+\.\d+", version):
        raise ValueError(f"not a version: {version!r}")
    return new_rows(rows.withColumn("version", F.lit(version)), existing, ["version", "case", "norm"])
