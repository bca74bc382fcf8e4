"""Nearest record in time for the same entity, by expanding rings of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage

MICRO = 1_000_000


def _micros(col: str):
    return F.round(F.col(col) * MICRO).cast("bigint")


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    key: str,
    left_time: str,
    right_time: str,
    tolerance_s: float = 1.0,
    first_ring_s: float = 0.25,
) -> DataFrame:
    """Each left row with the right row of the same key nearest in time, at most tolerance_s away.

    Result: (left_id, right_id, distance_s), one row per matched left id. Times are seconds, compared in whole
    microseconds. Rows whose id, key or time is null or not a number take no part; a negative tolerance matches nothing.
    Rows delivered again count once. Of rows equally near, the earlier time wins, then the smaller right id. Other
    columns, whatever their names, are ignored.

    A ring of width w puts the right rows into buckets of w and looks up each left row in its own bucket and the two
    beside it. They hold every right row up to w away, so a match at distance d <= w is provably the nearest. The rest
    goes on to a ring of doubled width, the last one being of the tolerance itself. The join key is (key, bucket), so an
    entity that owns most rows is spread over its timeline; the right rows are reduced to one per (key, time) before.
    Left rows that found nothing are written to the shared folder between rings, so no ring is computed twice.
    """
    tolerance = round(tolerance_s * MICRO)
    spark = left.sparkSession
    if tolerance < 0:
        return spark.createDataFrame([], f"{left_id} {_type(left, left_id)}, {right_id} {_type(right, right_id)}, distance_s double")
    usable = lambda t: F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double")) & (F.abs(F.col(t)) < 9e12)
    events = (
        right.where(F.col(key).isNotNull() & F.col(right_id).isNotNull() & usable(right_time))
        .select(F.col(key).alias("_k"), _micros(right_time).alias("_rt"), F.col(right_id).alias("_rid"))
        .groupBy("_k", "_rt")
        .agg(F.min("_rid").alias("_rid"))
    )
    open_rows = (
        left.where(F.col(key).isNotNull() & F.col(left_id).isNotNull() & usable(left_time))
        .select(F.col(left_id).alias("_lid"), F.col(key).alias("_k"), _micros(left_time).alias("_lt"))
        .dropDuplicates(["_lid"])
    )
    widths = _rings(tolerance, round(first_ring_s * MICRO))
    if len(widths) > 1:
        events = stage(events, "ring-right")
    found = None
    for i, width in enumerate(widths):
        seen = _ring(open_rows, events, width, min(width, tolerance))
        last = i == len(widths) - 1
        if not last:
            seen = stage(seen, f"ring-{i}")
        near = seen.where(F.col("_best").isNotNull())
        hit = near.select(
            F.col("_lid").alias(left_id), F.col("_best._rid").alias(right_id), (F.col("_best._d") / F.lit(float(MICRO))).alias("distance_s")
        )
        found = hit if found is None else found.unionByName(hit)
        open_rows = seen.where(F.col("_best").isNull()).select("_lid", "_k", "_lt")
    return found


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _rings(tolerance: int, first: int) -> list[int]:
    """Doubling widths from the first up to and including the tolerance."""
    widths, w = [], max(1, first)
    while w < tolerance:
        widths.append(w)
        w *= 2
    return [*widths, max(1, tolerance)]


def _ring(open_rows: DataFrame, events: DataFrame, width: int, reach: int) -> DataFrame:
    """open_rows with _best: the nearest event at most reach away, or null."""
    bucket = F.floor(F.col("_lt") / F.lit(width)).cast("bigint")
    probes = open_rows.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    shelves = events.withColumn("_b", F.floor(F.col("_rt") / F.lit(width)).cast("bigint"))
    distance = F.abs(F.col("_lt") - F.col("_rt"))
    return (
        probes.join(shelves, ["_k", "_b"], "left")
        .withColumn("_c", F.when(distance <= reach, F.struct(distance.alias("_d"), F.col("_rt"), F.col("_rid"))))
        .groupBy("_lid", "_k", "_lt")
        .agg(F.min("_c").alias("_best"))
    )
