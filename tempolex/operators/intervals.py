"""Operators over intervals in time: gaps, coverage, overlaps, nearest pieces, chunk windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scan import by_time, scan


def gaps(df: DataFrame, key: str, id_col: str, least_ms: int = 2000) -> DataFrame:
    """(key, gap_start_ms, gap_end_ms, gap_ms): holes of at least least_ms between the intervals of a key.

    Needs start_ms and end_ms; rows with null key or times take no part. Before the first and behind the last interval
    there is no hole. Overlapping and nested intervals count as their union.
    """
    rows = df.where("start_ms is not null and end_ms is not null and end_ms >= start_ms").select(key, id_col, "start_ms", "end_ms")
    seen = scan(rows, [key], by_time("start_ms"), ["start_ms", id_col], {"until": ("max", F.col("end_ms"))})
    gap = F.col("start_ms") - F.col("until")
    return seen.where(gap >= least_ms).select(key, F.col("until").alias("gap_start_ms"), F.col("start_ms").alias("gap_end_ms"), gap.alias("gap_ms"))


def retry_windows(holes: DataFrame, key: str, most: int = 5, longest_ms: int = 60_000, loud: Column | None = None) -> DataFrame:
    """The `most` longest holes of each key, cut to longest_ms, with rank; `loud`, if given, must be true of them.

    Ties go to the earlier hole. The limit per key is the feature: a budget of retries.
    """
    some = holes if loud is None else holes.where(F.coalesce(loud, F.lit(False)))
    # Best of each slice of the timeline first, so that no key's holes meet in one task.
    order = [F.col("gap_ms").desc(), F.col("gap_start_ms")]
    first = W.partitionBy(key, "_slice").orderBy(*order)
    thin = some.withColumn("_slice", by_time("gap_start_ms", 3_600_000)).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    ranked = thin.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select(key, "gap_start_ms", F.least("gap_end_ms", F.col("gap_start_ms") + longest_ms).alias("gap_end_ms"), "rank")


def covered(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, covered_ms): length of the union of a key's intervals. Rows with null key or times take no part."""
    rows = df.where("start_ms is not null and end_ms is not null and end_ms >= start_ms").select(key, id_col, "start_ms", "end_ms")
    seen = scan(rows, [key], by_time("start_ms"), ["start_ms", id_col], {"until": ("max", F.col("end_ms"))})
    fresh = F.greatest(F.lit(0), F.col("end_ms") - F.greatest(F.col("start_ms"), F.coalesce("until", "start_ms")))
    return seen.groupBy(key).agg(F.sum(fresh).alias("covered_ms"))


def coverage(df: DataFrame, durations: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, covered_ms, duration_ms, coverage) for each row of durations (key, duration_ms).

    Intervals are clipped to 0..duration. A key without intervals covers 0; a null or zero duration has null coverage
    and its intervals unclipped.
    """
    known = durations.select(key, "duration_ms")
    clipped = df.join(known, key).select(
        key, id_col, F.greatest("start_ms", F.lit(0)).alias("start_ms"), F.when(F.col("duration_ms") > 0, F.least("end_ms", "duration_ms")).otherwise(F.col("end_ms")).alias("end_ms"), F.col("start_ms").alias("_s")
    )
    sums = covered(clipped.where("_s is not null"), key, id_col)
    return known.join(sums, key, "left").select(
        key, F.coalesce("covered_ms", F.lit(0)).alias("covered_ms"), "duration_ms", (F.coalesce("covered_ms", F.lit(0)) / F.when(F.col("duration_ms") > 0, F.col("duration_ms"))).alias("coverage")
    )


def sliced(df: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Rows that overlap from_ms..to_ms, their times clipped to it and counted from its start; touching ends do not
    overlap, rows with null times are left out."""
    rows = df.where((F.col("start_ms") < to_ms) & (F.col("end_ms") > from_ms))
    return rows.withColumn("start_ms", F.greatest("start_ms", F.lit(from_ms)) - from_ms).withColumn("end_ms", F.least("end_ms", F.lit(to_ms)) - from_ms)


def window_means(windows: DataFrame, samples: DataFrame, key: str, window_id: str, value: str) -> DataFrame:
    """(window_id, n, mean) of the samples' values over each window they overlap; windows without any have a null mean.

    Values are added in millionths, so the mean does not depend on the order of the rows. Null values do not count.
    """
    met = overlapping(windows.select(key, window_id, "start_ms", "end_ms"), samples.where(F.col(value).isNotNull()).select(key, value, "start_ms", "end_ms"), key)
    sums = met.groupBy(window_id).agg(F.count("*").alias("n"), F.sum(F.round(F.col(f"r_{value}") * 1_000_000).cast("bigint")).alias("s"))
    return windows.select(window_id).join(sums, window_id, "left").select(window_id, F.coalesce("n", F.lit(0)).alias("n"), (F.col("s") / F.col("n") / 1_000_000).alias("mean"))


def _buckets(a: Column, b: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(a / width).cast("bigint"), F.floor(b / width).cast("bigint")))


def overlapping(left: DataFrame, right: DataFrame, key: str, width_ms: int = 10_000) -> DataFrame:
    """Pairs of intervals of one key that overlap; touching ends count. Adds overlap_ms; right columns get the prefix r_.

    Both sides need key, start_ms, end_ms; rows with nulls there, or reversed, take no part. Intervals are spread over
    buckets of width_ms, and a pair is given by the bucket in which the later of the two starts, so once.
    """
    ok = f"{key} is not null and start_ms is not null and end_ms >= start_ms"
    lhs = left.where(ok).withColumn("_b", _buckets(F.col("start_ms"), F.col("end_ms"), width_ms))
    named = right.where(ok).select(F.col(key), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key))
    rhs = named.withColumn("_b", _buckets(F.col("r_start_ms"), F.col("r_end_ms"), width_ms))
    begin = F.greatest("start_ms", "r_start_ms")
    pairs = lhs.join(rhs, [key, "_b"]).where((F.col("start_ms") <= F.col("r_end_ms")) & (F.col("r_start_ms") <= F.col("end_ms")))
    once = pairs.where(F.floor(begin / width_ms) == F.col("_b"))
    return once.withColumn("overlap_ms", F.least("end_ms", "r_end_ms") - begin).drop("_b")


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, within_ms: int) -> DataFrame:
    """(left_id, right_id, delta_ms): the piece of the same key that starts nearest to each left piece, if near enough.

    Ties go to the earlier start, then the smaller id. One equi-join over buckets of the tolerance, the neighbours
    looked up by the left side; the right side is reduced to one row per start before.
    """
    lhs = left.where(f"{key} is not null and start_ms is not null and {left_id} is not null").select(key, left_id, F.col("start_ms").alias("_t"))
    b = F.floor(F.col("_t") / within_ms).cast("bigint")
    lhs = lhs.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    rhs = right.where(f"{key} is not null and start_ms is not null").groupBy(key, F.col("start_ms").alias("_u")).agg(F.min(right_id).alias(right_id))
    rhs = rhs.withColumn("_b", F.floor(F.col("_u") / within_ms).cast("bigint"))
    d = F.abs(F.col("_t") - F.col("_u"))
    best = lhs.join(rhs, [key, "_b"]).where(d <= within_ms).groupBy(left_id).agg(F.min(F.struct(d.alias("d"), "_u", right_id)).alias("m"))
    return best.select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.d").alias("delta_ms"))


def chunk_plan(df: DataFrame, key: str, chunk_ms: int = 600_000, overlap_ms: int = 2000) -> DataFrame:
    """(key, chunk_no, start_ms, end_ms): windows over duration_ms, each starting overlap_ms before the last one ends.

    A chunk length of 0 or less gives one window. A tail shorter than a quarter of a chunk joins the window before.
    Keys with a null, zero or negative duration have none.
    """
    rows = df.where("duration_ms > 0").select(key, "duration_ms")
    if chunk_ms <= 0:
        return rows.select(key, F.lit(0).alias("chunk_no"), F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    if not 0 <= overlap_ms < chunk_ms:
        raise ValueError("the overlap must be shorter than a chunk")
    step = chunk_ms - overlap_ms
    # Windows by start; one that is a sliver only lends its end to the one before.
    starts = rows.withColumn("_n", F.greatest(F.lit(1), F.ceil((F.col("duration_ms") - overlap_ms) / step)).cast("int"))
    tail = F.col("duration_ms") - (F.col("_n") - 1) * step
    kept = starts.withColumn("_n", F.when((F.col("_n") > 1) & (tail * 4 < chunk_ms), F.col("_n") - 1).otherwise(F.col("_n")))
    each = kept.select(key, "duration_ms", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk_no"))
    start = (F.col("chunk_no") * step).cast("bigint")
    return each.select(key, "chunk_no", start.alias("start_ms"), F.when(F.col("chunk_no") == F.col("_n") - 1, F.col("duration_ms")).otherwise(start + chunk_ms).alias("end_ms"))


def merge_chunks(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with kept_from_ms, the start of what a chunk adds to the earlier ones, overlap_ms with them, and is_repeat.

    The shared stretch is kept from the earlier chunk. A chunk wholly within earlier ones adds nothing: kept_from_ms is
    its end, and it is marked as a repeat, not dropped. Rows with null key or times are left out.
    """
    rows = df.where("start_ms is not null and end_ms is not null")
    seen = scan(rows, [key], F.floor(F.col(order) / 1024).cast("bigint"), [order, "start_ms"], {"_until": ("max", F.col("end_ms"))})
    until = F.coalesce("_until", "start_ms")
    return seen.select(
        *rows.columns,
        F.least(F.greatest("start_ms", until), F.greatest("end_ms", "start_ms")).alias("kept_from_ms"),
        F.greatest(F.lit(0), F.least(until, "end_ms") - F.col("start_ms")).alias("overlap_ms"),
        (F.col("_until").isNotNull() & (F.col("_until") >= F.col("end_ms"))).alias("is_repeat"),
    )


def shifted_words(words: Column, by_ms: Column) -> Column:
    """An array of words (start_ms, end_ms, word) moved along the time axis."""
    return F.transform(words, lambda w: F.struct((w["start_ms"] + by_ms).alias("start_ms"), (w["end_ms"] + by_ms).alias("end_ms"), w["word"].alias("word")))
