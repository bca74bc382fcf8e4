"""Gates: what a retried or refined text must show to be taken, and what a benchmark must show to pass."""

from __future__ import annotations

import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank


def compression_ratio(text: Column) -> Column:
    """Bytes of the text over bytes of its zlib form; null for null and empty texts."""

    def run(ts: pd.Series) -> pd.Series:
        return ts.map(lambda t: len(b := t.encode("utf-8")) / len(zlib.compress(b)) if t else None).astype("float64")

    return F.pandas_udf(run, "double")(text)


def most_repeated(text: Column, n: int = 4) -> Column:
    """How often the most frequent stretch of n characters occurs; 0 for shorter texts, null for null.

    Within the row, so without a shuffle; a fold over the sorted stretches in built-in functions took four times as long.
    """

    def run(ts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else max(Counter(map(t.__getitem__, map(slice, range(len(t) - n + 1), range(n, len(t) + 1)))).values(), default=0) for t in ts], dtype="Int32")

    return F.pandas_udf(run, "int")(text)


def speech_rate(text: Column, ms: Column) -> Column:
    """Characters a second; null without a duration."""
    return F.when(ms > 0, F.length(text) * 1000 / ms)


def hallucination_gate(df: DataFrame, text: str = "text", compression: str = "compression_ratio", most_compression: float = 2.4, repeats: int = 3, slowest: float = 0.5, fastest: float = 8.0) -> DataFrame:
    """df with reject_reason: empty, compression, repetition, rate, or null where the text is accepted.

    An unknown compression ratio and a missing duration reject nothing.
    """
    rate = speech_rate(F.col(text), F.col("end_ms") - F.col("start_ms"))
    reason = (
        F.when(F.col(text).isNull() | is_blank(F.col(text)), "empty")
        .when(F.col(compression) > most_compression, "compression")
        .when(most_repeated(F.col(text)) >= repeats, "repetition")
        .when((rate < slowest) | (rate > fastest), "rate")
    )
    return df.withColumn("reject_reason", reason)


def char_overlap(a: Column, b: Column) -> Column:
    """Share of the characters of a that b has too, each as often as in both; null for an empty a."""
    from .fuse import shared_chars

    return shared_chars(a, b) / F.nullif(F.length(a), F.lit(0))


def refine_gate(pairs: DataFrame, least_cover: float = 0.6, least_overlap: float = 0.5, gain: float = 0.15, may_lose: float = 0.1, clearly: float = 0.2) -> DataFrame:
    """pairs with reject_reason of replacing old by new: empty, time_cover, char_overlap, no_gain, or null if accepted.

    Needs old_text, new_text, old_ms, new_ms, old_conf, new_conf, old_compression, new_compression. Gain: confidence up
    by `gain`, or compression down by `clearly` with confidence down by no more than `may_lose`.
    """
    better = F.coalesce(F.col("new_conf") - F.col("old_conf") >= gain, F.lit(False)) | (
        F.coalesce(F.col("old_compression") - F.col("new_compression") >= clearly, F.lit(False)) & F.coalesce(F.col("old_conf") - F.col("new_conf") <= may_lose, F.lit(False))
    )
    reason = (
        F.when(F.col("new_text").isNull() | is_blank(F.col("new_text")), "empty")
        .when(F.coalesce(F.col("new_ms") / F.nullif("old_ms", F.lit(0)), F.lit(1.0)) < least_cover, "time_cover")
        .when(F.coalesce(char_overlap(F.col("old_text"), F.col("new_text")), F.lit(1.0)) < least_overlap, "char_overlap")
        .when(~better, "no_gain")
    )
    return pairs.withColumn("reject_reason", reason)


def refine_candidates(df: DataFrame, key: str, least_ms: int = 1500, most: int = 6, least_logprob: float = -1.0, most_compression: float = 2.4) -> DataFrame:
    """The at most `most` spans of each key worth a second pass, worst confidence first, with rank; a budget by design."""
    from pyspark.sql import Window as W

    weak = F.coalesce(F.col("avg_logprob") < least_logprob, F.lit(False)) | F.coalesce(F.col("compression_ratio") > most_compression, F.lit(False))
    some = df.where(weak & (F.col("end_ms") - F.col("start_ms") >= least_ms)).where(f"{key} is not null")
    order = [F.coalesce("avg_logprob", F.lit(0.0)), "start_ms", "segment_id"]
    thin = some.withColumn("_slice", F.floor(F.col("start_ms") / 600_000)).withColumn("_r", F.row_number().over(W.partitionBy(key, "_slice").orderBy(*order))).where(F.col("_r") <= most)
    return thin.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most).drop("_slice", "_r")


def threshold_gate(scores: DataFrame, metric: str, most: float) -> DataFrame:
    """One row: n_cases, n_over, passed. A null metric counts as over, an unmeasured case must not pass."""
    over = F.coalesce(F.col(metric) > most, F.lit(True))
    return scores.agg(F.count("*").alias("n_cases"), F.count_if(over).alias("n_over"), (F.count_if(over) == 0).alias("passed"))


def baseline_gate(scores: DataFrame, baseline: DataFrame, keys: list[str], metric: str, tolerance: float = 0.005) -> DataFrame:
    """scores with baseline and verdict: regressed, improved, held, or unrecorded where the keys have none."""
    b = baseline.select(*keys, F.col(metric).alias("baseline"))
    delta = F.col(metric) - F.col("baseline")
    verdict = F.when(F.col("baseline").isNull(), "unrecorded").when(F.col(metric).isNull() | (delta > tolerance), "regressed").when(delta < 0, "improved").otherwise("held")
    return scores.join(b, keys, "left").withColumn("verdict", verdict)


def by_mode(scores: DataFrame, key: str, mode: str, metric: str) -> DataFrame:
    """(key, metric_by_mode): a map from each mode a case was measured in to its value there, the least of several.

    A case is compared with its own mode only; rows with a null key or mode tell nothing.
    """
    one = scores.where(F.col(key).isNotNull() & F.col(mode).isNotNull()).groupBy(key, mode).agg(F.min(metric).alias("_m"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(mode).alias("mode"), F.col("_m").alias("m"))))
    return one.groupBy(key).agg(F.map_from_entries(pairs).alias("metric_by_mode"))


def gate_by_mode(scores: DataFrame, baseline: DataFrame, key: str, mode: str, metric: str, tolerance: float = 0.005) -> DataFrame:
    """scores against a by_mode() map: verdict regressed, improved, held, or unrecorded for a mode that the map lacks."""
    b = baseline.select(key, "metric_by_mode")
    at = F.element_at("metric_by_mode", F.col(mode))
    delta = F.col(metric) - at
    verdict = F.when(at.isNull(), "unrecorded").when(F.col(metric).isNull() | (delta > tolerance), "regressed").when(delta < 0, "improved").otherwise("held")
    return scores.join(b, key, "left").withColumn("baseline", at).withColumn("verdict", verdict).drop("metric_by_mode")


def require_recorded(gated: DataFrame) -> DataFrame:
    """Fails the job where a case has no baseline under its norm."""
    failure = F.raise_error(F.lit("no baseline is recorded for a case and norm")).cast("boolean")
    return gated.where(F.when(F.col("verdict") == "unrecorded", failure).otherwise(F.lit(True)))


def difference_gate(spans: DataFrame, least_chars: int = 1) -> DataFrame:
    """One row: n_spans left at least_chars or longer on either side, and the status code, 25 or 0."""
    left = F.count_if(F.greatest(F.length("a_text"), F.length("b_text")) >= least_chars)
    return spans.agg(left.alias("n_spans"), F.when(left > 0, 25).otherwise(0).alias("status_code"))
