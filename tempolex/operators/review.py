"""What a human should look at first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .scan import scan

#: Single characters whose exchange changes nothing much.
FUNCTION_WORDS = "的了是在和也就都着过呢吗吧啊"


def substantive(a: str = "a_text", b: str = "b_text"):
    """A difference of more than one character, or of one that is no function word."""
    n = F.greatest(F.length(a), F.length(b))
    small = (F.coalesce(F.col(a), F.lit("")).rlike(f"^[{FUNCTION_WORDS}]?$")) & (F.coalesce(F.col(b), F.lit("")).rlike(f"^[{FUNCTION_WORDS}]?$"))
    return (n > 1) | ((n == 1) & ~small)


def shortlist(spans: DataFrame, key: str, order: list[str], most: int = 30) -> DataFrame:
    """The `most` largest substantive differences of each key with rank; a top-k report, the spans themselves stay."""
    size = F.greatest(F.length("a_text"), F.length("b_text"))
    some = spans.where(substantive()).withColumn("size", size)
    by = [F.col("size").desc(), *order]
    thin = some.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(64))).withColumn("_r", F.row_number().over(W.partitionBy(key, "_s").orderBy(*by))).where(F.col("_r") <= most)
    return thin.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*by))).where(F.col("rank") <= most).drop("_s", "_r")


def worksheet(df: DataFrame, key: str, id_col: str, reasons: list[tuple[str, object]], share: float = 0.3, least: int = 8) -> DataFrame:
    """(key, id, reason, rank, flagged_total): rows to check by hand, the first reason that holds being theirs.

    At most greatest(least, floor(share * rows)) of a key, by order of the reasons, then id. `flagged_total` counts all
    flagged, listed or not. `reasons`: (name, condition) from the gravest on.
    """
    when = None
    for n, (_, cond) in enumerate(reasons):
        when = F.when(cond, n) if when is None else when.when(cond, n)
    names = F.array(*(F.lit(r) for r, _ in reasons))
    rows = df.where(f"{key} is not null").withColumn("_w", when)
    counts = rows.groupBy(key).agg(F.greatest(F.lit(least), F.floor(F.count("*") * F.lit(share))).alias("_most"), F.count("_w").alias("flagged_total"))
    flagged = rows.where("_w is not null").select(key, id_col, "_w")
    # The rank by a blocked scan: the share of a key that is listed may be large, so no window holds it.
    ranked = scan(flagged, [key], F.struct("_w", F.floor(F.col(id_col) / 1024).alias("b")), ["_w", id_col], {"rank": ("count", F.lit(1))}, inclusive=True)
    listed = ranked.join(counts, key).where(F.col("rank") <= F.col("_most"))
    return listed.select(key, id_col, F.element_at(names, F.col("_w") + 1).alias("reason"), F.col("rank").cast("int").alias("rank"), "flagged_total")


def lowest_decile(df: DataFrame, key: str, id_col: str, score: str) -> DataFrame:
    """Rows whose score is at or below the tenth percentile (lower of the two around it) of their key: (key, id, score)."""
    rows = df.where(f"{key} is not null and {score} is not null").select(key, id_col, score)
    # Counts per distinct score, so a key's rows are added up before they meet.
    per = rows.groupBy(key, score).agg(F.count("*").alias("n"))
    run = F.sum("n").over(W.partitionBy(key).orderBy(score))
    total = per.groupBy(key).agg(F.sum("n").alias("total"))
    limit = per.withColumn("run", run).join(total, key).where(F.col("run") * 10 >= F.col("total")).groupBy(key).agg(F.min(score).alias("limit"))
    return rows.join(limit, key).where(F.col(score) <= F.col("limit")).select(key, id_col, score)


def decisions(df: DataFrame, item: str, vote: str) -> DataFrame:
    """(item, n_votes, decision): keep where all votes are 0, correct where all are 1, unresolved where they differ."""
    a = df.groupBy(item).agg(F.count(vote).alias("n_votes"), F.min(vote).alias("lo"), F.max(vote).alias("hi"))
    return a.select(item, "n_votes", F.when(F.col("lo") != F.col("hi"), "unresolved").when(F.col("hi") == 1, "correct").when(F.col("hi") == 0, "keep").alias("decision"))
