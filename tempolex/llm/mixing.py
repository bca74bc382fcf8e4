"""Mixing sources to target shares by Sainte-Laguë apportionment."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import stage
from .packing import byte_tokens


def source_key(col: str):
    """A source name without case, outer blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(col), r"(?U)^\s+|\s+$", "")), "[-_]", "")


def sainte_lague(weights: dict, seats: int, caps: dict) -> dict:
    """Seats by highest quotient weight / (2 * seats so far + 1), none above its cap; ties go to the smaller key.

    Seats that no one can take any more stay empty, so the result may sum to less than `seats`.
    """
    won = dict.fromkeys(weights, 0)
    heap = [(-w, str(k), k) for k, w in weights.items() if w > 0 and caps[k] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, name, k = heapq.heappop(heap)
        won[k] += 1
        seats -= 1
        if won[k] < caps[k]:
            heapq.heappush(heap, (-weights[k] / (2 * won[k] + 1), name, k))
    return won


@dataclass
class Mixture:
    """picks: doc_id, source_key, n_tokens, copies (documents that are used); report: a row for each target."""

    picks: DataFrame
    report: DataFrame


def mix(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, least_blocks: int = 10_000, most_blocks: int = 1_000_000, block_tokens: int = 1 << 20, shard_blocks: int = 64, shard_tokens: int = 16 << 20, most_targets: int = 10_000
) -> Mixture:
    """A mixture as large as all documents of the listed sources together, each source at its target share.

    Tokens are UTF-8 bytes. Targets: source_key, target_share, max_repeats. Names are compared without case, outer
    blanks, hyphens and underscores; documents with null or unlisted source, null id, or null or empty text are left
    out. A target row with null key, share or repeats, or a negative one, counts as a share or repeats of 0. Targets
    that are equal after this normalisation are ambiguous and raise ValueError, as do more than `most_targets`.

    The mixture is cut into equal blocks (block_tokens, but between least_blocks and most_blocks of them), apportioned
    to the sources by highest quotients. A source that runs out at max_repeats times its tokens keeps what it has, and
    the next quotients fill the room; so the total is reached where it can be. The blocks of a source are apportioned
    in the same way to its shards (by a seeded hash of doc_id), and each shard turns its quota into whole rounds of its
    documents plus those of its first blocks in seeded order. Only counts per source and shard reach the driver, both
    bounded by the parameters; a dominating source has as many more shards. The sizes and the picks are written to the
    shared folder once, so the texts are read once and the report counts the very picks that are given.

    report: source_key, target_share, max_repeats, source_tokens, is_short (tokens * max_repeats < share * all tokens),
    target_tokens (share * all tokens), quota_tokens, mixed_tokens and actual_share of what was really picked.
    """
    spark = docs.sparkSession
    goals = {}
    rows = targets.select("source_key", "target_share", "max_repeats", source_key("source_key").alias("norm")).limit(most_targets + 1).collect()
    if len(rows) > most_targets:
        raise ValueError(f"more than {most_targets} targets")
    for r in rows:
        if r["norm"] in goals and r["norm"] is not None:
            raise ValueError(f"ambiguous target {r['source_key']!r}")
        if r["norm"] is not None:
            goals[r["norm"]] = (r["source_key"], max(0.0, r["target_share"] or 0.0), max(0, r["max_repeats"] or 0))
    listed = spark.createDataFrame([(k, v[0]) for k, v in goals.items()], "norm string, source_key string")
    sized = stage(
        docs.where(F.col(text_col).isNotNull() & (F.col(text_col) != "") & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("norm"), byte_tokens(text_col).cast("bigint").alias("n_tokens"))
        .join(F.broadcast(listed.select("norm")), "norm"),
        "sizes",
    )
    sums = {r["norm"]: r["t"] for r in sized.groupBy("norm").agg(F.sum("n_tokens").alias("t")).collect()}
    total = sum(sums.values())
    n_blocks = max(1, min(most_blocks, max(least_blocks, total // block_tokens)))
    block = max(1, total // n_blocks)
    room = {k: sums.get(k, 0) * goals[k][2] for k in goals}
    won = sainte_lague({k: goals[k][1] for k in goals}, total // block if total else 0, {k: -(-room[k] // block) for k in goals})
    quota = {k: min(room[k], won[k] * block) for k in goals}

    shards = {k: max(1, sums.get(k, 0) // max(shard_tokens, shard_blocks * block)) for k in goals}
    per_source = spark.createDataFrame([(k, int(shards[k])) for k in goals], "norm string, shards bigint")
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    dealt = sized.join(F.broadcast(per_source), "norm").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "shards"))
    held: dict[str, dict[int, int]] = {}
    for r in dealt.groupBy("norm", "shard").agg(F.sum("n_tokens").alias("t")).collect():
        held.setdefault(r["norm"], {})[r["shard"]] = r["t"]
    plan = []
    for k, by in held.items():
        units = -(-quota[k] // block)
        caps = {j: -(-t * goals[k][2] // block) for j, t in by.items()}
        seats = sainte_lague({j: float(t) for j, t in by.items()}, units, caps)
        for j, t in by.items():
            tokens = min(seats[j] * block, t * goals[k][2])
            plan.append((k, j, tokens // t, tokens % t))
    quotas = spark.createDataFrame(plan, "norm string, shard bigint, rounds bigint, rest bigint")
    within = W.partitionBy("norm", "shard").orderBy(order, "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    picks = stage(
        dealt.join(_small(quotas, len(plan)), ["norm", "shard"])
        .withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .withColumn("copies", (F.col("rounds") + (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest")).cast("bigint")).cast("int"))
        .where("copies > 0")
        .join(F.broadcast(listed), "norm")
        .select("doc_id", "source_key", "n_tokens", "copies"),
        "picks",
    )
    mixed = picks.groupBy("source_key").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    plan_rows = [
        (v[0], float(v[1]), int(v[2]), int(sums.get(k, 0)), bool(room[k] < v[1] * total), float(v[1] * total), int(quota[k])) for k, v in goals.items()
    ]
    sheet = spark.createDataFrame(
        plan_rows, "source_key string, target_share double, max_repeats int, source_tokens bigint, is_short boolean, target_tokens double, quota_tokens bigint"
    )
    report = (
        sheet.join(mixed, "source_key", "left")
        .withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
        .withColumn("actual_share", F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(W.partitionBy()), F.lit(0)))
    )
    return Mixture(picks, report)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the counted rows (25 bytes each) stay below some MB; else the planner decides."""
    return F.broadcast(df) if rows <= 100_000 else df
