"""Running values over ordered rows of a key, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_OVER = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
_MERGE = {
    "max": lambda local, carry: F.greatest(local, carry),
    "min": lambda local, carry: F.least(local, carry),
    "sum": lambda local, carry: F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)),
    "count": lambda local, carry: F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)),
    "last": lambda local, carry: F.coalesce(local, carry),
}


def scan(df: DataFrame, keys: list[str], block: Column, order: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = False, reverse: bool = False, levels: int = 1, fan: int = 1024) -> DataFrame:
    """df with, for each name in `values`, an aggregate of the rows before this one of the same keys.

    values: name -> (max, min, sum, count or last, column); last skips nulls. `order` names columns that make the order
    total; `block` must never decrease along it. The first row has null, or 0 for sum and count. With `inclusive` the
    row itself counts, with `reverse` the rows behind it do instead of those before. Rows with null keys are left out.

    A key may hold any share of the rows: windows run within (key, block), one row per block carries the state on, and
    only those rows meet in a window by key. For a key of more than some million blocks, `levels` of 2 or more (with a
    number as block) carries the state over `fan` blocks at a time, and so on, so that no window is larger.
    """
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("_block", block)
    by = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    inner = W.partitionBy(*keys, "_block").orderBy(*by).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = rows.select("*", *(_OVER[fn](c).over(inner).alias(f"_l_{n}") for n, (fn, c) in values.items()))
    totals = []
    for n, (fn, c) in values.items():
        if fn == "last":
            at = F.when(c.isNotNull(), F.struct(*order))
            totals.append((F.min_by if reverse else F.max_by)(F.when(c.isNotNull(), c), at).alias(n))
        else:
            totals.append(_OVER[fn](c).alias(n))
    ends = rows.groupBy(*keys, "_block").agg(*totals)
    over = {n: ("sum" if fn == "count" else fn) for n, (fn, _) in values.items()}
    if levels > 1:
        at = ends.withColumnsRenamed({n: f"_v_{n}" for n in values} | {"_block": "_at"})
        up = {f"_c_{n}": (over[n], F.col(f"_v_{n}")) for n in values}
        seen = scan(at, keys, F.floor(F.col("_at") / fan).cast("bigint"), ["_at"], up, reverse=reverse, levels=levels - 1, fan=fan)
        carry = seen.select(*keys, F.col("_at").alias("_block"), *(f"_c_{n}" for n in values))
        joined = local.join(carry, [*keys, "_block"])
        return joined.select(*df.columns, *(_MERGE[fn](F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (fn, _) in values.items()))
    outer = W.partitionBy(*keys).orderBy(F.col("_block").desc() if reverse else F.col("_block")).rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*keys, "_block", *(_OVER[over[n]](F.col(n)).over(outer).alias(f"_c_{n}") for n in values))
    joined = local.join(carry, [*keys, "_block"])
    return joined.select(*df.columns, *(_MERGE[fn](F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (fn, _) in values.items()))


def by_number(col: str, size: int = 1024) -> Column:
    """Block of a row number."""
    return F.floor(F.col(col) / F.lit(size)).cast("bigint")


def by_time(col: str, ms: int = 600_000) -> Column:
    """Block of a time in milliseconds."""
    return F.floor(F.col(col) / F.lit(ms)).cast("bigint")
