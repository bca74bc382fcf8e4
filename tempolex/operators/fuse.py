"""Two sources of one medium made one transcript, with the provenance of every piece."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import norm_for_score
from .align import opcodes
from .intervals import overlapping

#: Conflicts decided beforehand, wrong form -> right form.
PREFERENCES = {"在见": "再见", "以经": "已经", "做为": "作为", "赠养": "赡养"}


def fuse(primary: DataFrame, secondary: DataFrame, key: str, primary_id: str, secondary_id: str, least_shared: int = 2) -> DataFrame:
    """(key, start_ms, end_ms, text, provenance, alternative, needs_review, recovered_by, primary_id, n_secondary).

    Pieces of the primary are kept whole: `subtitle` if every secondary piece under it says the same, part of it or
    nothing, `mixed` with the secondary's text as alternative where they differ. Secondary pieces that no primary piece
    covers, or only one with fewer than least_shared of their characters, are appended as `asr`, recovered_by
    `coverage_audit` in the second case. Sameness is that of norm_for_score. mixed and asr need review. No text of either source is dropped
    (see conserved()). Rows with null key or times are left out of the fusion, as they have no place.
    """
    a = primary.where(f"{key} is not null and start_ms is not null and end_ms >= start_ms").select(key, F.col(primary_id).alias("_p"), "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text"))
    b = secondary.where(f"{key} is not null and start_ms is not null and end_ms >= start_ms").select(key, F.col(secondary_id).alias("_q"), "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text"))
    met = overlapping(a, b, key).withColumn("_shared", shared_chars(F.col("text"), F.col("r_text")))
    # A piece of the secondary goes to the primary it overlaps most, so it is an alternative once.
    owner = met.groupBy(key, F.col("r__q").alias("_q")).agg(
        F.max_by(F.struct("_p", F.col("_shared").alias("shared")), F.struct("overlap_ms", -F.col("start_ms"), "_p")).alias("o")
    ).select(key, "_q", "o._p", "o.shared")
    with_owner = b.join(owner, [key, "_q"], "left")
    lost = (F.col("_p").isNotNull()) & (F.col("shared") < least_shared) & (F.length("text") >= least_shared)
    heard = with_owner.where(F.col("_p").isNotNull() & ~lost)
    under = heard.groupBy(key, "_p").agg(
        F.array_sort(F.collect_list(F.struct("start_ms", "_q", "text"))).alias("_s"), F.count("*").alias("n_secondary")
    ).withColumn("_t", F.array_join(F.transform("_s", lambda x: x["text"]), "")).drop("_s")
    joined = a.join(under, [key, "_p"], "left")
    said, heard_as = norm_for_score(F.col("text")), norm_for_score(F.col("_t"))
    same = F.col("_t").isNull() | (heard_as == said) | (heard_as == "") | F.contains(said, heard_as)
    kept = joined.select(
        key, "start_ms", "end_ms", "text",
        F.when(same, "subtitle").otherwise("mixed").alias("provenance"),
        F.when(~same | (F.col("_t") != F.col("text")), F.col("_t")).alias("alternative"),
        (~same).alias("needs_review"),
        F.lit(None).cast("string").alias("recovered_by"),
        F.col("_p").cast("bigint").alias("piece_id"),
        F.coalesce("n_secondary", F.lit(0)).alias("n_secondary"),
    )
    added = with_owner.where(F.col("_p").isNull() | lost).select(
        key, "start_ms", "end_ms", "text",
        F.lit("asr").alias("provenance"), F.lit(None).cast("string").alias("alternative"), F.lit(True).alias("needs_review"),
        F.when(F.col("_p").isNotNull(), "coverage_audit").alias("recovered_by"), F.col("_q").cast("bigint").alias("piece_id"), F.lit(1).cast("bigint").alias("n_secondary"),
    )
    return kept.unionByName(added)


def shared_chars(a: Column, b: Column) -> Column:
    """Characters two texts have in common, each as often as in both; null where either is null.

    Counted in Python over Arrow batches: the built-in form needs a pass over the text for each distinct character and
    took ten times as long on texts of a thousand characters.
    """

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else sum((Counter(x) & Counter(y)).values()) for x, y in zip(xs, ys)], dtype="Int32")

    return F.pandas_udf(run, "int")(a, b)


def conserved(fused: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, char, missing): characters of a source that the fused texts and alternatives lack; empty if all is kept."""
    def chars(df: DataFrame, text: str) -> DataFrame:
        return df.where(F.col(text).isNotNull()).select(key, F.explode(F.split(text, "")).alias("char")).where("char <> ''").groupBy(key, "char").count()

    have = chars(fused, "text").unionByName(chars(fused, "alternative")).groupBy(key, "char").agg(F.sum("count").alias("have"))
    need = chars(source.where(f"{key} is not null and start_ms is not null and end_ms >= start_ms"), "text")
    return need.join(have, [key, "char"], "left").withColumn("missing", F.col("count") - F.coalesce("have", F.lit(0))).where("missing > 0").select(key, "char", "missing")


def require_conserved(fused: DataFrame, sources: list[DataFrame], key: str) -> DataFrame:
    """fused, whose job fails where it lacks a character of a source; see conserved()."""
    lost = None
    for df in sources:
        rows = conserved(fused, df, key)
        lost = rows if lost is None else lost.unionByName(rows)
    n = lost.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("n")).scalar()
    failure = F.raise_error(F.concat(F.lit("characters lost in fusion: "), n.cast("string"))).cast("boolean")
    return fused.where(F.when(n == 0, F.lit(True)).otherwise(failure))


def _ruling(text: str, other: str, table: list[tuple[str, str]]) -> tuple[bool, str] | None:
    """Whether the other side is right, and the entry that says so; None where none does."""
    pairs = None
    for wrong, right in table:
        if wrong == right:
            continue
        if len(wrong) == len(right):
            if pairs is None:
                pairs = {(text[i + k], other[j + k]) for tag, i, i2, j, j2 in opcodes(text, other) if tag == "replace" for k in range(min(i2 - i, j2 - j))}
            said = [(w, r) for w, r in zip(wrong, right) if w != r]
            if any((w, r) in pairs for w, r in said):
                return True, f"{wrong}→{right}"
            if any((r, w) in pairs for w, r in said):
                return False, f"{wrong}→{right}"
        elif wrong in text and right in other and right not in text:
            return True, f"{wrong}→{right}"
        elif right in text and wrong in other and right not in other:
            return False, f"{wrong}→{right}"
    return None


def preferred(text: Column, alternative: Column, table: dict[str, str] | None = None) -> Column:
    """struct(text, chosen_by): of two readings the one with the right form, and the entry wrong→right that decided.

    An entry of equal lengths is split into its characters that differ, and these are compared position by position
    where the alignment of the readings replaces one by the other, so an entry is found though both readings share
    most of it. Entries of unequal lengths are looked for as a whole. The first entry that decides wins; where none
    does, or a reading is null, the text stays and chosen_by is null.
    """
    rules = list((PREFERENCES if table is None else table).items())

    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(xs, ys):
            got = None if x is None or y is None or x == y else _ruling(x, y, rules)
            out.append((x, None) if got is None else (y if got[0] else x, got[1]))
        return pd.DataFrame(out, columns=["text", "chosen_by"], dtype=object)

    return F.pandas_udf(run, "struct<text:string,chosen_by:string>")(text, alternative)


def decided(fused: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """A fuse() with chosen_by: where an entry decides a conflict, the reading it prefers is the text, the other the alternative."""
    p = preferred(F.col("text"), F.col("alternative"), table)
    rows = fused.withColumn("_p", F.when(F.col("provenance") == "mixed", p))
    swapped = F.col("_p.chosen_by").isNotNull() & (F.col("_p.text") != F.col("text"))
    return rows.withColumn("_a", F.when(swapped, F.col("text")).otherwise(F.col("alternative"))).withColumn("text", F.when(swapped, F.col("_p.text")).otherwise(F.col("text"))).withColumn("alternative", F.col("_a")).withColumn("chosen_by", F.col("_p.chosen_by")).drop("_p", "_a")


def prefer_source(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows of the first source in the list that has any for a key, with `source`."""
    left, out = None, None
    for name, df in sources:
        rows = df.withColumn("source", F.lit(name))
        rows = rows if left is None else rows.join(left, key, "left_anti")
        mine = df.select(key).distinct()
        left = mine if left is None else left.unionByName(mine).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def lexicon(parts: list[tuple[int, DataFrame]], most: int = 200, noise: list[str] | None = None) -> DataFrame:
    """(term, priority, rank): terms of several lists, the best priority of each, without noise, the first `most`.

    The cut is the feature: a decoder takes so many terms and no more.
    """
    all_terms = None
    for priority, df in parts:
        rows = df.select(F.trim("term").alias("term"), F.lit(priority).alias("priority"))
        all_terms = rows if all_terms is None else all_terms.unionByName(rows)
    kept = all_terms.where("term is not null and length(term) >= 2")
    if noise:
        kept = kept.where(~F.lower("term").isin([n.lower() for n in noise]))
    best = kept.groupBy("term").agg(F.min("priority").alias("priority"))
    top = best.orderBy("priority", "term").limit(most)
    from pyspark.sql import Window as W

    return top.withColumn("rank", F.row_number().over(W.partitionBy().orderBy("priority", "term")))
