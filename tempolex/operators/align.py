"""Character alignment of two texts and the measures made of it."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import MARKS
from .longest import Index

#: One difference: kind as from a to b, places in both, both texts.
SPAN = "array<struct<tag:string,a_lo:int,a_hi:int,b_lo:int,b_hi:int,a_text:string,b_text:string>>"
_MEASURE = "struct<sub:int,omit:int,extra:int,hallucinated:int,ref_chars:int,equal_chars:int,ratio:double>"


#: Parts whose lengths multiply to no more are matched by difflib, larger ones by hashes; the result is the same.
_SMALL = 40_000
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def opcodes(a: str, b: str, small: int = _SMALL) -> list[tuple[str, int, int, int, int]]:
    """Opcodes from a to b: the longest common block, the earliest of equal ones, then the same on both sides of it.

    The same at any length, and those of difflib without junk, whose way of finding them is quadratic.
    """
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for x, y, n in [*matching_blocks(a, b, small), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out


def matching_blocks(a: str, b: str, small: int = _SMALL) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the common blocks of opcodes(), in order, adjacent ones joined."""
    found: list[tuple[int, int, int]] = []
    hashes = _Hashes(a, b) if len(a) * len(b) > small else None
    todo = [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        a_lo, a_hi, b_lo, b_hi, most = todo.pop()
        most = min(most, a_hi - a_lo, b_hi - b_lo)
        if most < 1:
            continue
        if hashes is None or (a_hi - a_lo) * (b_hi - b_lo) <= small:
            part = SequenceMatcher(None, a[a_lo:a_hi], b[b_lo:b_hi], autojunk=False).get_matching_blocks()
            found += [(a_lo + i, b_lo + j, n) for i, j, n in part if n]
            continue
        size = hashes.longest(a_lo, a_hi, b_lo, b_hi, most)
        if not size:
            continue
        # All blocks of this size from left to right: nothing before one is as long, what is behind it may be.
        i, j = a_lo, b_lo
        for x, y in hashes.of_size(size, a_lo, a_hi, b_lo, b_hi):
            found.append((x, y, size))
            todo.append((i, x, j, y, size - 1))
            i, j = x + size, y + size
        todo.append((i, a_hi, j, b_hi, size - 1))
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


class _Hashes:
    """Polynomial hashes of all stretches of two texts; a hit counts only if the texts agree."""

    def __init__(self, a: str, b: str) -> None:
        self.texts = a, b
        n = max(len(a), len(b)) + 1
        with np.errstate(over="ignore"):
            powers = lambda x: np.cumprod(np.where(np.arange(n) > 0, np.uint64(x), np.uint64(1)), dtype=np.uint64)
            up, self.down = powers(_BASE), powers(_BASE_INVERSE)
            codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in (a, b)]
            self.sums = [np.concatenate([[np.uint64(0)], np.cumsum((c + np.uint64(1)) * up[: len(c)], dtype=np.uint64)]) for c in codes]

    def stretches(self, which: int, lo: int, hi: int, size: int) -> np.ndarray:
        s = self.sums[which]
        with np.errstate(over="ignore"):
            return (s[lo + size : hi + 1] - s[lo : hi + 1 - size]) * self.down[lo : hi + 1 - size]

    def of_size(self, size: int, a_lo: int, a_hi: int, b_lo: int, b_hi: int) -> Iterator[tuple[int, int]]:
        """Blocks of `size` that follow each other, each the earliest in a, then in b, behind the one before."""
        a, b = self.texts
        ha, hb = self.stretches(0, a_lo, a_hi, size), self.stretches(1, b_lo, b_hi, size)
        order = np.argsort(hb, kind="stable")
        ranked = hb[order]
        first, last = np.searchsorted(ranked, ha, "left"), np.searchsorted(ranked, ha, "right")
        i, j = a_lo, b_lo
        for k in np.flatnonzero(last > first).tolist():
            x = a_lo + k
            if x < i:
                continue
            places = order[first[k] : last[k]]
            want = a[x : x + size]
            for y in places[np.searchsorted(places, j - b_lo) :].tolist():
                if b.startswith(want, b_lo + y):
                    yield x, b_lo + y
                    i, j = x + size, b_lo + y + size
                    break

    def longest(self, a_lo: int, a_hi: int, b_lo: int, b_hi: int, most: int) -> int:
        """Length of the longest common block, at most `most`: sizes doubled until none is met, then halved."""
        met = lambda size: next(self.of_size(size, a_lo, a_hi, b_lo, b_hi), None) is not None
        good, bad = 0, 1
        while bad <= most and met(bad):
            good, bad = bad, bad * 2
        bad = min(bad, most + 1)
        while bad - good > 1:
            middle = (good + bad) // 2
            if met(middle):
                good = middle
            else:
                bad = middle
        return good


def measures(hyp: str, ref: str) -> tuple[int, int, int, int, int, int, float]:
    """(sub, omit, extra, hallucinated, ref_chars, equal_chars, ratio) with the hypothesis as a, the reference as b.

    An insertion from a to b is an omission, a deletion is extra. A replacement of unequal lengths is as many
    substitutions as its shorter side has, the rest omitted or extra. Extra runs of two characters or more without a
    counterpart are hallucinated.
    """
    sub = omit = extra = ghosts = equal = 0
    for tag, i1, i2, j1, j2 in opcodes(hyp, ref):
        n, m = i2 - i1, j2 - j1
        if tag == "equal":
            equal += n
        elif tag == "insert":
            omit += m
        elif tag == "delete":
            extra += n
            ghosts += n if n >= 2 else 0
        else:
            sub += min(n, m)
            omit += max(0, m - n)
            extra += max(0, n - m)
    total = len(hyp) + len(ref)
    return sub, omit, extra, ghosts, len(ref), equal, 2 * equal / total if total else 1.0


def aligned(hyp: Column, ref: Column) -> Column:
    """The measures of two text columns; null where either is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 7 if x is None or y is None else measures(x, y) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=["sub", "omit", "extra", "hallucinated", "ref_chars", "equal_chars", "ratio"]).astype({c: "Int32" for c in ("sub", "omit", "extra", "hallucinated", "ref_chars", "equal_chars")})

    return F.pandas_udf(run, _MEASURE)(hyp, ref)


def diff_spans(a: Column, b: Column) -> Column:
    """The differences from a to b, none for equal texts, null where either is null."""

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            out.append(None if x is None or y is None else [dict(tag=t, a_lo=i, a_hi=k, b_lo=j, b_hi=m, a_text=x[i:k], b_text=y[j:m]) for t, i, k, j, m in opcodes(x, y) if t != "equal"])
        return pd.Series(out)

    return F.pandas_udf(run, SPAN)(a, b)


def cer(m: Column) -> Column:
    """Character error rate of a measure; null for an empty reference."""
    return (m["sub"] + m["omit"] + m["extra"]) / F.nullif(m["ref_chars"], F.lit(0))


def edit_rate(hyp: Column, ref: Column) -> Column:
    """Error rate by edit distance, the built-in twin of cer()."""
    return F.levenshtein(hyp, ref) / F.nullif(F.length(ref), F.lit(0))


def score(pairs: DataFrame, case: str, hyp: str, ref: str, minutes: Column | None = None) -> DataFrame:
    """Per case: chars, errors by kind, cer, similarity and hallucinated characters a minute, summed over its pairs."""
    m = pairs.select(case, aligned(F.col(hyp), F.col(ref)).alias("m"), (F.lit(None).cast("double") if minutes is None else minutes).alias("minutes"))
    s = m.where("m.ref_chars is not null").groupBy(case).agg(
        *(F.sum(f"m.{c}").alias(c) for c in ("sub", "omit", "extra", "hallucinated", "ref_chars", "equal_chars")), F.sum("minutes").alias("minutes"), F.count("*").alias("n_pairs")
    )
    return s.withColumn("cer", (F.col("sub") + F.col("omit") + F.col("extra")) / F.nullif("ref_chars", F.lit(0))).withColumn("hallucination_rate", F.col("hallucinated") / F.nullif("minutes", F.lit(0.0))).drop("minutes")


def common_block(a: Column, b: Column) -> Column:
    """Length of the longest stretch two texts share; null where either is null."""

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size for x, y in zip(xs, ys)], dtype="Int32")

    return F.pandas_udf(run, "int")(a, b)


#: Characters that are looked at together, of as many whole keys as they hold.
_TOGETHER = 1 << 20


def _whole_groups(batches: Iterator[pa.RecordBatch], on: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by `on` with the number of their group, about _TOGETHER characters of whole groups at a time."""
    held: list[pa.RecordBatch] = []
    numbers: list[np.ndarray] = []
    chars, group, last = 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in on:
            new[1:] |= pc.not_equal(b[c].slice(1), b[c].slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0], last = last != [b[c][0].as_py() for c in on], [b[c][-1].as_py() for c in on]
        number = group + np.cumsum(new)
        group = int(number[-1])
        chars += b.num_rows + (pc.sum(pc.utf8_length(b["text"])).as_py() or 0)
        if chars > _TOGETHER and new.any():
            cut = int(np.flatnonzero(new)[-1])
            if held or cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)]), np.concatenate([*numbers, number[:cut]])
            held, numbers, b, number = [], [], b.slice(cut), number[cut:]
            chars = b.num_rows + (pc.sum(pc.utf8_length(b["text"])).as_py() or 0)
        held.append(b)
        numbers.append(number)
    if held:
        yield pa.Table.from_batches(held), np.concatenate(numbers)


def _offsets(rows: pa.Table, group: np.ndarray, least: int, every: bool) -> pa.Table:
    """(k, id, g, n, d) of the segments, which have `own`, with the pieces of gold of their group; every: also those without one."""
    own = rows["own"].to_numpy()
    a, b = np.flatnonzero(own), np.flatnonzero(~own)
    both = np.intersect1d(group[a], group[b])
    mine, theirs = a[np.isin(group[a], both)], b[np.isin(group[b], both)]
    at = who = n = d = np.zeros(0, np.int64)
    if len(mine):
        preference = np.empty(len(theirs), np.int64)
        preference[pc.sort_indices(rows["g"].take(theirs), null_placement="at_start").to_numpy()] = np.arange(len(theirs))
        starts, number = rows["s"].to_numpy(), np.searchsorted(both, group)
        index = Index(number[theirs], rows["text"].take(theirs).to_pylist(), starts[theirs], preference)
        found = [*index.nearest(number[mine], rows["text"].take(mine).to_pylist(), starts[mine], least)]
        if found:
            at, who, n, d = (np.concatenate(c) for c in zip(*found))
            at, who = mine[at], theirs[who]
    rest = np.setdiff1d(a, at) if every else at[:0]
    pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(len(rest), kind)])
    at = np.concatenate([at, rest])
    return pa.table({"k": rows["k"].take(at), "id": rows["id"].take(at), "g": rows["g"].take(pad(who, pa.int64())), "n": pad(n, pa.int32()), "d": pad(d, pa.int64())})


def _nearest_gold(segments: DataFrame, gold: DataFrame, key: str, id_col: str, gold_id: str, least: int, block_rows: int, every: bool = False) -> DataFrame:
    """(k, id, g, n, d): the best piece of each block of gold of the key, for each segment that has one; see gold_offsets()."""

    def rows_of(df: DataFrame, name: str) -> DataFrame:
        return df.where(f"{key} is not null and start_ms is not null and text is not null").select(F.col(key).alias("k"), F.col(name).alias("id"), F.col("start_ms").cast("bigint").alias("s"), "text")

    def dealt(rows: DataFrame, name: str, most: int) -> DataFrame:
        # Only keys of more than one block are told, so that they are few.
        n = F.ceil(F.greatest(F.count("*") / most, F.sum(F.length("text")) / (32 * most)))
        return F.broadcast(rows.groupBy("k").agg(n.alias(name)).where(F.col(name) > 1))

    a, b = rows_of(segments, id_col), rows_of(gold, gold_id)
    mine, theirs = (df.schema["id"].dataType.simpleString() for df in (a, b))
    on = ["k", "x", "y"]
    own = a.select("k", "id", F.lit(None).cast(theirs).alias("g"), "s", "text", F.lit(True).alias("own"))
    both = own.unionAll(b.select("k", F.lit(None).cast(mine).alias("id"), F.col("id").alias("g"), "s", "text", F.lit(False).alias("own")))
    both = both.join(dealt(a, "_nx", 4 * block_rows), "k", "left").join(dealt(b, "_ny", block_rows), "k", "left")
    nx, ny = (F.coalesce(F.col(c), F.lit(1).cast("bigint")) for c in ("_nx", "_ny"))
    block = F.pmod(F.xxhash64("id", "g", "s", "text"), F.when(F.col("own"), nx).otherwise(ny))
    both = both.select("*", block.alias("_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("own"), ny).otherwise(nx) - 1)).alias("_o"))
    places = [F.when(F.col("own") == is_own, F.col("_b")).otherwise(F.col("_o")).alias(c) for c, is_own in (("x", True), ("y", False))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches, on):
            yield from _offsets(rows, group, least, every).to_batches()

    kind = f"k {a.schema['k'].dataType.simpleString()}, id {mine}, g {theirs}, n int, d bigint"
    return both.select("k", *places, "id", "g", "s", "text", "own").repartition(*on).sortWithinPartitions(*on).mapInArrow(run, kind)


def gold_offsets(segments: DataFrame, gold: DataFrame, key: str, id_col: str, gold_id: str, least: int = 2, block_rows: int = 100_000) -> DataFrame:
    """(id, gold_id, block, offset_ms): the gold piece of the key that shares the longest stretch with a segment, and how far its start is.

    All pieces of the key are looked at, however far; fewer than `least` common characters are no match. Ties go to the
    nearer start, then the smaller gold id. Rows without key, start or text take no part. The gold of a key is sorted by
    its suffixes and the segments are looked up in these. A key of more than block_rows pieces, or four times as many
    segments, or of 32 characters times these, is dealt into blocks, and each block of segments is looked up in each of gold.
    """
    best = _nearest_gold(segments, gold, key, id_col, gold_id, least, block_rows).groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "d", "g")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("m.g").alias(gold_id), (-F.col("m.n")).alias("block"), F.col("m.d").alias("offset_ms"))


def timeline_offset(segments: DataFrame, gold: DataFrame, key: str, id_col: str, gold_id: str, least: int = 2, block_rows: int = 100_000) -> DataFrame:
    """(key, matched, considered, median_ms, max_ms): the gold_offsets() of each key that has gold, summed up.

    Segments with an id, a start and a text are considered; ids must be unique. A key none of whose segments match has
    null offsets.
    """
    near = _nearest_gold(segments.where(f"{id_col} is not null"), gold, key, id_col, gold_id, least, block_rows, every=True)
    found = F.when(F.col("n").isNotNull(), F.struct((-F.col("n")).alias("n"), "d", "g"))
    best = near.groupBy("k", "id").agg(F.min(found).alias("m"))
    sums = best.groupBy(F.col("k").alias(key)).agg(F.count("m.d").alias("matched"), F.count("*").alias("considered"), F.median("m.d").alias("median_ms"), F.max("m.d").alias("max_ms"))
    return sums.join(gold.select(key).distinct(), key, "left_semi")


def match_cases(hypotheses: DataFrame, gold: DataFrame, case: str = "case") -> DataFrame:
    """Cases with both texts: (case, hyp, ref). A gold's folder and suffix do not count; a case without gold has a null ref."""
    bare = F.regexp_replace(F.regexp_replace(F.col(case), "^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    refs = gold.withColumn("_c", bare).groupBy("_c").agg(F.min("text").alias("ref"))
    return hypotheses.withColumn("_c", bare).join(refs, "_c", "left").select(case, F.col("text").alias("hyp"), "ref")


def _marks(text: str) -> list[tuple[int, str]]:
    """Each mark with the number of other characters before it."""
    out, at = [], 0
    for c in text:
        if c in MARKS:
            out.append((at, c))
        elif not c.isspace():
            at += 1
    return out


def paired_marks(hyp: str, ref: str, window: int = 3) -> tuple[int, int, int]:
    """(matched, marks of hyp, marks of ref): equal marks pair one to one, nearest first, at most `window` apart."""
    h, r = _marks(hyp), _marks(ref)
    options = []
    lo = 0
    for i, (p, c) in enumerate(h):
        while lo < len(r) and r[lo][0] < p - window:
            lo += 1
        k = lo
        while k < len(r) and r[k][0] <= p + window:
            if r[k][1] == c:
                options.append((abs(r[k][0] - p), i, k))
            k += 1
    used_h, used_r = set(), set()
    for _, i, k in sorted(options):
        if i not in used_h and k not in used_r:
            used_h.add(i)
            used_r.add(k)
    return len(used_h), len(h), len(r)


def punctuation(hyp: Column, ref: Column, window: int = 3) -> Column:
    """struct(matched, hyp_marks, ref_marks) of two text columns; null where either is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None or y is None else paired_marks(x, y, window) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=["matched", "hyp_marks", "ref_marks"]).astype("Int32")

    return F.pandas_udf(run, "struct<matched:int,hyp_marks:int,ref_marks:int>")(hyp, ref)


def f_score(p: Column) -> list[Column]:
    """precision, recall and f1 of a punctuation(); all null, not applicable, where the reference has no mark."""
    has = p["ref_marks"] > 0
    precision = F.when(has, p["matched"] / F.nullif(p["hyp_marks"], F.lit(0)))
    recall = F.when(has, p["matched"] / p["ref_marks"])
    return [precision.alias("precision"), recall.alias("recall"), F.when(has, 2 * p["matched"] / (p["hyp_marks"] + p["ref_marks"])).alias("f1")]


def udtf_char_diff():
    """A table function char_diff(a, b) with the spans as rows, for SQL: spark.udtf.register('char_diff', udtf_char_diff())."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="tag: string, a_lo: int, a_hi: int, b_lo: int, b_hi: int, a_text: string, b_text: string")
    class CharDiff:
        def eval(self, a: str, b: str) -> Iterator[tuple]:
            if a is None or b is None:
                return
            for t, i, k, j, m in opcodes(a, b):
                if t != "equal":
                    yield t, i, k, j, m, a[i:k], b[j:m]

    return CharDiff
