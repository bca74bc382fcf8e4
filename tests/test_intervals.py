import random

import pytest
from pyspark.sql import functions as F

from tempolex.operators import intervals
from tempolex.operators.scan import by_number, by_time, scan

SPANS = "k string, id bigint, start_ms bigint, end_ms bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_gap_of_five_seconds(spark):
    df = spark.createDataFrame([("a", 1, 0, 196_240), ("a", 2, 201_840, 210_000), ("a", 3, 210_500, 211_000)], SPANS)
    assert rows(intervals.gaps(df, "k", "id")) == [("a", 196_240, 201_840, 5600)]


def test_overlap_counts_once_and_is_clipped(spark):
    df = spark.createDataFrame([("a", 1, 0, 10_000), ("a", 2, 5000, 12_000)], SPANS)
    d = spark.createDataFrame([("a", 11_000), ("b", 5000), ("c", None), ("d", 0)], "k string, duration_ms bigint")
    assert {r["k"]: (r["covered_ms"], r["coverage"]) for r in intervals.coverage(df, d, "k", "id").collect()} == {
        "a": (11_000, 1.0), "b": (0, 0.0), "c": (0, None), "d": (0, None),
    }


def test_union_against_brute_force_across_blocks(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), i, a := rng.randrange(0, 3_000_000), a + rng.randrange(0, 40_000)) for i in range(300)]
    df = spark.createDataFrame(spans, SPANS)
    for k, got in rows(intervals.covered(df, "k", "id")):
        sec = set()
        for kk, _, a, b in spans:
            if kk == k:
                sec |= set(range(a, b))
        assert got == len(sec)


def test_nulls_reversed_empty_and_repeats(spark):
    df = spark.createDataFrame([(None, 1, 0, 5), ("a", 2, None, 5), ("a", 3, 9, 2), ("a", 4, 0, 5), ("a", 4, 0, 5)], SPANS)
    assert rows(intervals.covered(df, "k", "id")) == [("a", 5)]
    assert rows(intervals.gaps(df.limit(0), "k", "id")) == []


def test_scan_equals_a_plain_window(spark):
    from pyspark.sql import Window as W

    rng = random.Random(5)
    df = spark.createDataFrame([("hot" if rng.random() < 0.9 else "x", i, rng.randrange(100), rng.choice([None, 1, 2, 3])) for i in range(500)], "k string, n bigint, v bigint, w bigint")
    spec = {"a": ("max", F.col("v")), "b": ("sum", F.col("v")), "c": ("last", F.col("w")), "d": ("count", F.lit(1)), "e": ("min", F.col("v"))}
    for reverse in (False, True):
        got = scan(df, ["k"], by_number("n", 7), ["n"], spec, reverse=reverse)
        w = W.partitionBy("k").orderBy(F.col("n").desc() if reverse else F.col("n")).rowsBetween(W.unboundedPreceding, -1)
        want = df.select("*", F.max("v").over(w), F.coalesce(F.sum("v").over(w), F.lit(0)), F.last("w", True).over(w), F.count("*").over(w), F.min("v").over(w))
        assert sorted(map(str, got.collect())) == sorted(str(r).replace(r.__fields__[4], r.__fields__[4]) for r in want.toDF(*got.columns).collect())


def test_by_time_never_decreases(spark):
    df = spark.createDataFrame([(-700_000,), (-1,), (0,), (599_999,), (600_000,)], "t bigint")
    assert [r[0] for r in df.select(by_time("t")).collect()] == [-2, -1, 0, 0, 1]


def test_touching_intervals_overlap_once(spark):
    a = spark.createDataFrame([("a", 1, 0, 30_000), ("a", 2, 50_000, 50_000)], SPANS)
    b = spark.createDataFrame([("a", 9, 30_000, 50_000), ("a", 8, 30_001, 40_000), (None, 7, 0, 9)], SPANS)
    got = rows(intervals.overlapping(a, b, "k").select("id", "r_id", "overlap_ms"))
    assert got == [(1, 9, 0), (2, 9, 0)]


def test_overlap_against_brute_force(spark):
    rng = random.Random(7)
    make = lambda n: [("k", i, a := rng.randrange(0, 200_000), a + rng.choice([0, 5, 900, 45_000])) for i in range(n)]
    a, b = make(60), make(60)
    got = rows(intervals.overlapping(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), "k").select("id", "r_id"))
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[2] <= y[3] and y[2] <= x[3])


def test_nearest_ties_go_to_the_earlier(spark):
    a = spark.createDataFrame([("a", 1, 1000)], "k string, i bigint, start_ms bigint")
    b = spark.createDataFrame([("a", 7, 900), ("a", 6, 1100), ("a", 5, 900)], "k string, j bigint, start_ms bigint")
    assert rows(intervals.nearest(a, b, "k", "i", "j", 100)) == [(1, 5, 100)]
    assert rows(intervals.nearest(a, b, "k", "i", "j", 99)) == []


@pytest.mark.parametrize(
    ("duration", "chunk", "want"),
    [
        (1_800_000, 600_000, [(0, 600_000), (598_000, 1_198_000), (1_196_000, 1_800_000)]),
        (2_783_300, 600_000, 5),
        (500, 0, [(0, 500)]),
        (500, -1, [(0, 500)]),
        (0, 600_000, []),
        (None, 600_000, []),
    ],
)
def test_chunk_plan(spark, duration, chunk, want):
    df = spark.createDataFrame([("m", duration)], "k string, duration_ms bigint")
    got = [r[2:] for r in rows(intervals.chunk_plan(df, "k", chunk))]
    assert (len(got) if isinstance(want, int) else got) == want


def test_chunk_merge_keeps_the_earlier(spark):
    df = spark.createDataFrame([("r", 0, 0, 10), ("r", 1, 8, 20), ("r", 2, 9, 15), ("r", 3, 30, 40)], "k string, no int, start_ms bigint, end_ms bigint")
    got = {r["no"]: (r["kept_from_ms"], r["overlap_ms"]) for r in intervals.merge_chunks(df, "k", "no").collect()}
    assert got == {0: (0, 0), 1: (10, 2), 2: (15, 6), 3: (30, 0)}


def test_words_shift(spark):
    df = spark.createDataFrame([([(0, 5, "a")],)], "w array<struct<start_ms:bigint,end_ms:bigint,word:string>>")
    assert df.select(intervals.shifted_words(F.col("w"), F.lit(100))).first()[0][0].asDict() == {"start_ms": 100, "end_ms": 105, "word": "a"}


def test_retry_budget_and_volume(spark):
    df = spark.createDataFrame([("a", i * 100_000, i * 100_000 + 10_000 * (i + 1), 10_000 * (i + 1), -30.0 if i % 2 else None) for i in range(8)], "k string, gap_start_ms bigint, gap_end_ms bigint, gap_ms bigint, volume double")
    got = rows(intervals.retry_windows(df, "k"))
    assert len(got) == 5 and max(b - a for _, a, b, _ in got) == 60_000
    assert len(rows(intervals.retry_windows(df, "k", loud=F.col("volume") > -35))) == 4


@pytest.mark.parametrize("reverse", [False, True])
def test_scan_over_several_levels_is_the_same(spark, reverse):
    import random

    rng = random.Random(8)
    rows = [("a" if rng.random() < 0.7 else "b", n, rng.choice([None, rng.randrange(100)])) for n in range(600)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    spec = {"most": ("max", F.col("v")), "least": ("min", F.col("v")), "total": ("sum", F.col("v")), "seen": ("count", F.col("v")), "prior": ("last", F.col("v"))}
    flat = sorted(map(str, scan(df, ["k"], by_number("n", 7), ["n"], spec, reverse=reverse).collect()))
    for levels in (2, 3):
        assert sorted(map(str, scan(df, ["k"], by_number("n", 7), ["n"], spec, reverse=reverse, levels=levels, fan=4).collect())) == flat


def test_slices(spark):
    from tempolex.operators.intervals import sliced

    df = spark.createDataFrame([(1, 0, 1000), (2, 900, 2500), (3, 2000, 3000), (4, None, 1500), (5, 1200, None)], "i int, start_ms bigint, end_ms bigint")
    assert [tuple(r) for r in sliced(df, 1000, 2000).collect()] == [(2, 0, 1000)]
