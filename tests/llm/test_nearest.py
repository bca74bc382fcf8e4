import random

import pytest
from pyspark.sql import functions as F

from tempolex.llm.nearest import nearest_in_time

L, R = "c bigint, m string, t double", "s bigint, m string, u double"


def run(spark, left, right, **k):
    df = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "c", "s", "m", "t", "u", **k)
    return {r["c"]: (r["s"], r["distance_s"]) for r in df.collect()}


def brute(left, right, tol=1.0):
    out = {}
    for c, m, t in left:
        near = [(round(abs(t - u) * 1e6), round(u * 1e6), s) for s, k, u in right if m is not None and k == m and t is not None and u is not None]
        near = [x for x in near if x[0] <= round(tol * 1e6)]
        if near:
            out[c] = (min(near)[2], min(near)[0] / 1e6)
    return out


@pytest.mark.parametrize("ring", [0.01, 0.25, 1.0, 5.0])
def test_against_brute_force_with_a_hot_key(spark, ring):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["b", "c", None])
    left = [(i, key(), rng.choice([None, round(rng.uniform(-5, 60), 3)])) for i in range(120)]
    right = [(i, key(), rng.choice([None, round(rng.uniform(-5, 60), 2)])) for i in range(120)]
    assert run(spark, left, right, first_ring_s=ring) == brute(left, right)


def test_ties_edge_and_repeats(spark):
    left = [(1, "a", 10.0), (1, "a", 10.0), (2, "a", 20.0), (3, "a", 30.0), (4, "a", float("nan"))]
    right = [(7, "a", 9.5), (5, "a", 10.5), (6, "a", 9.5), (8, "a", 21.0), (9, "a", 28.999)]
    assert run(spark, left, right) == {1: (6, 0.5), 2: (8, 1.0)}
    assert run(spark, left, right, tolerance_s=0.0) == {}
    assert run(spark, left, right, tolerance_s=-1.0) == {}


def test_empty_and_clashing_columns(spark):
    assert run(spark, [], [(1, "a", 1.0)]) == {} and run(spark, [(1, "a", 1.0)], []) == {}
    left = spark.createDataFrame([(1, "a", 1.0, 5, 6)], "c bigint, m string, t double, _b int, _rt int")
    right = spark.createDataFrame([(2, "a", 1.2, 5, 6)], "s bigint, m string, u double, _lid int, t int")
    got = nearest_in_time(left, right, "c", "s", "m", "t", "u")
    assert got.columns == ["c", "s", "distance_s"] and [tuple(r)[:2] for r in got.collect()] == [(1, 2)]


def test_no_cross_join(spark):
    left, right = spark.createDataFrame([(1, "a", 1.0)], L), spark.createDataFrame([(1, "a", 1.0)], R)
    plan = nearest_in_time(left, right, "c", "s", "m", "t", "u")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert F is not None
