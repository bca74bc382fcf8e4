import random

import pytest
from pyspark.sql import functions as F

from tempolex.llm.mixing import mix, sainte_lague

T = "source_key string, target_share double, max_repeats int"


def test_apportionment():
    votes = {"a": 53.0, "b": 24.0, "c": 23.0}
    assert sainte_lague(votes, 7, dict.fromkeys(votes, 99)) == {"a": 3, "b": 2, "c": 2}
    assert sainte_lague(votes, 7, {"a": 1, "b": 99, "c": 99}) == {"a": 1, "b": 3, "c": 3}
    assert sainte_lague(votes, 7, dict.fromkeys(votes, 1)) == {"a": 1, "b": 1, "c": 1}
    assert sainte_lague({}, 5, {}) == {}
    rng = random.Random(1)
    w = {i: rng.random() for i in range(6)}
    got = sainte_lague(w, 10_000, dict.fromkeys(w, 10**9))
    assert sum(got.values()) == 10_000 and all(abs(got[i] / 10_000 - w[i] / sum(w.values())) < 1e-3 for i in w)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    names = ["Big"] * 6 + ["small_src", " Small-Src ", None, "other"]
    rows = [(i, "x" * rng.randrange(1, 60), rng.choice(names), 0, 0) for i in range(4000)] + [(9001, None, "Big", 0, 0), (9002, "", "big", 0, 0), (None, "y", "big", 0, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, norm int, shard int")


@pytest.mark.parametrize("shard_tokens", [2000, 1 << 24])
def test_shares_and_caps(spark, docs, shard_tokens):
    targets = spark.createDataFrame([("big", 0.5, 1), ("SMALL-SRC", 0.5, 5), ("none", 0.0, 3)], T)
    m = mix(docs, targets, shard_tokens=shard_tokens, shard_blocks=4)
    report = {r["source_key"]: r for r in m.report.collect()}
    assert not any(r["is_short"] for r in report.values())
    assert report["big"]["actual_share"] == pytest.approx(0.5, abs=0.01) and report["none"]["actual_share"] == 0.0
    total = sum(r["source_tokens"] for r in report.values())
    assert sum(r["mixed_tokens"] for r in report.values()) == pytest.approx(total, rel=0.01)
    worst = {r["source_key"]: r["m"] for r in m.picks.groupBy("source_key").agg(F.max("copies").alias("m")).collect()}
    assert worst["big"] <= 1 and worst["SMALL-SRC"] <= 5
    assert [tuple(r) for r in m.picks.orderBy("doc_id").collect()] == [tuple(r) for r in mix(docs, targets, shard_tokens=shard_tokens, shard_blocks=4).picks.orderBy("doc_id").collect()]


def test_short_sources_give_what_they_have(spark, docs):
    targets = spark.createDataFrame([("big", 0.2, 9), ("small_src", 0.8, 1), ("gone", 0.1, None), ("lost", None, 4)], T)
    report = {r["source_key"]: r for r in mix(docs, targets).report.collect()}
    assert report["small_src"]["is_short"] and report["small_src"]["mixed_tokens"] == report["small_src"]["source_tokens"]
    assert report["gone"]["is_short"] and not report["lost"]["is_short"] and not report["big"]["is_short"]


def test_edges(spark, docs):
    with pytest.raises(ValueError):
        mix(docs, spark.createDataFrame([("a_b", 0.5, 1), ("A-B", 0.5, 1)], T))
    empty = mix(docs.limit(0), spark.createDataFrame([("big", 1.0, 1)], T))
    assert empty.picks.count() == 0 and empty.report.first()["mixed_tokens"] == 0
    none = mix(docs, spark.createDataFrame([], T))
    assert none.picks.count() == 0 and none.report.count() == 0
