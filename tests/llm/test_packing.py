import random

import pytest

from tempolex.llm.packing import best_fit, bin_completion, container_report, pack_documents


def valid(sizes, bins, cap):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= cap for b in bins)


def optimum(sizes, cap):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_is_optimal_on_small_sets(seed):
    rng = random.Random(seed)
    cap = 100
    sizes = sorted((rng.randrange(15, 71) for _ in range(9)), reverse=True)
    bins = bin_completion(sizes, cap)
    valid(sizes, bins, cap)
    assert len(bins) == optimum(sizes, cap)


def test_better_than_best_fit_where_that_fails():
    for hard, n in ([48, 46, 34, 30, 28, 25, 22, 21, 21, 15], 3), ([53, 47, 47, 43, 41, 38, 36, 27, 25, 23], 4):
        assert len(best_fit(hard, 100)) == n + 1 and len(bin_completion(hard, 100)) == n


@pytest.mark.parametrize("n", [1, 50, 500, 3000])
def test_large_sets(n):
    rng = random.Random(n)
    sizes = [min(4096, int(rng.paretovariate(1) * 60) + 1) for _ in range(n)]
    bins = bin_completion(sizes, 4096)
    valid(sizes, bins, 4096)
    assert len(bins) <= -(-sum(sizes) // 4096) + 1 + n // 50


@pytest.mark.parametrize("seed", range(6))
def test_search_over_a_whole_block_beats_best_fit(seed):
    """Triplets that fill their bins exactly, 90 items: best-fit needs more bins, the search finds fewer."""
    rng = random.Random(seed)
    sizes = []
    for _ in range(30):
        a = rng.randrange(380, 490)
        b = rng.randrange(251, 1000 - a - 250)
        sizes += [a, b, 1000 - a - b]
    rng.shuffle(sizes)
    bins = bin_completion(sizes, 1000, node_limit=20_000, steps=4_000)
    valid(sizes, bins, 1000)
    assert len(bins) < len(best_fit(sizes, 1000))


def test_many_small_items_and_a_spent_budget():
    rng = random.Random(5)
    sizes = [rng.choice([1, 2, 3, 700, 701]) for _ in range(6000)]
    for limit in (0, 50):
        bins = bin_completion(sizes, 1400, node_limit=limit)
        valid(sizes, bins, 1400)
        assert len(bins) <= len(best_fit(sizes, 1400))
    assert bin_completion([1] * 5000, 4096) and len(bin_completion([3, 3, 3], 5)) == 3


def test_bad_sizes():
    assert bin_completion([], 10) == []
    with pytest.raises(ValueError):
        bin_completion([11], 10)
    with pytest.raises(ValueError):
        bin_completion([0], 10)


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a" * 10, 7), (2, "字" * 9, 7), (3, None, 7), (4, "", 7), (None, "x", 7), (5, "b" * 4, 7), (5, "b" * 4, 7)], "doc_id bigint, text string, block int")
    got = pack_documents(docs, 10).collect()
    by = {}
    for r in got:
        by.setdefault((r["block"], r["bin_no"]), []).append(r["n_tokens"])
    assert all(sum(v) <= 10 for v in by.values())
    two = sorted((r["piece_no"], r["start_token"], r["n_tokens"]) for r in got if r["doc_id"] == 2)
    assert two == [(0, 0, 9), (1, 9, 9), (2, 18, 9)]
    assert sorted(r["doc_id"] for r in got if r["piece_no"] == 0) == [1, 2, 5, 5]
    assert pack_documents(docs.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs, 3)


def test_tables_are_packed_tight(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    packed = pack_documents(docs, 4096, block_tokens=40_000).persist()
    total = docs.selectExpr("sum(octet_length(text))").first()[0]
    report = container_report(packed, 4096).first()
    assert report["n_tokens"] == total and report["fill"] > 0.85
    alone = pack_documents(docs, 4096)
    assert container_report(alone, 4096).first()["n_containers"] <= -(-total // 4096) + 1
