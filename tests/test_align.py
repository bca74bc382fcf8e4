import random
import time
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempolex.operators import align, fuse, gates, history, longest, review


def test_direction_of_opcodes():
    assert align.measures("ab", "aXb")[:3] == (0, 1, 0)
    assert align.measures("aXb", "ab")[:3] == (0, 0, 1)
    assert align.measures("血包", "雪包")[:3] == (1, 0, 0)
    assert sum(align.measures("abaaac", "cabcab")[:3]) == 5
    assert align.measures("", "")[6] == 1.0


def test_opcodes_equal_difflib_and_rebuild():
    rng = random.Random(1)
    for _ in range(30):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(2))
        assert align.opcodes(a, b) == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_long_texts_are_cut_at_anchors():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefghij") for _ in range(30_000))
    b = "".join("X" if i % 500 == 7 else c for i, c in enumerate(a))
    ops = align.opcodes(a, b)
    assert "".join(b[j:m] if t != "equal" else a[i:k] for t, i, k, j, m in ops) == b
    assert "".join(a[i:k] for t, i, k, j, m in ops) == a
    assert sum(k - i for t, i, k, *_ in ops if t == "equal") == sum(x == y for x, y in zip(a, b))
    assert align.opcodes("x" * 20_000, "y" * 20_000) == [("replace", 0, 20_000, 0, 20_000)]


def test_measures_of_columns(spark):
    df = spark.createDataFrame([("ab", "aXb"), (None, "a"), ("", "")], "h string, r string")
    got = [r[0] for r in df.select(align.aligned(F.col("h"), F.col("r"))).collect()]
    assert got[0]["omit"] == 1 and got[1]["ref_chars"] is None and got[2]["ratio"] == 1.0
    assert df.select(align.cer(align.aligned(F.col("h"), F.col("r")))).collect()[2][0] is None


def test_table_function(spark):
    spark.udtf.register("char_diff", align.udtf_char_diff())
    assert [tuple(r) for r in spark.sql("select * from char_diff('ab', 'aXb')").collect()] == [("insert", 1, 1, 1, 2, "", "X")]


def test_marks_pair_one_to_one():
    assert align.paired_marks("好，的。", "好的，。") == (2, 2, 2)
    assert align.paired_marks("一二三四五六，", "一，二三四五六") == (0, 1, 1)
    assert align.paired_marks("，，", "，") == (1, 2, 1)


def test_punctuation_not_applicable(spark):
    df = spark.createDataFrame([("a，b。", "a，b。"), ("a，b", "ab")], "h string, r string")
    p = df.select(align.punctuation(F.col("h"), F.col("r")).alias("p")).select(*align.f_score(F.col("p")))
    assert [tuple(r) for r in p.collect()] == [(1.0, 1.0, 1.0), (None, None, None)]


PIECES = "m string, id bigint, start_ms bigint, end_ms bigint, text string"


def test_fusion_labels_and_conservation(spark):
    sub = spark.createDataFrame([("m", 1, 0, 1000, "你好世界"), ("m", 2, 1000, 2000, "第二句话"), ("m", 3, 5000, 6000, "沉默")], PIECES)
    asr = spark.createDataFrame([("m", 11, 100, 900, "你好，世界"), ("m", 12, 1100, 1900, "第三句话"), ("m", 13, 3000, 4000, "只有听到"), ("m", 14, 5100, 5900, "完全不同的"), (None, 15, 0, 1, "x")], PIECES)
    f = fuse.fuse(sub, asr, "m", "id", "id")
    got = {(r["piece_id"], r["provenance"]): r for r in f.collect()}
    assert set(got) == {(1, "subtitle"), (2, "mixed"), (3, "subtitle"), (13, "asr"), (14, "asr")}
    assert got[2, "mixed"]["alternative"] == "第三句话" and got[14, "asr"]["recovered_by"] == "coverage_audit"
    assert fuse.conserved(f, sub, "m").count() == 0 and fuse.conserved(f, asr, "m").count() == 0
    assert fuse.fuse(sub.limit(0), asr.limit(0), "m", "id", "id").count() == 0


def test_fusion_of_the_tables_conserves(spark, data):
    from tempolex.plans import catalog

    f = fuse.fuse(catalog.cards(spark, data), catalog.segments(spark, data), "media_id", "card_id", "segment_id")
    f = f.persist()
    assert fuse.conserved(f, catalog.cards(spark, data), "media_id").count() == 0
    assert fuse.conserved(f, catalog.segments(spark, data), "media_id").count() == 0


def test_preferences(spark):
    df = spark.createDataFrame([("赠养老人", "赡养老人"), ("赡养", "赠养"), ("无", "关"), (None, "赡养")], "a string, b string")
    got = [r[0] for r in df.select(fuse.preferred(F.col("a"), F.col("b"))).collect()]
    assert [g["text"] for g in got] == ["赡养老人", "赡养", "无", None] and got[0]["chosen_by"] == "赠养→赡养" and got[2]["chosen_by"] is None


def test_lexicon(spark):
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "term string")
    got = [tuple(r) for r in fuse.lexicon([(0, t("beta", None, "x")), (1, t("alpha", "beta", "The"))], noise=["the"]).collect()]
    assert got == [("beta", 0, 1), ("alpha", 1, 2)]


def test_gates(spark):
    df = spark.createDataFrame(
        [("正常的一句话", 1.2, 0, 2000), ("", 1.0, 0, 10), (None, 1.0, 0, 10), ("哈哈哈哈哈哈哈", 1.0, 0, 3000), ("好", 1.0, 0, 10_000), ("好", 9.0, 0, 1000), ("好的", None, 0, 0)], "text string, compression_ratio double, start_ms bigint, end_ms bigint"
    )
    assert [r["reject_reason"] for r in gates.hallucination_gate(df).collect()] == [None, "empty", "empty", "repetition", "rate", "compression", None]


def test_compression_and_overlap(spark):
    df = spark.createDataFrame([("aaaa" * 200, "aab"), ("", "x"), (None, "x")], "a string, b string")
    got = df.select(gates.compression_ratio(F.col("a")), gates.char_overlap(F.col("b"), F.col("a"))).collect()
    assert got[0][0] > 20 and got[0][1] == pytest.approx(2 / 3) and got[1][0] is None and got[1][1] == 0.0 and got[2][1] is None


def test_refine_gate(spark):
    kind = "old_text string, new_text string, old_ms bigint, new_ms bigint, old_conf double, new_conf double, old_compression double, new_compression double"
    df = spark.createDataFrame(
        [("abcd", "abce", 1000, 900, -1.2, -0.9, 1.0, 1.0), ("abcd", " ", 1000, 900, -1.2, -0.9, 1.0, 1.0), ("abcd", "abcd", 1000, 500, -1.2, -0.9, 1.0, 1.0), ("abcd", "wxyz", 1000, 900, -1.2, -0.9, 1.0, 1.0), ("abcd", "abcd", 1000, 900, -1.2, -1.15, 1.0, 1.0), ("abcd", "abcd", 1000, 900, -1.0, -1.05, 3.0, 1.5)], kind
    )
    assert [r["reject_reason"] for r in gates.refine_gate(df).collect()] == [None, "empty", "time_cover", "char_overlap", "no_gain", None]


RUNS = "case string, norm string, t timestamp, id bigint, cer double"


def test_history(spark):
    from datetime import datetime as D

    df = spark.createDataFrame([("a", "n", D(2025, 1, 1), 1, 0.1111), ("a", "n", D(2025, 1, 2), 2, 0.1050), ("b", "n", D(2025, 1, 1), 3, 0.1050), ("b", "n", D(2025, 1, 1), 4, 0.1120), ("c", "n", D(2025, 1, 1), 5, 0.5), ("c", "n", None, 6, 0.9)], RUNS)
    t = {r["case"]: (r["runs"], round(r["delta"], 4)) for r in history.trend(df, ["case", "norm"], "t", "id", "cer").collect()}
    assert t == {"a": (2, -0.0061), "b": (2, 0.007), "c": (1, 0.0)}
    assert [r["case"] for r in history.regressions(df, ["case", "norm"], "t", "id", "cer").collect()] == ["b"]
    assert {r["case"]: r["id"] for r in history.latest(df, ["case", "norm"], "t", "id").collect()} == {"a": 2, "b": 4, "c": 5}


def test_baselines_are_kept_apart_by_norm(spark):
    s = spark.createDataFrame([("a", "opencc", 0.11), ("a", "fallback", 0.10), ("b", "opencc", 0.1), ("c", "opencc", None)], "case string, norm string, cer double")
    b = spark.createDataFrame([("a", "opencc", 0.10), ("a", "fallback", 0.12), ("c", "opencc", 0.1)], "case string, norm string, cer double")
    g = gates.baseline_gate(s, b, ["case", "norm"], "cer")
    assert {(r["case"], r["norm"]): r["verdict"] for r in g.collect()} == {("a", "opencc"): "regressed", ("a", "fallback"): "improved", ("b", "opencc"): "unrecorded", ("c", "opencc"): "regressed"}
    with pytest.raises(Exception, match="baseline"):
        gates.require_recorded(g).collect()
    assert gates.threshold_gate(s, "cer", 0.2).first()["n_over"] == 1


def test_release_rows_once(spark):
    rows = spark.createDataFrame([("a", "n", 0.1), ("b", "n", 0.2)], "case string, norm string, cer double")
    have = spark.createDataFrame([("v1.2.0", "a", "n")], "version string, case string, norm string")
    assert [r["case"] for r in history.append_release(rows, have, "1.2.0").collect()] == ["b"]
    with pytest.raises(ValueError):
        history.append_release(rows, have, "latest")


def test_difference_gate_counts_after_the_threshold(spark):
    s = spark.createDataFrame([("a", "b"), ("abc", "")], "a_text string, b_text string")
    assert tuple(gates.difference_gate(s, 2).first()) == (1, 25) and tuple(gates.difference_gate(s, 9).first()) == (0, 0)


def test_shortlist_and_worksheet(spark):
    s = spark.createDataFrame([("d", i, a, b) for i, (a, b) in enumerate([("的", "了"), ("血", "雪"), ("一二三", ""), ("", "吗"), ("四五", "六")])], "d string, i int, a_text string, b_text string")
    assert [(r["i"], r["rank"]) for r in review.shortlist(s, "d", ["i"]).orderBy("rank").collect()] == [(2, 1), (4, 2), (1, 3)]
    w = spark.createDataFrame([("d", i, i % 2 == 0, i % 3 == 0) for i in range(40)], "d string, i bigint, x boolean, y boolean")
    got = review.worksheet(w, "d", "i", [("x", F.col("x")), ("y", F.col("y"))]).collect()
    assert len(got) == 12 and {r["reason"] for r in got} == {"x"} and got[0]["flagged_total"] == 27


def test_decile_and_decisions(spark):
    df = spark.createDataFrame([("k", i, float(i % 10)) for i in range(40)] + [("k", 99, None)], "k string, i bigint, s double")
    assert sorted(r["i"] for r in review.lowest_decile(df, "k", "i", "s").collect()) == [0, 10, 20, 30]
    v = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (4, None)], "d bigint, v int")
    assert {r["d"]: r["decision"] for r in review.decisions(v, "d", "v").collect()} == {1: "unresolved", 2: "correct", 3: "keep", 4: None}


def test_distances_of_neighbours_in_any_script(spark, data):
    from tempolex.plans import catalog

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    rows = [r for r in catalog.segments(spark, data).collect() if r["result_id"] is not None]
    number = lambda v: (v is not None, v)
    rows.sort(key=lambda r: (r["result_id"], number(r["seg_no"]), number(r["segment_id"])))
    pairs = [(b["segment_id"], a["text"], b["text"]) for a, b in zip(rows, rows[1:]) if a["result_id"] == b["result_id"] and a["text"] is not None and b["text"] is not None]
    got = sorted(map(tuple, catalog.edit_distances(spark, data).collect()), key=str)
    assert got == sorted(((i, distance(a, b)) for i, a, b in pairs), key=str)
    assert sum(not (a + b).isascii() for _, a, b in pairs) > len(pairs) / 2


def test_offsets_at_any_distance(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 14)))
    kind = "m string, id bigint, start_ms bigint, end_ms bigint, text string"
    own = [(f"m{i % 3}", i, rng.randrange(200_000), None, text()) for i in range(60)] + [("m9", 60, 0, 1, "abc"), ("m0", 61, 0, 1, None), (None, 62, 0, 1, "abcd")]
    gold = [(f"m{i % 3}", i, rng.randrange(200_000), None, text()) for i in range(50)] + [("m0", 50, None, 0, "abcdefgh"), ("m0", 51, 5, 9, None)]
    want = []
    for m, i, s, _, t in own:
        near = []
        for k, g, u, _, v in gold:
            if m == k and None not in (t, u, v) and (n := SequenceMatcher(None, t, v, autojunk=False).find_longest_match().size) >= 2:
                near.append((-n, abs(s - u), g))
        if near:
            want.append((i, min(near)[2], -min(near)[0], min(near)[1]))
    a, b = spark.createDataFrame(own, kind), spark.createDataFrame(gold, kind).withColumnRenamed("id", "g")
    for rows in (2048, 7):
        assert sorted(map(tuple, align.gold_offsets(a, b, "m", "id", "g", block_rows=rows).collect())) == want
    assert max(w[3] for w in want) > 10_000


def test_offsets_of_one_large_medium_do_not_compare_all_pairs(spark):
    rng = random.Random(5)
    n = 24_000
    texts = ["".join(rng.choices("abcdefghijklmnop", k=30)) for _ in range(n)]
    kind = "m string, id bigint, start_ms bigint, end_ms bigint, text string"
    own = spark.createDataFrame([("m", i, i * 1000, None, t) for i, t in enumerate(texts)], kind)
    gold = spark.createDataFrame([("m", i, i * 1000 + 70_000, None, "-" + t) for i, t in enumerate(texts)], kind).withColumnRenamed("id", "g")
    began = time.monotonic()
    got = align.gold_offsets(own, gold, "m", "id", "g").collect()
    assert time.monotonic() - began < 25
    assert sorted(map(tuple, got)) == [(i, i, 30, 70_000) for i in range(n)]


def _longest_by_difflib(own, gold, least):
    """The brute-force version; own: (group, text, start), gold: these and the preference."""
    out = {}
    for i, (k, t, s) in enumerate(own):
        found = [(-n, abs(s - u), p, j) for j, (g, v, u, p) in enumerate(gold) if g == k and (n := SequenceMatcher(None, t, v, autojunk=False).find_longest_match().size) >= least]
        if found:
            n, d, _, j = min(found)
            out[i] = (j, -n, d)
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a", "的了你好\U0001f600ab\0\uffff"])
@pytest.mark.parametrize("at_once", [1 << 19, 20])
def test_longest_stretches_of_an_index(letters, at_once, monkeypatch):
    monkeypatch.setattr(longest, "_AT_ONCE", at_once)
    for seed in range(40):
        rng = random.Random(seed)
        span, groups, least = rng.choice([5, 30, 1000]), rng.randrange(1, 4), rng.choice([1, 2, 3])
        text = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice([3, 14, 40]))))
        m = rng.randrange(1, 25)
        gold = [(rng.randrange(groups), text(), rng.randrange(-span, span), p) for p in rng.sample(range(m), m)]
        own = [(rng.randrange(groups + 1), text() + rng.choice(["", "z"]), rng.randrange(-span, span)) for _ in range(rng.randrange(1, 25))]
        k, t, s, p = zip(*gold)
        index = longest.Index(np.array(k), [*t], np.array(s), np.array(p))
        k, t, s = zip(*own)
        got = [x for part in index.nearest(np.array(k), [*t], np.array(s), least) for x in zip(*(c.tolist() for c in part))]
        assert len(got) == len({x[0] for x in got})
        assert {x[0]: x[1:] for x in got} == _longest_by_difflib(own, gold, least)


def test_offsets_read_whole_groups_at_a_time(monkeypatch):
    rng = random.Random(2)
    rows = sorted(((rng.randrange(9), rng.random() < 0.5, i, rng.randrange(50), "".join(rng.choices("abc", k=rng.randrange(9)))) for i in range(200)), key=lambda r: r[0])
    rows.insert(0, (-1, True, 200, 0, "abc"))
    table = pa.table({"k": [f"k{r[0]}" for r in rows], "id": [r[2] if r[1] else None for r in rows], "g": [None if r[1] else r[2] for r in rows], "s": [r[3] for r in rows], "text": [r[4] for r in rows], "own": [r[1] for r in rows]})
    own, gold = ([(r[0], r[4], r[3], r[2]) for r in rows if r[1] is side] for side in (True, False))
    want = {own[i][3]: (gold[j][3], n, d) for i, (j, n, d) in _longest_by_difflib([r[:3] for r in own], gold, 2).items()}
    for most, size in ((1 << 20, 1000), (40, 7), (1, 1), (200, 64)):
        monkeypatch.setattr(align, "_TOGETHER", most)
        parts = [*align._whole_groups(iter(table.to_batches(size)), ["k"])]
        assert pa.concat_tables(p for p, _ in parts) == table and (len(parts) > 1) == (most < 1000)
        found = [r for p, group in parts for r in align._offsets(p, group, 2, False).to_pylist()]
        assert {r["id"]: (r["g"], r["n"], r["d"]) for r in found} == want and len(found) == len(want)
        every = [r for p, group in parts for r in align._offsets(p, group, 2, True).to_pylist()]
        assert sorted(r["id"] for r in every) == sorted(r[3] for r in own) and sum(r["n"] is not None for r in every) == len(want)


def test_timeline_offset_of_a_shifted_medium(spark):
    kind = "m string, id bigint, start_ms bigint, end_ms bigint, text string"
    words = ["red apples", "blue chairs", "old green doors", "6789"]
    a = spark.createDataFrame([("m", i, i * 2000 + 30_000, i * 2000 + 31_000, w) for i, w in enumerate(words)] + [("n", 9, 0, 1, "x"), ("o", 10, 0, 1, "pq")], kind)
    b = spark.createDataFrame([("m", i, i * 2000, i * 2000 + 1000, w) for i, w in enumerate(words[:3])] + [("o", 10, 0, 1, "rs")], kind)
    assert sorted(map(tuple, align.timeline_offset(a, b, "m", "id", "id").collect())) == [("m", 3, 4, 30_000.0, 30_000), ("o", 0, 1, None, None)]


def test_timeline_offset_over_blocks_and_of_one_large_medium(spark):
    rng = random.Random(6)
    kind = "m string, id bigint, start_ms bigint, end_ms bigint, text string"
    text = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 14)))
    rows = [(f"m{i % 4}", i, rng.randrange(200_000), None, text()) for i in range(120)] + [("n", 200, 1, None, "abc"), ("o", 201, 1, None, "abc"), ("m0", None, 1, None, "abc"), ("m0", 202, None, None, "abc"), (None, 203, 1, None, "abc")]
    pieces = [(f"m{i % 3}", i, rng.randrange(200_000), None, text()) for i in range(90)] + [("o", 90, 1, None, None), (None, 91, 1, None, "abc")]
    own, gold = (spark.createDataFrame(x, kind) for x in (rows, pieces))
    best = _longest_by_difflib([(r[0], r[4], r[2]) for r in rows[:120]], [(p[0], p[4], p[2], p[1]) for p in pieces[:90]], 2)
    want = [(m, len(d), 30, float(np.median(d)), max(d)) for m in ("m0", "m1", "m2") for d in [[best[i][2] for i in range(120) if rows[i][0] == m and i in best]]] + [("o", 0, 1, None, None)]
    for size in (7, 100_000):
        assert sorted(map(tuple, align.timeline_offset(own, gold, "m", "id", "id", block_rows=size).collect())) == want
    n = 24_000
    texts = ["".join(rng.choices("abcdefghijklmnop", k=30)) for _ in range(n)]
    own = spark.createDataFrame([("m", i, i * 1000, None, t) for i, t in enumerate(texts)], kind)
    gold = spark.createDataFrame([("m", i, i * 1000 + 70_000, None, "-" + t) for i, t in enumerate(texts)], kind)
    began = time.monotonic()
    assert [tuple(r) for r in align.timeline_offset(own, gold, "m", "id", "id").collect()] == [("m", n, n, 70_000.0, 70_000)]
    assert time.monotonic() - began < 25


def test_preference_compares_position_by_position(spark):
    rows = [
        ("他赠养老人", "他赡养老人", "他赡养老人", "赠养→赡养"),
        ("他赡养老人", "他赠养老人", "他赡养老人", "赠养→赡养"),
        ("赠品", "礼品", "赠品", None),
        ("以经走了", "已经走", "已经走", "以经→已经"),
        ("aXb", "ab", "ab", "X→"),
        (None, "再见", None, None),
        ("再见", None, "再见", None),
    ]
    table = {"在见": "再见", "以经": "已经", "赠养": "赡养", "做": "做"}
    for a, b, text, by in rows[:4] + rows[5:]:
        got = spark.createDataFrame([(a, b)], "a string, b string").select(fuse.preferred(F.col("a"), F.col("b"), table).alias("p")).first()["p"]
        assert (got["text"], got["chosen_by"]) == (text, by)
    got = spark.createDataFrame([("去经营公司", "去管公司")], "a string, b string").select(fuse.preferred(F.col("a"), F.col("b"), {"管": "经营"}).alias("p")).first()["p"]
    assert (got["text"], got["chosen_by"]) == ("去经营公司", "管→经营")


def test_decided_fusion_keeps_both_readings_and_fails_if_one_is_lost(spark):
    kind = "m string, id bigint, start_ms bigint, end_ms bigint, text string"
    cards = spark.createDataFrame([("v", 1, 0, 1000, "他赠养老人"), ("v", 2, 2000, 3000, "你好")], kind)
    heard = spark.createDataFrame([("v", 7, 0, 1000, "他赡养老人"), ("v", 8, 2000, 3000, "你好")], kind)
    fused = fuse.fuse(cards, heard, "m", "id", "id")
    out = {r["piece_id"]: r for r in fuse.decided(fused).collect()}
    assert (out[1]["text"], out[1]["alternative"], out[1]["chosen_by"], out[1]["needs_review"]) == ("他赡养老人", "他赠养老人", "赠养→赡养", True)
    assert out[2]["chosen_by"] is None and out[2]["text"] == "你好"
    assert fuse.require_conserved(fuse.decided(fused), [cards, heard], "m").count() == 2
    import pytest as p

    with p.raises(Exception, match="characters lost"):
        fuse.require_conserved(fused.where("piece_id <> 2"), [cards, heard], "m").collect()


def test_regressions_of_a_hot_key_send_two_rows_a_partition(spark):
    df = spark.range(5000).select(F.when(F.col("id") >= 0, "a").alias("case"), F.when(F.col("id") >= 0, "n").alias("norm"), F.col("id"), F.timestamp_seconds("id").alias("t"), (F.col("id") % 7 / 10).alias("cer"))
    got = history.regressions(df, ["case", "norm"], "t", "id", "cer")
    assert [(r["previous"], r["last"]) for r in got.collect()] == [] or got.first()["last"] > got.first()["previous"]
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()


def test_baselines_are_held_by_mode(spark):
    m = spark.createDataFrame([("c", "full", 0.1), ("c", "full", 0.2), ("c", "plain", 0.5), ("d", None, 0.1), ("e", "full", None)], "case string, norm string, cer double")
    base = gates.by_mode(m, "case", "norm", "cer")
    assert {r["case"]: dict(r["metric_by_mode"]) for r in base.collect()} == {"c": {"full": 0.1, "plain": 0.5}, "e": {"full": None}}
    now = spark.createDataFrame([("c", "full", 0.11), ("c", "plain", 0.4), ("c", "odd", 0.1), ("x", "full", 0.1)], "case string, norm string, cer double")
    assert {(r["case"], r["norm"]): r["verdict"] for r in gates.gate_by_mode(now, base, "case", "norm", "cer").collect()} == {("c", "full"): "regressed", ("c", "plain"): "improved", ("c", "odd"): "unrecorded", ("x", "full"): "unrecorded"}
