import pytest
from pyspark.sql import functions as F

from tempolex.functions import text as T
from tempolex.model import TranscriptSchemaError, canonical_segments, delivered_once, require_ok, settings_identity
from tempolex.operators import clean, segmenting

SEGS = "r bigint, no int, id bigint, start_ms bigint, end_ms bigint, text string"


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t"))).first()[0]


def test_shapes(spark):
    asr = spark.createDataFrame([(0.0, 1.5, "a"), (None, 1.0, "b"), (2.0, 1.0, "c"), (0.0, 1.0, None), (float("nan"), 1.0, "d")], "`from` double, `to` double, content string")
    assert [tuple(r) for r in canonical_segments(asr).collect()] == [
        (0, 1500, "a", "ok"), (None, 1000, "b", "missing_time"), (2000, 1000, "c", "reversed"), (0, 1000, None, "missing_text"), (None, 1000, "d", "missing_time"),
    ]
    with pytest.raises(TranscriptSchemaError, match="start"):
        canonical_segments(spark.createDataFrame([(0.0, "a")], "start double, text string"))
    with pytest.raises(Exception, match="rejected"):
        require_ok(canonical_segments(asr)).collect()


def test_delivered_once_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "id bigint, t string")
    assert delivered_once(df, "id").count() == 3


def test_filler_is_dropped_only_when_whole(spark):
    df = spark.createDataFrame([("这个",), ("这个社会",), ("嗯。",), (None,), ("",), ("Um…",)], "text string")
    fillers = spark.createDataFrame([("这个", "zh"), ("嗯", "zh"), ("um", "en"), (None, None)], "word string, lang string")
    assert sorted(r["text"] for r in clean.filler_only(df, fillers).collect()) == ["Um…", "嗯。", "这个"]


def test_noise_never_by_length(spark):
    df = spark.createDataFrame([("关注我",), ("好",), ("ab1",), ("http://x",), (None,), ("正文内容",)], "text string")
    assert [r[0] for r in df.select(clean.noise("text")).collect()] == [True, False, True, True, False, False]


def test_corrections(spark):
    assert one(spark, lambda c: clean.corrected(c, {"囗": "口", "在见": "再见"}), "囗说在见") == "口说再见"
    assert one(spark, lambda c: clean.corrected(c), None) is None


def test_failure_codes(spark):
    got = {m: one(spark, clean.failure_code, m) for m in (None, "HTTP 412", "read timed out", "no audio stream", "what")}
    assert got == {None: 0, "HTTP 412": 22, "read timed out": 22, "no audio stream": 27, "what": 1}


def test_adjacent_duplicates(spark):
    df = spark.createDataFrame([(1, 0, 10, 0, 1, "a"), (1, 1, 11, 1, 2, "a"), (1, 2, 12, 2, 3, None), (1, 3, 13, 3, 4, None), (1, 4, 14, 4, 5, "a"), (2, 0, 15, 0, 1, "a"), (None, 0, 16, 0, 1, "a")], SEGS)
    assert sorted(r["id"] for r in clean.adjacent_duplicates(df, "r", "no", "id").collect()) == [11, 13]


def test_fragments_join_without_loss(spark):
    df = spark.createDataFrame([(1, 0, 1, 0, 100, "a"), (1, 1, 2, 100, 900, "b"), (1, 2, 3, 900, 1000, "c"), (1, 3, 4, 1000, 2000, None), (2, 0, 5, 0, 9, "x"), (2, 1, 6, 9, 12, "y")], SEGS)
    got = sorted(tuple(r) for r in clean.merge_fragments(df, "r", "no", "id").collect())
    assert got == [(1, 1, 0, 1000, 3, "abc"), (1, 2, 1000, 2000, 1, ""), (2, 1, 0, 12, 2, "xy")]


def test_one_frame_cards_stay(spark):
    df = spark.createDataFrame([("m", i, i * 250, i * 250 + 250, t) for i, t in enumerate("abaa")], "k string, id bigint, start_ms bigint, end_ms bigint, text string")
    got = sorted(tuple(r) for r in clean.card_runs(df, "k", "start_ms", "id", "text", "end_ms").collect())
    assert got == [("m", 1, 0, 250, 1, "a"), ("m", 2, 250, 500, 1, "b"), ("m", 3, 500, 1000, 2, "a")]


def test_peaks(spark):
    df = spark.createDataFrame([("m", i, i, s) for i, s in enumerate([0.1, 0.9, 0.9, 0.2, None, 0.95])], "k string, id bigint, t bigint, s double")
    assert sorted(r["id"] for r in clean.peaks(df, "k", "t", "id", "s", 0.5).collect()) == [1, 5]


@pytest.mark.parametrize("limit", [28, 12, 8])
def test_recut_loses_nothing(spark, data, limit):
    rows = canonical_segments(spark.read.parquet(f"{data}/segments.parquet").dropDuplicates(["segment_id"]), "segment_id")
    parts = segmenting.recut(rows, ["segment_id"], most_chars=limit)
    assert parts.where(F.length("text") > limit).count() == 0
    whole = parts.groupBy("segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda x: x["text"]), "").alias("t"), F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    wrong = rows.where("text <> ''").join(whole, "segment_id", "left").where("t is null or t <> text or not (a <=> start_ms) or not (b <=> end_ms)")
    assert wrong.where("end_ms >= start_ms or start_ms is null or end_ms is null").where("start_ms is not null and end_ms is not null or t <> text").count() == 0


def test_words_cut_at_pause_mark_and_length(spark):
    kind = "w array<struct<start_ms:bigint,end_ms:bigint,word:string>>"
    words = [(0, 100, "今天"), (100, 200, "讲。"), (200, 300, "下"), (1000, 1100, "课"), (1100, 1200, "后记得复习")]
    got = spark.createDataFrame([(words,), (None,), ([],)], kind).select(segmenting.cut_words(F.col("w"), most_chars=5)).collect()
    assert [tuple(p) for p in got[0][0]] == [(0, 200, "今天讲。", 2), (200, 300, "下", 1), (1000, 1100, "课", 1), (1100, 1200, "后记得复习", 1)]
    assert got[1][0] is None and got[2][0] == []


def test_segments_are_cut_at_words_or_stay_whole(spark):
    kind = "id int, start_ms bigint, end_ms bigint, text string, words array<struct<start_ms:bigint,end_ms:bigint,word:string>>"
    good = [(0, 100, "今天"), (100, 200, "讲。"), (200, 300, " 下"), (1000, 1100, "课"), (1100, 1200, "后记得"), (1200, 1300, "复习")]
    rows = [
        (1, 0, 1500, " 今天 讲。 下课后记得复习 ", good),
        (2, 0, 1500, "今天讲，下课后记得复习", good),
        (3, 0, 1500, "今天讲", [(0, 100, "今天"), (50, 200, "讲")]),
        (4, 0, 1500, "一段没有词时间的很长很长很长很长很长很长很长很长的话", None),
        (5, 0, 1500, "今天讲", [(0, 100, "今天"), (None, 200, "讲")]),
        (6, 0, 150, "今天讲", [(0, 100, "今天"), (100, 200, "讲")]),
        (7, None, None, "今天讲", []),
        (8, 0, 1, "", good),
        (9, 0, 1, None, good),
        (10, 0, 1500, "今天讲", [(0, 100, "今天")]),
    ]
    df = spark.createDataFrame(rows, kind)
    got = sorted(map(tuple, segmenting.resegment(df, ["id"], most_chars=4).collect()))
    assert got[:4] == [(1, 0, 0, 200, " 今天 讲。 "), (1, 1, 200, 300, "下"), (1, 2, 1000, 1200, "课后记得"), (1, 3, 1200, 1300, "复习 ")]
    assert got[4:] == [(i, 0, s, e, t) for i, s, e, t, _ in rows[1:] if t]
    assert sorted(map(tuple, segmenting.resegment(df.drop("words"), ["id"]).collect())) == [(i, 0, s, e, t) for i, s, e, t, _ in rows if t]


def test_given_segments_have_no_words_and_stay_whole(spark, data):
    from tempolex.plans import catalog

    want = [(r["segment_id"], 0, r["start_ms"], r["end_ms"], r["text"]) for r in catalog.segments(spark, data).collect() if r["segment_id"] is not None and r["text"]]
    assert sorted(map(tuple, catalog.resegmented_words(spark, data).collect()), key=str) == sorted(want, key=str)


def test_pause_marks(spark):
    df = spark.createDataFrame(
        [(1, 0, 1, 0, 100, "你好"), (1, 1, 2, 250, 300, "是吗"), (1, 2, 3, 950, 1000, "有。"), (1, 3, 4, 1050, 1100, "没"), (1, 4, 5, 1750, 1800, "但是"), (1, 5, 6, 1801, 1900, None)], SEGS
    )
    got = {r["id"]: r["mark"] for r in segmenting.pause_marks(df, "r", "no", "id").collect()}
    assert got == {1: "，", 2: "？", 3: "", 4: "，", 5: "", 6: ""}


def test_numerals(spark):
    for given, want in [("六", "6"), ("一百", "100"), ("四十五岁", "45岁"), ("十二", "12"), ("三千零五", "3005"), ("二〇二四年", "2024年"), ("两万三千", "23000"), ("万", "万"), (None, None), ("", "")]:
        assert one(spark, T.numerals, given) == want


def test_scalar_text(spark):
    assert one(spark, lambda c: T.simplify(c)[0], "這個會") == "这个会"
    assert T.simplify(F.lit("x"), "off")[1] == "off" if spark else None
    with pytest.raises(RuntimeError):
        T.simplify(F.lit("x"), "on")
    assert one(spark, T.norm_for_score, "ＡＢ，这 個！") == "ab这个"
    assert one(spark, lambda c: T.timecode(c), 3_723_004, "bigint") == "01:02:03,004"
    assert one(spark, lambda c: T.wrap(c, 2), "abcde") == "ab\ncd\ne"
    assert one(spark, T.redact, "SESSDATA=abc; see /home/me/x and token=1 at https://a.b/c?sign=1") == "[cookie]; see [home]/x and token=1 at [signed-url]"
    assert one(spark, T.is_blank, "　 ") is True and one(spark, T.is_blank, None) is None


def test_settings_identity_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    a, b, c = (r[0] for r in df.select(settings_identity(df, ["x", "y"])).collect())
    assert a == c != b


def test_failure_types_decide_before_texts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("HTTP 404", "requests.ReadTimeout"), ("x", "TypeError"), (None, None), (None, "LoginRequired")], "m string, k string")
    assert [r[0] for r in df.select(clean.failure_code(F.col("m"), F.col("k"))).collect()] == [22, 1, 0, 21]
    assert [r[0] for r in spark.createDataFrame([(True,), (False,), (None,)], "h boolean").select(clean.audio_code(F.col("h"))).collect()] == [0, 27, 27]
