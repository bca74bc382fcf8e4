import pytest
from pyspark.sql import functions as F

from tempolex import engine
from tempolex.functions.text import simplify
from tempolex.operators import align, intervals, segmenting
from tempolex.session import free_name, shared_dir, stage
from tempolex.sources import render, subtitles


def test_description(spark):
    rows = {r["item"]: r["value"] for r in engine.describe_engine(spark).collect()}
    assert rows["opencc"].startswith("absent") and rows["pyspark"]


def test_kept_by_identity(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert engine.kept(spark, str(tmp_path), "abc", make).count() == 3
    assert len(made) == 1


def test_stage_and_names(spark):
    assert stage(spark.range(5)).count() == 5 and stage(spark.range(5).limit(0)).count() == 0
    assert shared_dir(spark)
    assert free_name(spark.range(1).toDF("X"), "x") == "x_"


def test_injected_functions(spark):
    w = spark.createDataFrame([(1, 0, 5), (2, 5, 9)], "id int, start_ms bigint, end_ms bigint")
    got = engine.with_texts(w, lambda pdf: [f"t{i}" if i == 1 else None for i in pdf["id"]])
    assert [(r["id"], r["text"]) for r in got.orderBy("id").collect()] == [(1, "t1"), (2, None)]
    col, mode = simplify(F.col("t"), "on", lambda t: t.str.replace("聽", "听"))
    assert mode == "converter" and spark.createDataFrame([("聽",)], "t string").select(col).first()[0] == "听"
    df = spark.createDataFrame([(1, 0, 1, 0, 100, "你好"), (1, 1, 2, 800, 900, "再见")], "r int, no int, id int, start_ms bigint, end_ms bigint, text string")
    plain = segmenting.punctuate(df, "r", "no", "id").orderBy("no").collect()
    assert [(r["readable"], r["mode"]) for r in plain] == [("你好。", "rules"), ("再见。", "rules")]
    model = segmenting.punctuate(df, "r", "no", "id", backend=lambda t: t.map({"你好": "你好！", "再见": "别走。"})).orderBy("no").collect()
    assert [(r["readable"], r["mode"]) for r in model] == [("你好！", "model"), ("再见。", "rules")]


def test_offsets_and_cases(spark):
    kind = "m string, id bigint, start_ms bigint, end_ms bigint, text string"
    a = spark.createDataFrame([("m", 1, 1000, 2000, "你好世界"), ("m", 2, 1000, 2000, "xyz"), ("m", 3, None, 0, "你好")], kind)
    b = spark.createDataFrame([("m", 8, 1200, 2000, "大家你好世界"), ("m", 9, 1100, 2000, "你好")], kind).withColumnRenamed("id", "g")
    assert [tuple(r) for r in align.gold_offsets(a, b, "m", "id", "g").collect()] == [(1, 8, 4, 200)]
    h = spark.createDataFrame([("one", "x"), ("two", "y")], "case string, text string")
    g = spark.createDataFrame([("eval/gold/one.json", "z")], "case string, text string")
    assert sorted(map(tuple, align.match_cases(h, g).collect())) == [("one", "x", "z"), ("two", "y", None)]


def test_window_means(spark):
    w = spark.createDataFrame([("m", 1, 0, 10), ("m", 2, 50, 60)], "m string, id int, start_ms bigint, end_ms bigint")
    s = spark.createDataFrame([("m", 0.5, 0, 5), ("m", 1.0, 5, 9), ("m", None, 5, 9)], "m string, v double, start_ms bigint, end_ms bigint")
    assert sorted(map(tuple, intervals.window_means(w, s, "m", "id", "v").collect())) == [(1, 2, 0.75), (2, 0, None)]


def test_eval_inputs_and_metadata(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"from":1.0,"to":2.0,"content":"x","doc_id":"d","seq":0}\n')
    assert tuple(subtitles.read_eval(spark, str(tmp_path / "a.json"), "asr").first()) == ("d", 0, 1000, 2000, "x")
    (tmp_path / "b.json").write_text('{"start":1.0,"text":"x"}\n')
    with pytest.raises(Exception, match="rejected"):
        subtitles.read_eval(spark, str(tmp_path / "b.json"), "canonical").collect()
    with pytest.raises(ValueError):
        subtitles.read_eval(spark, str(tmp_path), "doc")
    (tmp_path / "m.json").write_text('{"video_id":"v","title":"t","duration":1.5,"chapters":[{"title":"c","from":0,"to":1}]}\n')
    assert subtitles.read_metadata(spark, str(tmp_path / "m.json")).first()["chapters"][0]["title"] == "c"


def test_vault(spark):
    n = spark.createDataFrame([("a/b", "p 1", "body"), (None, "q", None)], "topic string, name string, body string")
    assert sorted(map(tuple, render.vault_pages(n, "topic", "name", "body").collect()), key=str) == [("a-b", "p-1", "body"), ("unsorted", "q", None)]
    s = render.synthesis(n, "topic", "name", "body").collect()
    assert [r["section"] for r in s] == ["- [[p 1]] body"]
