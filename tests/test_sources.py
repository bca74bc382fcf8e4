import pytest
from pyspark.sql import functions as F

from tempolex.operators import validate
from tempolex.sources import identity, render, subtitles
from tempolex.streaming import live

SRT = "1\r\n00:00:01,500 --> 00:00:03,000\r\nHello <i>you</i>\r\nthere\r\n\r\n2\r\n01:00:00,000 --> 01:00:01,050\r\n好\r\n"
VTT = "WEBVTT\n\nNOTE a comment\n\n00:01.500 --> 00:03.000 align:start\n<v Ann>Hello\n"
ASS = "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:01.50,0:00:03.00,Default,,0,0,0,,{\\an8}Hello, you\\Nthere\n"


def parsed(spark, kind, text):
    df = spark.createDataFrame([("f", text)], "path string, value string")
    return [tuple(r)[2:] for r in subtitles.PARSERS[kind](df).orderBy("seq").collect()]


def test_formats(spark):
    assert parsed(spark, "srt", SRT) == [(1500, 3000, "Hello you\nthere"), (3_600_000, 3_601_050, "好")]
    assert parsed(spark, "vtt", VTT) == [(1500, 3000, "Hello")]
    assert parsed(spark, "ass", ASS) == [(1500, 3000, "Hello, you\nthere")]
    assert parsed(spark, "json", '{"body":[{"from":1.5,"to":3.0,"content":"a"}]}') == [(1500, 3000, "a")]
    assert parsed(spark, "json3", '{"events":[{"tStartMs":5},{"tStartMs":1500,"dDurationMs":1500,"segs":[{"utf8":"a"},{"utf8":"b"}]}]}') == [(1500, 3000, "ab")]
    for kind in subtitles.PARSERS:
        assert parsed(spark, kind, "") == [] and parsed(spark, kind, None) == []


def test_readers(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    assert subtitles.read_subtitles(spark, str(tmp_path / "a.srt"), "srt").count() == 2
    with pytest.raises(ValueError):
        subtitles.read_subtitles(spark, str(tmp_path), "doc")
    (tmp_path / "b.txt").write_text("eins\n\nzwei")
    assert subtitles.read_plain(spark, str(tmp_path / "b.txt")).count() == 2
    files = identity.local_files(spark, str(tmp_path)).collect()
    assert len(files) == 2 and len({r["identity"] for r in files}) == 2


def test_srt_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r", i, i, i * 1000, i * 1000 + 500, f"line {i}") for i in range(12)], "k string, no int, id bigint, start_ms bigint, end_ms bigint, text string")
    cues = [r["cue"] for r in render.srt_cues(rows, "k", "no", "id").orderBy("cue_no").collect()]
    (tmp_path / "o.srt").write_text("\n".join(cues))
    back = subtitles.read_subtitles(spark, str(tmp_path / "o.srt"), "srt").orderBy("seq").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in back] == [(i * 1000, i * 1000 + 500, f"line {i}") for i in range(12)]


def test_identity(spark):
    seen = {
        "https://www.bilibili.com/video/BV1xx411c7mD?p=2": ("BV1xx411c7mD", "bilibili"),
        "看这个 av170001 哈": ("av170001", "bilibili"),
        "https://www.douyin.com/video/7123456789012345678": ("dy7123456789012345678", "douyin"),
        "https://b23.tv/abc12": ("short:abc12", "bilibili"),
        "nothing": (None, None),
        None: (None, None),
    }
    df = spark.createDataFrame([(s,) for s in seen], "s string")
    got = {r[0]: (r[1], r[2]) for r in df.select("s", identity.canonical_id(F.col("s")), identity.platform(F.col("s"))).collect()}
    assert got == seen


def test_part_is_never_replaced(spark):
    df = spark.createDataFrame([("x?p=2", 3), ("x", 3)], "s string, n int")
    assert [r[0] for r in df.select(identity.part(F.col("s"), F.col("n"))).collect()] == [2, 1]
    with pytest.raises(Exception, match="no such part"):
        spark.createDataFrame([("x?p=4", 3)], "s string, n int").select(identity.part(F.col("s"), F.col("n"))).collect()


def test_inspect_refuses(spark):
    df = spark.createDataFrame([("https://www.douyin.com/video/7123456789012345678",), ("BV1xx411c7mD",)], "s string")
    assert [r["refused"] for r in identity.inspect(df, "s", ["subtitles", "cookies"]).collect()] == [["subtitles"], []]


def test_emit(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0, 1, 0, 500, "a")], "k string, no int, id bigint, start_ms bigint, end_ms bigint, text string")
    with pytest.raises(PermissionError):
        render.emit(rows, str(tmp_path), ["srt"], "k", "no", "id")
    with pytest.raises(ValueError):
        render.emit(rows, str(tmp_path), ["doc"], "k", "no", "id")
    render.emit(rows, str(tmp_path), ["md", "json", "srt", "txt"], "k", "no", "id", include_transcript=True)
    assert spark.read.text(f"{tmp_path}/txt").first()["value"] == "a"
    assert spark.read.json(f"{tmp_path}/json").count() == 1


def test_sections_are_idempotent(spark):
    df = spark.createDataFrame([("# T\n\n## A\n\nold\n\n## B\n\nx",)], "b string")
    once = render.replace_section(F.col("b"), "A", F.lit("new $1 \\ ok"))
    twice = render.replace_section(once, "A", F.lit("new $1 \\ ok"))
    a, b = df.select(once, twice).first()
    assert a == b and "old" not in a and "## B\n\nx" in a and "new $1 \\ ok" in a
    c = df.select(render.replace_section(F.col("b"), "C", F.lit("z"))).first()[0]
    assert c.endswith("## C\n\nz\n")


def test_backfill_keeps_what_exists(spark):
    df = spark.createDataFrame([({"a": "1"}, {"a": "2", "b": "3"})], "x map<string,string>, y map<string,string>")
    assert df.select(render.backfill(F.col("x"), F.col("y"))).first()[0] == {"a": "1", "b": "3"}


def test_templates_fall_back(spark):
    n = spark.createDataFrame([(1, "study"), (2, "gone")], "id int, template string")
    t = spark.createDataFrame([("study", "S")], "name string, body string")
    assert sorted(tuple(r)[1:] for r in render.templated(n, t, "B").select("template", "id", "is_builtin", "body").collect()) == [(1, False, "S"), (2, True, "B")]


def test_review_section_and_limits(spark):
    top = spark.createDataFrame([("d", 1, "a", "b", 1), ("d", 2, None, "c", 1)], "d string, rank int, a_text string, b_text string, size int")
    assert render.review_section(top, "d").first()["section"] == "- 1. `a` / `b` (1)\n- 2. `` / `c` (1)"
    assert render.review_section(top.limit(0), "d").count() == 0
    assert tuple(render.over_limit(top, "b_text", 0).first()) == (2, 2)


def test_staged_write_replaces_whole(spark, tmp_path):
    out = str(tmp_path / "t")
    for n in (3, 5):
        render.write_staged(spark.range(n), out)
        assert spark.read.parquet(out).count() == n
    with pytest.raises(Exception):
        render.write_staged(spark.range(4).select(F.raise_error(F.lit("x")).alias("y")), out)
    assert spark.read.parquet(out).count() == 5


def test_validators(spark):
    files = spark.createDataFrame([("a/x.py", "ok"), ("a/v.mp4", "C:\\Users\\me"), ("b/k", "SESSDATA=1"), ("b/n", None)], "path string, text string")
    assert sorted(tuple(r) for r in validate.forbidden_content(files).collect()) == [("a/v.mp4", "machine_path"), ("a/v.mp4", "suffix"), ("b/k", "credential")]
    t = spark.createDataFrame([("l", "# head\na→b  # why\n\nc→d")], "path string, text string")
    assert [tuple(r) for r in validate.lines_without_evidence(validate.lines(t)).collect()] == [("l", 4, "c→d")]
    v = spark.createDataFrame([("p", "template-version: 1.0"), ("q", "none"), ("r", "template-version: 1.0\ntemplate-version: 2.0")], "path string, text string")
    assert {r["path"]: r["failure"] for r in validate.template_versions(v).collect()} == {"q": "missing", "r": "contradictory"}
    d = spark.createDataFrame([("v1.2.0",), ("1.2.0",), (None,)], "version string")
    assert tuple(validate.version_parity(d).first()) == (2, 1, True)
    h = spark.createDataFrame([("ref", "1", "x"), ("other", "1", "y")], "host string, a string, b string")
    assert [tuple(r) for r in validate.host_parity(h, "host", ["a", "b"], "ref").collect()] == [("other", "b", "y", "x")]
    names = spark.createDataFrame([("run_a",), ("run_b",), ("run_c",)], "name string")
    texts = spark.createDataFrame([("run_a run_a run_b",)], "text string")
    assert [r[0] for r in validate.unreferenced(names, texts, allowed=spark.createDataFrame([("run_c",)], "name string")).collect()] == ["run_b"]
    f = spark.createDataFrame([("x/skill-a/SKILL.md", "---\nname: skill-a\n"), ("x/skill-b/SKILL.md", "---\nname: other\n")], "path string, text string")
    assert [r["path"] for r in validate.frontmatter_mismatch(f).collect()] == ["x/skill-b/SKILL.md"]
    c = spark.createDataFrame([("a/G.md", "1"), ("b/G.md", "2"), ("a/H.md", "1"), ("b/H.md", "1")], "path string, content string")
    assert [tuple(r) for r in validate.differing_copies(c).collect()] == [("G.md", 2, 2)]


def test_manifest_both_directions(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    m = spark.createDataFrame([("a", h("1")), ("b", h("2")), ("c", h("3")), ("d", "zz"), ("e", h("5")), ("e", h("5"))], "path string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4"), ("e", "5"), ("f", "6")], "path string, content string")
    got = sorted(tuple(r) for r in validate.manifest_check(m, f).collect())
    assert got == [("b", "mismatch"), ("c", "missing"), ("d", "malformed"), ("e", "duplicate"), ("f", "unlisted")]


def test_streams(spark, tmp_path):
    import json

    (tmp_path / "h").mkdir()
    (tmp_path / "h/1.json").write_text("\n".join(json.dumps({"timestamp": f"2025-01-0{i}T00:00:00Z", "case": "a", "norm": "n", "cer": 0.1 * i}) for i in (1, 2)))
    q = live.live_trend(live.history_stream(spark, str(tmp_path / "h"))).writeStream.outputMode("complete").format("memory").queryName("trend").start()
    q.processAllAvailable()
    (tmp_path / "h/2.json").write_text(json.dumps({"timestamp": "2025-01-03T00:00:00Z", "case": "a", "norm": "n", "cer": 0.5}))
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from trend").first()
    assert (r["runs"], round(r["first"], 1), r["last"]) == (3, 0.1, 0.5)


def test_late_repeats_and_open_session(spark, tmp_path):
    src = tmp_path / "e"
    rows = [(1, "2025-01-01 00:00:00"), (1, "2025-01-01 00:10:00"), (1, "2025-01-01 03:00:00"), (1, "2025-01-01 09:00:00")]
    spark.createDataFrame(rows, "u bigint, t string").selectExpr("u", "cast(t as timestamp) t").write.parquet(str(src))
    stream = spark.readStream.schema("u bigint, t timestamp").parquet(str(src))
    q = live.sessions(stream, "u", "t").writeStream.outputMode("append").format("memory").queryName("sess").start()
    q.processAllAvailable()
    q.stop()
    # The last session stays open in append mode; the batch form has it.
    assert spark.sql("select * from sess").count() == 2 and live.sessions(spark.read.parquet(str(src)), "u", "t").count() == 3
    d = spark.readStream.schema("u bigint, t timestamp").parquet(str(src))
    q = live.delivered_once(d, "u", "t").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from once").count() == 1


def test_recut_stream_starts_anew_at_each_cut(spark, tmp_path):
    from tempolex.streaming.live import recut_stream

    src, kind = tmp_path / "in", "k string, start_ms bigint, end_ms bigint, text string"
    batches = [[("a", 0, 500, "你好"), ("a", 600, 900, "世界。"), ("b", 0, 100, "x" * 20)], [("a", 1000, 1400, "再说"), ("b", 200, 300, "y" * 20), (None, 0, 1, "z")], [("a", 3000, 3400, "停顿以后"), ("b", 350, 400, "z"), ("b", 400, None, "q")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(src))
        stream = recut_stream(spark.readStream.schema(kind).json(str(src)), "k")
        q = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema("k string, piece_no int, start_ms bigint, end_ms bigint, text string").json(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 0, 900, "你好世界。"), ("a", 1, 1000, 1400, "再说"), ("b", 0, 0, 100, "x" * 20)]


def test_staged_tables_are_released(spark):
    from pathlib import Path

    from tempolex import session

    df = session.stage(spark.range(5), "here")
    folder = Path(df.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert folder.exists() and session.release() >= 1 and not folder.exists() and session.release() == 0
