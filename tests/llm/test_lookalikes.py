import unicodedata

from pyspark.sql import functions as F

from tempolex.llm.glyphs import TO_LATIN, compatible
from tempolex.llm.lookalikes import alike_classes, alike_pairs, digested, doubtful, in_script, one_form, repairs


def forms(spark, texts, foreign_twins=False):
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    return {r["i"]: r["form"] for r in one_form(df, "text", ["i"], foreign_twins).collect()}


def test_folding():
    assert compatible("ＡＢ１　x") == "AB1 x" and compatible("e​́") == "é" and compatible("⼀⾳") == "一音"
    assert compatible("a b c") == "a b c" and compatible("a\r\nb c") == "a\nb\nc"
    for a, b in (("A", "a"), ("é", "e"), ("1", "2"), ("过", "過"), ("cat", "cats")):
        assert compatible(a) != compatible(b)


def test_dominant_script():
    assert repairs("VidКіt", None)[0] == "VidKit"
    assert repairs("тoчность", None)[0] == "точность"
    assert repairs("plain", None) == [] and in_script("б", "Latin") is None
    assert dict(doubtful("это сaм")) == {"сaм": ["сам"]}


def test_vocabulary_is_asked(spark):
    got = forms(spark, ["open VidKit now", "open VіdKіt now", "see Zqхw", "Ηello", "Hello"])
    assert got[0] == got[1] == "open VidKit now" and got[2] == "see Zqхw" and got[3] == got[4] == "Hello"


def test_wholly_foreign_token_is_read_only_on_demand(spark):
    texts = ["is a а good plan", "a car", "это а не б", "а"]
    assert forms(spark, texts) == dict(enumerate(texts))
    got = forms(spark, texts, True)
    assert got[0] == "is a a good plan" and got[2] == "это а не б" and got[3] == "а"


def test_pairs_equal_brute_force(spark, data):
    s = spark.read.parquet(f"{data}/segments.parquet").where("content is not null").dropDuplicates(["segment_id"]).select("segment_id", "result_id", "seg_no", "content")
    f = one_form(s, "content", ["segment_id"], True)
    got = {tuple(r)[1:] for r in alike_pairs(f, "segment_id", ["result_id"], "content", "k", "seg_no").collect()}
    look = lambda t: "".join(TO_LATIN.get(c, c) for c in compatible(t))
    at = {(r["result_id"], r["seg_no"]): r for r in s.collect()}
    want = set()
    for (run, no), r in at.items():
        o = at.get((run, no + 1))
        if o and r["content"] != o["content"] and look(r["content"]) == look(o["content"]):
            want.add((min(r["segment_id"], o["segment_id"]), max(r["segment_id"], o["segment_id"])))
    assert got == want


def test_classes_and_pairs_of_a_class_in_blocks(spark):
    rows = [(i, "g" if i % 7 else "h", "Hi\u00a0you" if i % 3 else "Hi you" if i % 2 else "Ｈｉ you") for i in range(120)] + [(500, "g", "alone"), (501, "g", "alone"), (502, None, "Hi you"), (5, "g", "Hi\u00a0you")]
    df = spark.createDataFrame(rows, "i bigint, g string, text string")
    f = one_form(df, "text", ["i"])
    once = sorted({r for r in rows if r[1] and r[2] != "alone"})
    want = {(a[0], b[0]) for a in once for b in once if a[0] < b[0] and a[1] == b[1] and a[2] != b[2]}
    for forms_ in (f, digested(f, "text")):
        for block in (8, 1024):
            got = [tuple(r)[1:] for r in alike_pairs(forms_, "i", ["g"], "text", "k", block=block).collect()]
            assert len(got) == len(set(got)) and set(got) == want
        classes = alike_classes(forms_, "i", ["g"], "text", "k").collect()
        assert {r["unit_id"] for r in classes} == {r[0] for r in once} and len({r["class_id"] for r in classes}) == 2
        assert {(r["n_stored"], r["n_members"]) for r in classes} == {(3, sum(r[1] == g for r in once)) for g in "gh"}
    assert alike_classes(f.limit(0), "i", ["g"], "text", "k").count() == 0


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "g", 1, 2), (2, "", "g", 1, 2), (3, "é", "g", 1, 2), (4, unicodedata.normalize("NFD", "é"), "g", 1, 2), (4, unicodedata.normalize("NFD", "é"), "g", 1, 2), (5, "é", None, 1, 2)], "i bigint, text string, g string, form int, folded int")
    f = one_form(df, "text", ["i"])
    assert f.columns == ["i", "text", "g", "folded", "form"] or set(f.columns) == set(df.columns)
    got = {r["i"]: r["form"] for r in f.collect()}
    assert got == {1: None, 2: "", 3: "é", 4: "é", 5: "é"}
    assert [tuple(r) for r in alike_pairs(f, "i", ["g"], "text", "k").collect()] == [("k", 3, 4)]
    e = one_form(df.limit(0), "text", ["i"])
    assert e.count() == 0 and alike_pairs(e, "i", ["g"], "text", "k").count() == 0
    assert F is not None
