import zlib

import numpy as np
import pytest

from tempolex.llm import harm

BAD = ["你就是个废物，赶紧注销账号吧。", "闭嘴吧智*障！", "You are such a dumbass, delete your account.", "I will bring a knife next time I see Theo.", "外地人都是蛀虫，统统赶出去才好。", "Foreigners are vermin and should be thrown out.", "发张裸照给我，课程费我出。", "Send me nudes and I will pay.", "Halt die Fresse, du wertloser Vollidiot.", "お前みたいなクズは死ねよ。", "너 같은 쓰레기는 죽어버려.", "Заткнись, тупая мразь.", "Eres un imbécil y deberías morirte."]
CALM = ["废物利用：旧瓶子做花盆。", "请大家不要在评论区互相骂“傻逼”。", "先用VidKit杀死进程，再重启一次。", "Nobody deserves to be told to go and die, so I deleted those replies.", "Please stop calling each other \"idiot\" in the comments.", "Strip the wires and screw them in.", "The classic grape cocktail needs 40 ml of syrup.", "生物课讲到性染色体和乳腺组织。", "我这渲染结果简直是垃圾，重来一遍。", "That stupid bug in VidKit cost me the whole night.", "今天我们来讲第三个例子。", "The sample rate is odd."]


@pytest.mark.parametrize(
    ("given", "want"),
    [("智*障", "智障"), ("fei物", "废物"), ("脑丨残", "脑残"), ("p.e.o.p.l.e", "people"), ("s h u t up", "shut up"), ("@$$h0l3", "asshole"), ("d*****s", "dumbass"), ("duuumbass", "dumbass"), ("ＳＨＵＴ", "shut"), ("v1.2.3 and h264", "v1.2.3 and h264"), ("іdiot", "idiot"), ("sh​ut", "shut")],
)
def test_disguise(given, want):
    assert harm.unmask(given) == want


def test_required_literals_are_necessary():
    for name, _, _, p in harm.VOTERS:
        need = harm.required(p)
        assert need and "" not in need, name
    for t in [*BAD, *CALM]:
        for u in harm.remarks(t):
            assert harm.votes(u) == [k for k, p in enumerate(harm._PATTERNS) if p.search(u)]


def test_the_classifier_reads_speech_without_blanks_like_other_speech():
    with_blanks, without = ["somebody should smash your face 12"], ["somebodyshouldsmashyourface34"]
    assert np.array_equal(harm._grams(with_blanks)[1], harm._grams(without)[1])
    row, f = harm._grams(["abcd", "", "a b c d", "xy", "语音识别"])
    assert np.bincount(row, minlength=5).tolist() == [3, 0, 3, 0, 3] and sorted(f[row == 0]) == sorted(f[row == 2])
    assert harm._grams([]) [0].size == 0 and harm._grams([""])[0].size == 0


def test_sentences_end_behind_marks_but_not_titles():
    assert harm._sentences("see dr. lee. then go! why?ok") == ["see dr. lee. ", "then go! ", "why?", "ok"]


def test_long_speech_is_cut_around_the_remark():
    calm = "今天讲第三个例子然后看封面图" * 30
    units = harm.remarks(calm + "你就是个废物赶紧注销账号吧" + calm)
    hit = [u for u in units if harm.votes(u)]
    assert len(hit) == 1 and len(hit[0]) < 100 and "".join(units).count("第三个例子") >= 59


@pytest.fixture(scope="module")
def scored(spark):
    filler = [f"今天讲第{i}个例子，先看封面图。" for i in range(300)] + [f"Today we look at example {i} of data cleaning." for i in range(300)]
    rows = [(i, t, "S-1" if t in BAD else "s2") for i, t in enumerate([*BAD * 4, *CALM * 8, *filler])] + [(9000, None, None), (9001, "", "s_1"), (9002, "x" * 200_000, "s2")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), harm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).persist()


def test_scores(scored):
    docs, out = scored
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(text)
    wrong = {text[i] for i, r in got.items() if r["is_harmful"] != (text[i] in BAD)}
    assert not wrong
    assert got[9000]["score"] == 0 and got[9001]["score"] == 0
    assert {r["category"] for i, r in got.items() if text[i] == BAD[3]} == {"threat"}


def test_rates(scored):
    r = {x["source_key"]: x for x in harm.rates(scored[1]).collect()}
    assert r["s1"]["n_docs"] == len(BAD) * 4 + 1 and r["s1"]["harmful_rate"] > 0.9 and r["s2"]["n_harmful"] == 0 and r[None]["n_docs"] == 1


def test_label_model(spark):
    v = {n: k for k, (n, *_) in enumerate(harm.VOTERS)}
    p = lambda *n: ",".join(str(v[x]) for x in sorted(n, key=v.get))
    rows = [("", 10_000), (p("zh_noun", "zh_noun_aimed"), 30), (p("zh_noun", "calm_technical"), 40), (p("en_wish", "calm_topic"), 60), (p("en_wish"), 5), (p("calm_topic"), 9), (p("ru_insult"), 3)]
    table = spark.createDataFrame(rows, "pattern string, n bigint")
    m = harm.fit_label_model(table)
    q = m.probability(harm._matrix([r[0] for r in rows]))
    assert q[0] < 0.02 and q[1] > 0.9 and q[2] < 0.3 and q[3] < 0.3 and q[5] < 0.02
    # How right a voter is comes of the data: one that speaks mostly beside voices against is believed less.
    assert m.right[v["en_wish"]] < 0.5 < m.right[v["zh_noun_aimed"]] and m.right[v["ru_insult"]] == pytest.approx(0.8, abs=0.05)
    assert m.alike[v["zh_noun"], v["zh_noun_aimed"]] > 0.3
    far = harm.fit_label_model(table.repartition(3), most_local=2)
    assert np.allclose(far.right, m.right) and np.allclose(far.beside, m.beside) and far.share == pytest.approx(m.share)
    assert np.allclose(harm.fit_label_model(table.limit(0)).right[harm._HARM], 0.8)


def test_a_third_of_the_voters_withheld(spark):
    """The classifier, which sees no voter, stands for those that did not speak."""
    from collections import Counter

    import duckdb

    d = "/root/testdata/sf0.1"
    docs = duckdb.execute(f"select doc_id, text from '{d}/documents.parquet' where text <> ''").fetchall()
    verdict = dict(duckdb.execute(f"select doc_id, max(is_harmful) from '{d}/doc_reviews.parquet' group by 1 having count(*) > 1 and min(is_harmful) = max(is_harmful)").fetchall())
    units = [(i, u) for i, t in docs for u in harm.remarks(t)]
    said = [harm.votes(u) for _, u in units]
    voices = [k for k in range(len(harm.VOTERS)) if harm._HARM[k]]
    for third in range(3):
        out = set(voices[third::3])
        heard = [",".join(str(k) for k in v if k not in out) for v in said]
        model = harm.fit_label_model(spark.createDataFrame(list(Counter(heard).items()), "pattern string, n bigint"))
        loud = {u: p for (_, u), p in zip(units, heard) if p}
        times = Counter(u for (_, u), p in zip(units, heard) if p)
        silent = Counter(u for k, ((_, u), p) in enumerate(zip(units, heard)) if not p and zlib.crc32(str(k).encode()) % 6 == 0)
        target = np.concatenate([model.probability(harm._matrix(list(loud.values()))), np.zeros(len(silent))])
        z = harm.fit_linear([*loud, *silent], target, np.array([*(times[u] for u in loud), *silent.values()], float)).logit([u for _, u in units])
        found = {i for (i, _), s in zip(units, z) if s >= 0}
        by_voters = {i for (i, _), p, v in zip(units, heard, said) if p and model.probability(harm._matrix([p]))[0] >= 0.5}
        assert found - by_voters
        harmful = {i for i, v in verdict.items() if v}
        assert len(found & harmful) >= 0.8 * len(harmful) and len(found & verdict.keys() - harmful) <= 2


def test_empty_table(spark):
    assert harm.score_documents(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_against_reviews(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = {r["doc_id"]: r["is_harmful"] for r in harm.score_documents(docs).collect()}
    agreed = duckdb.execute(f"select doc_id, max(is_harmful) from '{d}/doc_reviews.parquet' group by 1 having count(*) > 1 and min(is_harmful) = max(is_harmful)").fetchall()
    right = sum(got[i] == bool(v) for i, v in agreed)
    assert agreed and right / len(agreed) >= 0.9
