import random

import numpy as np
import pytest

from tempolex.llm.boosting import Boosted
from tempolex.llm.turns import Fillers, Roster, _prior, candidates, clean_speech, name_key, parts_of, speaker_turns, train

PEOPLE = [("host", "主持人", "Host", "MC", 0), ("guest_a", "嘉宾甲", "Guest A", "Lenna Voss", 1), ("guest_b", "嘉宾乙", "Guest B", "Ruo Tang", 2)]
ROSTER = [dict(zip(("speaker_code", "name_zh", "name_en", "other_name", "diar_no"), p)) for p in PEOPLE]
WORDS = ["嗯", "那个", "um", "mm-hmm", "you know", "えっと"]


@pytest.fixture(scope="module")
def model():
    return train([], {}, Roster.of(ROSTER), Fillers(WORDS))


@pytest.mark.parametrize(
    ("name", "code"),
    [("主 持人", "host"), ("ＨＯＳＴ", "host"), ("Hsot", "host"), ("Hoost", "host"), ("MC", "host"), ("SPEAKER_01", "guest_a"), ("spk-02", "guest_b"), ("说话人2", "guest_b"), ("S0", "host"), ("guest_a", "guest_a"), ("Guset A", "guest_a"), ("Guest C", None), ("Note", None), ("S9", None), ("Hоst", "host")],
)
def test_names(name, code):
    got = Roster.of(ROSTER).code(name)
    assert (got and got[0]) == code


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("[00:00:06]\nspk0：\n今天讲课", [("host", True)]),
        ("主持人 (0:42)：今天讲课。\n嘉宾乙 (0:42)：好的呀", [("host", True), ("guest_b", True)]),
        ("（笑声） 30年前也不会。 嘉宾甲：《入门》里有", [(None, True), ("guest_a", True)]),
        ("主持人：30年前我也不会", [("host", True)]),
        ("<v Guest B>嗯…今天讲课", [("guest_b", True)]),
        (">> Guest B: hello there", [("guest_b", True)]),
        ("Host - Can we say it? >> Guest A: yes we can", [("host", True), ("guest_a", True)]),
        ("后来主持人：又说了一句别急，我才停下。", [(None, True)]),
        ("then I told the host: cut it here", [(None, True)]),
        ("主持人：（咳嗽）", [("host", False)]),
        ("嗯嗯嗯，那个…", []),
        ("ummm, you  know", []),
        ("♪～ [BLANK_AUDIO]", []),
        ("00:02:20,600 -->", []),
        ("注意：火候很重要", [(None, True)]),
        ("直播一般在19:35开始", [(None, True)]),
        (None, []),
        ("　", []),
    ],
)
def test_parts(model, content, want):
    assert [(c, s) for c, s, _ in parts_of([(content, 0.1)], model)[0]] == want


def test_cleaned_speech(model):
    assert clean_speech("那个,今天讲课", "那个，今天讲课", model).endswith("今天讲课")
    got = parts_of([("[00:01] Host: hello [laughs] there", 0.0)], model, True)[0]
    assert [t for *_, t in got] == ["hello there"]


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    p = Boosted(rounds=60).fit(x[:1500], y[:1500]).probability(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95
    px, py = _prior()
    assert ((Boosted().fit(px, py).probability(px) > 0.5) == py).all()
    assert np.allclose(Boosted().fit(px, np.ones(len(px))).probability(px), Boosted().fit(px, np.ones(len(px))).probability(px)[0])


def test_mentions_are_learned_from_the_cleaned_text():
    from tempolex.llm.turns import _squeeze

    rows, texts = [], {}
    for i in range(60):
        rows.append((i, f"主持人：第{i}课开始了，他转头告诉嘉宾甲：下课再讲{i}。", 0.1))
        texts[i] = _squeeze(f"第{i}课开始了，他转头告诉嘉宾甲：下课再讲{i}。")
    m = train(rows, texts, Roster.of(ROSTER), Fillers(WORDS))
    flat, found = candidates(rows[0][1], m.roster, m.roster.pattern(), 0.1, None)
    assert [c.code for c in found] == ["host", "guest_a"]
    assert list(m.label.probability(np.array([c.features for c in found])) > 0.5) == [True, False]


SEG = "segment_id bigint, result_id bigint, seg_no int, from_s double, to_s double, content string"


def tables(spark, segs, runs=((1, True, None),)):
    return (
        spark.createDataFrame(segs, SEG),
        spark.createDataFrame(list(runs), "result_id bigint, diarized boolean, text string"),
        spark.createDataFrame([tuple(r.values()) for r in ROSTER], "speaker_code string, name_zh string, name_en string, other_name string, diar_no int"),
        spark.createDataFrame([(w, "x") for w in WORDS] + [(None, None)], "word string, lang string"),
    )


def brute(segs, model):
    out, cur, turn = [], None, None
    for sid, rid, no, a, b, content in sorted(set(segs), key=lambda s: s[2]):
        for code, spoken, _ in parts_of([(content, 0.0)], model)[0]:
            cur = code or cur
            if spoken and cur:
                if turn and turn[1] == cur:
                    turn[3] = sid
                else:
                    turn = [rid, cur, sid, sid]
                    out.append(turn)
    return [tuple(t) for t in out]


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_turns_across_blocks(spark, model, block):
    rng = random.Random(block)
    texts = ["没有标签的话", "嗯，那个", None, "[笑声]", "主持人：你好啊", "嘉宾甲：我来说。 嘉宾乙：我也说", "主持人：", "Guest B -- well said", ""]
    segs = [(100 + i, 1, i, float(i), i + 0.9, rng.choice(texts)) for i in range(80)]
    segs += segs[10:20]
    got = speaker_turns(*tables(spark, segs), block=block).orderBy("turn_no")
    assert [tuple(r) for r in got.select("result_id", "speaker_code", "first_segment_id", "last_segment_id").collect()] == brute(segs, model)
    assert [r["turn_no"] for r in got.collect()] == list(range(1, got.count() + 1))


def test_turn_edges(spark):
    segs = [(1, 1, 0, None, None, "主持人：你好"), (2, 1, 1, None, 2.0, "接着说"), (3, 2, 0, 0.0, 1.0, "主持人：不算"), (None, 1, 2, 0.0, 1.0, "x"), (5, None, 3, 0.0, 1.0, "y"), (6, 3, 0, 0.0, 1.0, "没有名字")]
    t = tables(spark, segs, [(1, True, None), (2, False, "t"), (3, True, ""), (4, True, "x")])
    assert [tuple(r)[:5] for r in speaker_turns(*t).collect()] == [(1, 1, "host", 1, 2)]
    text = speaker_turns(*t, with_text=True).collect()
    assert [r["text"] for r in text] == ["你好 接着说"]
    assert speaker_turns(t[0].limit(0), *t[1:]).count() == 0
    assert speaker_turns(t[0], t[1], t[2].limit(0), t[3].limit(0)).count() == 0
    assert speaker_turns(*t, most_broadcast=0).count() == 1


def test_name_key():
    assert name_key("Ｍｒ. Ｏａｋｌｅｙ") == "mroakley" and name_key("guest_a") == name_key("Guest-A") == "guesta"


def test_very_long_segment(model):
    text = "主持人：好。 " + "这是一句话。 嘉宾甲：再说。 " * 3000
    assert len(parts_of([(text, 0.0)], model)[0]) == 3001


def test_gaps_and_speakers_decide_between_adjacent_segments():
    from tempolex.llm.turns import PAUSE_FEATURES, _squeeze

    rng = random.Random(4)
    rows, texts, names = [], {}, ["主持人", "嘉宾甲", "嘉宾乙"]
    for run in range(40):
        speaker, said = None, []
        for k in range(12):
            other = rng.choice(names) if k % 3 == 0 else speaker
            changes = other != speaker
            gap = rng.uniform(1, 2) if changes and k else rng.uniform(0, 0.3)
            speech = f"第{rng.randrange(999)}课讲第{k}点"
            rows.append((run, f"{other}：{speech}" if changes or rng.random() < 0.5 else speech, gap))
            said.append(speech)
            speaker = other
        texts[run] = _squeeze("".join(said))
    m = train(rows, texts, Roster.of(ROSTER), Fillers(WORDS))
    gap = PAUSE_FEATURES.index("gap")
    assert any(t[0] == gap for tree in m.pause.trees for t in tree)
    x = np.zeros((2, len(PAUSE_FEATURES)))
    x[:, 2:] = (0, 10, 10, 0, 1)
    x[:, gap] = (0.1, 1.5)
    quiet, long = m.pause.probability(x)
    assert long > 0.5 > quiet
    parts = parts_of([("主持人：你好啊", -1.0), ("主持人：接着说", 0.1), ("嘉宾甲：我来说", 1.5), ("再说一句", 0.1)], m, runs=[1] * 4)
    assert [[c for c, *_ in p] for p in parts] == [["host"], [None], ["guest_a"], [None]]


def test_the_filler_model_decides_what_is_spoken(model):
    assert parts_of([("那个", 0.1), ("那个社会", 0.1), ("um, you know", 0.1)], model)[1] == [(None, True, "")]
    assert [bool(p) for p in parts_of([("那个", 0.1), ("嗯嗯，那个那个", 0.1), ("um well", 0.1)], model)] == [False, False, True]


def test_too_many_names(spark):
    t = tables(spark, [(1, 1, 0, 0.0, 1.0, "主持人：你好")])
    with pytest.raises(ValueError):
        speaker_turns(*t, most_names=2)
