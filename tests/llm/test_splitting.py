import random

import pytest

from tempolex.llm.splitting import split_oversized, split_text

ENDS = ".!?。！？"


def rebuilt(text, pieces):
    return "".join(text[a + r : b] for a, b, r, _ in pieces)


@pytest.mark.parametrize("seed", range(12))
def test_round_trip_limit_and_overlap(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    text = "".join(w + rng.choice([" ", ". ", "。", "\n", "，", ""]) for w in words)
    pieces, forced = split_text(text, 120, 20)
    assert rebuilt(text, pieces) == text
    assert all(b - a <= 120 for a, b, *_ in pieces)
    for (_, b, *_), (a2, _, r2, _) in zip(pieces, pieces[1:]):
        assert a2 == b - r2 and 0 <= r2 <= 20
    assert forced == (max(len(x) for x in __import__("re").split(r"[\s.!?。！？]", text)) > 120)


def test_natural_text_is_never_cut_hard():
    rng = random.Random(9)
    text = " ".join("x" * rng.randrange(1, 100) for _ in range(200))
    pieces, forced = split_text(text, 100, 30)
    assert not forced and all(c != "hard" for *_, c in pieces) and rebuilt(text, pieces) == text


def test_forced_edge():
    assert split_text("a" * 100 + " b", 100, 10)[1] is False
    assert split_text("a" * 101 + " b", 100, 10)[1] is True
    assert split_text("a" * 99 + "," + "b" * 60, 100, 10)[1] is True


def test_cut_at_the_change_of_topic():
    a = "The cat sat on the mat with a cat. " * 8
    b = "Stocks fell as markets and stocks dropped. " * 8
    text = a + b
    pieces, _ = split_text(text, len(a) + 150, 0)
    assert pieces[0][1] in (len(a) - 1, len(a))


def test_short_text_is_one_piece():
    assert split_text("short", 10, 2) == ([(0, 5, 0, "end")], False)
    assert split_text("", 10, 2) == ([(0, 0, 0, "end")], False)


def test_operator(spark):
    long = "一句话。" * 50
    df = spark.createDataFrame([(1, long, 0), (1, long, 1), (2, "short", 0), (3, None, 0), (None, long, 0), (4, "", 0)], "unit_id bigint, text string, p int")
    got = split_oversized(df, "unit_id", "text", 60, 8, "k").orderBy("piece_no").collect()
    assert {r["unit_id"] for r in got} == {1} and [r["piece_no"] for r in got] == list(range(len(got)))
    assert all(r["piece"] == long[r["start_char"] : r["end_char"]] for r in got) and {r["cut_kind"] for r in got} == {"natural"}
    assert all(r["n_repeated"] == 8 for r in got[1:])
    assert split_oversized(df.limit(0), "unit_id", "text", 60, 8, "k").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "unit_id", "text", 1, 0, "k")


def test_hard_cuts_spare_combined_characters():
    text = "e\u0301" * 100
    pieces, _ = split_text(text, 51, 0)
    assert rebuilt(text, pieces) == text and all(text[b - 1] == "\u0301" for _, b, *_ in pieces)


def test_very_long_without_blanks():
    text = "字，" * 400_000
    pieces, forced = split_text(text, 2000, 120)
    assert forced and rebuilt(text, pieces) == text


def test_similarities_and_depths_against_brute_force():
    from collections import Counter
    from math import sqrt

    from tempolex.llm.splitting import _WORD, _depths, _similarities

    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "cd", "ef", "早上", "好"]) + rng.choice([" ", ". ", "。", " " * 30]) for _ in range(300))
    at = [i + 1 for i, c in enumerate(text) if c in ".。" and i + 1 < len(text)]
    words = [(m.start(), m[0]) for m in _WORD.finditer(text)]
    want = []
    for p in at:
        a, b = Counter(w for q, w in words if p - 50 <= q < p), Counter(w for q, w in words if p <= q < p + 50)
        norm = sqrt(sum(c * c for c in a.values()) * sum(c * c for c in b.values()))
        want.append(sum(a[w] * b[w] for w in a) / norm if norm else 0.0)
    assert _similarities(text, at, 50) == pytest.approx(want)

    def climb(sims, i, step):
        top = sims[i]
        while 0 <= (i := i + step) < len(sims) and sims[i] >= top:
            top = sims[i]
        return top

    sims = [round(rng.random(), 1) for _ in range(200)]
    assert _depths(sims) == pytest.approx([climb(sims, i, -1) + climb(sims, i, 1) - 2 * sims[i] for i in range(200)])


@pytest.mark.parametrize("seed", range(6))
def test_each_cut_is_the_deepest_valley_of_its_whole_window(seed):
    from tempolex.llm.splitting import _depths, _places, _similarities

    rng = random.Random(seed)
    text = "".join(rng.choice(["cat ", "dog ", "bird ", "fish "]) * rng.randrange(1, 9) + "x. " for _ in range(120))
    pieces, _ = split_text(text, 400, 30)
    at, rank = _places(text)
    pauses = [p for p, r in zip(at, rank) if r == 3]
    depth = dict(zip(pauses, _depths(_similarities(text, pauses, 240))))
    fresh = 0
    for a, b, r, cut in pieces[:-1]:
        inside = [p for p in pauses if fresh < p <= a + 400]
        assert cut == "pause" and depth[b] == max(depth[p] for p in inside)
        fresh = b
