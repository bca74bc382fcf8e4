"""Alignment is exact at any length: the blocks of the quadratic method, found by hashes."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings, strategies as st

from tempolex.operators.align import matching_blocks, measures, opcodes


def plain(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=60), st.text("abc", max_size=60), st.sampled_from([0, 20, 400]))
def test_equal_to_the_quadratic_method(a, b, small):
    assert opcodes(a, b, small) == plain(a, b)


@pytest.mark.parametrize("seed", range(6))
def test_equal_on_both_sides_of_the_size_of_a_part(seed):
    rng = random.Random(seed)
    a = "".join(rng.choice("的一是不了人我在有他这为之大来以个中上们") for _ in range(900))
    b = list(a)
    for _ in range(120):
        k = rng.randrange(len(b))
        b[k : k + rng.randrange(3)] = rng.choice(["", "新", "句子", a[k : k + 9]])
    b = "".join(b)
    want = plain(a, b)
    assert opcodes(a, b, 0) == opcodes(a, b, 10_000) == opcodes(a, b, 10**9) == want


@pytest.mark.parametrize("n", [2_900, 13_000, 40_000])
def test_every_twentieth_character_changed(n):
    rng = random.Random(n)
    ref = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    hyp = "".join("X" if i % 20 == 19 else c for i, c in enumerate(ref))
    sub, omit, extra, _, chars, equal, _ = measures(hyp, ref)
    assert (sub, omit, extra, chars, equal) == (n // 20, 0, 0, n, n - n // 20)


def test_long_texts_without_anything_in_common():
    assert opcodes("a" * 50_000, "b" * 50_000) == [("replace", 0, 50_000, 0, 50_000)]
    assert opcodes("x" * 100_000, "x" * 100_000) == [("equal", 0, 100_000, 0, 100_000)]
    assert matching_blocks("", "x" * 50_000) == [] and opcodes("", "") == []
    text = "".join(random.Random(1).choice("abcd") for _ in range(30_000))
    assert opcodes(text, text[:15_000] + "#" * 7 + text[15_000:]) == [("equal", 0, 15_000, 0, 15_000), ("insert", 15_000, 15_000, 15_000, 15_007), ("equal", 15_000, 30_000, 15_007, 30_007)]
