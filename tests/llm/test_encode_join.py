"""Joining two encodings must give the encoding of the whole text, whatever the cut."""

import random

import pytest

from tidemark.llm.encode import VOCABULARY, encoding, halves, join, join_all

ALPHABETS = [
    "abc def'll  ghi's 123 !!??\n\n\t",
    "的一是在不了有和人这中大为上个国我以要他时来用们",
    "a",
    "ab",
    " ",
    "'lsrtvemd ",
    "!'l",
    "的a1 。，　\xa0\r\n'",
    "😀👍🏽é́ñ x",
    "=-_*#",
    " \u0085 \x1c\x1dab",
    "abcdefghijklmnopqrstuvwxyz",
]


@pytest.fixture(scope="module")
def enc():
    return encoding(VOCABULARY)


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_any_cut(enc, alphabet):
    rng = random.Random(alphabet)
    for length in [2, 3, 5, 17, 60, 300, 3000]:
        for _ in range(60 if length < 300 else 8):
            text = "".join(rng.choice(alphabet) for _ in range(length))
            cut = rng.randrange(1, length)
            for width in (1, 4, 32):
                assert join(enc.encode_ordinary(text[:cut]), enc.encode_ordinary(text[cut:]), enc, width) == enc.encode_ordinary(text), (text, cut, width)


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("leaf", [7, 64, 1000])
def test_tree(enc, alphabet, leaf):
    rng = random.Random(leaf)
    for length in (leaf, leaf + 1, 5 * leaf, 9000):
        text = "".join(rng.choice(alphabet) for _ in range(length))
        parts = halves(text, leaf)
        assert "".join(parts) == text and max(map(len, parts)) <= leaf
        assert join_all([enc.encode_ordinary(p) for p in parts], enc) == enc.encode_ordinary(text)


def test_long_run_is_joined_without_encoding_it_all(enc):
    """Deep inside one word, agreement at both ends ends the growth."""
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40000))
    seen = []

    class Counting:
        def __getattr__(self, name):
            if name != "encode_ordinary":
                return getattr(enc, name)
            return lambda t: seen.append(len(t)) or enc.encode_ordinary(t)

    assert join(enc.encode_ordinary(text[:20000]), enc.encode_ordinary(text[20000:]), Counting()) == enc.encode_ordinary(text)
    assert max(seen) < 5000


def test_empty_sides(enc):
    assert join([], [5, 6], enc) == [5, 6] and join([5], [], enc) == [5] and join_all([], enc) == []
