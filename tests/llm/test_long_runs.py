"""Runs of white space of millions of characters, packed and given back."""

import random

import pytest

from verdigraph.llm import packing
from verdigraph.llm.queries import packing_vocabulary

RUNS = {"spaces": " ", "tabs": "\t", "line ends": "\n", "mixed": " \t\n\u3000\x85"}


@pytest.mark.parametrize("n", [1_000_000, 5_000_000])
@pytest.mark.parametrize("kind", RUNS)
def test_long_white_space_comes_back(kind, n):
    coder = packing_vocabulary().encoder()
    run = (RUNS[kind] * n)[:n]
    for text in (run, f"{run}x", f"one{run}", f"one{run}two {run[: n // 2]} 3"):
        assert coder.decode(coder(text).tolist()) == text


def test_pieces_are_the_patterns():
    """With short runs cut as long ones are, ids are those of the pattern."""
    short, plain = packing.Encoder(packing_vocabulary(), 3), packing_vocabulary().encoder().split
    rng = random.Random(4)
    parts = ["a", "word", "12", "'s", "!", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\u3000", "\u180e", "\u200b", "é", "漢"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert short(text).tolist() == plain.encode_ordinary(text), repr(text)


def test_pack_long_white_space(spark):
    rows = [(1, " " * 2_000_000), (2, "a" + "\n" * 3_000_000 + "b"), (3, "plain")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing_vocabulary()).collect()
    coder = packing_vocabulary().encoder()
    assert sorted((d, coder.decode(t.tolist())) for d, t in packing.unpack(got).values()) == rows
