"""Repeats that end where texts end, one or a few bytes too short to be removed, and just long enough."""

import random

import pytest

from bandwright.llm.suffixes import difference_cover, remove_repeats
from tests.llm.test_operators import sentence, stripped


@pytest.mark.parametrize("length", [20, 64, 150, 400])
def test_alike_ends_of_all_lengths_of_text(spark, length):
    draw, texts = random.Random(length), []
    for k in range(difference_cover((length + 1) // 3)[0]):
        for short in (2, 1, 0):
            end = sentence(draw, length)[: length - short]
            texts += [(sentence(draw, 40)[: 60 + k] + mark + end) for mark in "|/"]
    rows = list(enumerate(texts))
    want = stripped(texts, length)
    assert [w[1] for w in want] == [0, 0, 0, 0, length, length] * (len(texts) // 6)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(want))
