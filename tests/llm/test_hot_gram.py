"""A line that stands between different neighbours in many documents."""

import random

import numpy as np
import pytest

from fundamentals_spark.llm import repeats
from test_repeats import plain, result


@pytest.mark.parametrize("length", [60, 98, 130])
def test_line_between_different_neighbours(spark, monkeypatch, length):
    monkeypatch.setattr(repeats, "SORT_ROWS", 20)
    sort = repeats.covered

    def counted(group, *rest):
        n = np.unique(group, return_counts=True)[1].max(initial=0)
        assert n <= 20, f"{n} contexts of one gram in one task"
        return sort(group, *rest)

    monkeypatch.setattr(repeats, "covered", counted)
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    line = text(length)
    rows = [(k, text(70 + k % 5) + line + (text(2) if k % 2 else text(90))) for k in range(150)] + [(500, None), (501, line * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(df) == plain(rows)
