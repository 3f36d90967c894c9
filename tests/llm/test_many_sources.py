"""Mixing with many sources, and a hot id; blocks of queries cut by bytes."""

import random
from collections import defaultdict

import numpy as np
import pytest

from fundamentals_spark.llm import mixing, topk
from test_topk import plain


def test_ten_thousand_sources(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 4), f"s{i:05d}") for i in range(10_000)] + [(20_000 + i, "w " * 900, "hot") for i in range(60)]
    rows += [(None, "w " * rng.randrange(1, 900), "hot") for _ in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    taken, target = defaultdict(int), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
    assert len(target) == 10_001
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(r.size for r in got) == pytest.approx(sum(target.values()))


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_blocks_by_bytes(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 400)
    monkeypatch.setattr(topk, "PART_ROWS", 20)
    monkeypatch.setattr(topk, "SEED_ROWS", 15)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(150, 5)) * rng.lognormal(sigma=spread, size=(150, 1))
    v[30:60] = v[30]
    v[60] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df.filter("vec_id % 3 = 0"), df).collect()} == plain(rows)
