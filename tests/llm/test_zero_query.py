"""Top-k for a query vector of length 0 beside others, with candidates beyond the seeds."""

import numpy as np

from fundamentals_spark.llm import topk
from test_topk import plain


def test_zero_query_beside_others(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 16)
    monkeypatch.setattr(topk, "SEED_ROWS", 40)
    rng = np.random.default_rng(6)
    v = np.abs(rng.normal(size=(150, 4))) * rng.uniform(0.02, 0.1, size=(150, 1))
    v[100:] *= 100  # the seeds have the largest ids
    v[0], v[3], v[7] = 0, 1 / 2048, 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df.filter("vec_id % 3 = 0"), df).collect()}
    assert got == plain(rows)
    assert {j for i, _, j, _ in got if i == 0} == set(range(1, 11))
