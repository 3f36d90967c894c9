"""Top-k search against all products."""

import numpy as np
import pytest

from fundamentals_spark.llm import topk


def plain(rows, k=10):
    out = set()
    vecs = {(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for i, v in vecs:
        if i % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in vecs if j != i and len(w) == len(v))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("kind", ["clustered", "mixed", "few", "large"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "clustered":
        base = rng.normal(size=(20, 8))
        v = np.repeat(base, 12, axis=0) * rng.uniform(0.2, 3, size=(240, 1)) + rng.normal(size=(240, 8)) * 0.02
    elif kind == "mixed":
        v = rng.normal(size=(250, 6)) * rng.lognormal(sigma=1.5, size=(250, 1))
        v[100:140] = v[100]
        v[200] = 0
    elif kind == "few":
        v = rng.normal(size=(5, 4))
    else:
        v = rng.normal(size=(60, 4)) * 1e4
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(900, None), (903, [None] * v.shape[1]), (906, [float("nan")] * v.shape[1]), (909, [float("inf")] + [0.0] * (v.shape[1] - 1)), (None, v[0].tolist()), rows[0]]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<double>, norm int, part string")
    topk_rows = topk.top_k(df.filter("vec_id % 3 = 0"), df)
    got = [tuple(r) for r in topk_rows.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_parts_and_empty(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_ROWS", 16)
    monkeypatch.setattr(topk, "SEED_ROWS", 15)
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(120, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df.filter("vec_id % 3 = 0"), df).collect()} == plain(rows)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
