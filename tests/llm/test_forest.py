"""The LSH forest's subtries, stars of near copies, hubs in components, and recall at the threshold."""

import random
from collections import Counter

import numpy as np
import pytest

from fundamentals_spark.llm import components as comp
from fundamentals_spark.llm import neardup
from test_neardup import plain


def test_subtrie_groups_are_what_sketches_join():
    rng = np.random.default_rng(2)
    for m in (1, 2, 7, 40):
        base = rng.integers(0, 256, (3, 64)).astype(np.uint8)
        sketch = base[rng.integers(0, 3, m)]
        noise = rng.random(sketch.shape) < rng.random((m, 1)) * 0.4
        sketch = np.where(noise, rng.integers(0, 256, sketch.shape), sketch).astype(np.uint8)
        sketch[:, 8:12] = 7  # the shortest prefix of tree 1
        root = list(range(m))
        for _ in range(m):
            for i in range(m):
                for j in range(m):
                    if (sketch[i] == sketch[j]).sum() >= 42:
                        root[i] = root[j] = min(root[i], root[j])
        assert neardup.trie_groups(sketch, 1, 8, 4, 42).tolist() == root


@pytest.mark.parametrize("block", [1024, 16])
def test_star_and_template(spark, block, monkeypatch):
    """One centre whose copies differ from each other, and texts that share a third of their words."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(3)
    centre = [f"c{i}" for i in range(200)]
    rows = [(1, " ".join(centre))]
    for k in range(60):
        w = list(centre)
        at = rng.randrange(0, 180)
        w[at : at + 14] = [f"s{k}_{i}" for i in range(14)]
        rows.append((10 + k, " ".join(w)))
    rows += [(1000 + k, " ".join(centre[:70] + [f"t{k}_{i}" for i in range(140)])) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == plain(rows)


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity lies just over the threshold are all found."""
    rng = random.Random(4)
    rows = []
    for k in range(300):
        w = [f"k{k}_{i}" for i in range(104)]
        v = list(w)
        v[rng.randrange(5, 98)], v[0] = "x", "y"  # 6 of 100 shingles differ
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) == 300


def test_hubs_in_components(spark):
    edges = [(5, i) for i in range(3000, 6500)] + [(i, 6500) for i in range(6501, 8000)] + [(6499, 6500)]
    got = dict(map(tuple, comp.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert set(got.values()) == {5} and len(got) == len({x for e in edges for x in e})
    with pytest.raises(RuntimeError):
        comp.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), most_rounds=1)
