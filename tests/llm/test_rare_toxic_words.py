"""Toxic words of which each stands in few of the toxic documents."""

import numpy as np

from fundamentals_spark.llm import toxicity


def test_varied_words_and_a_rare_class():
    rng = np.random.default_rng(1)
    for n, rate, words in ((4000, 0.11, 200), (6000, 0.03, 60)):
        toxic = rng.random(n) < rate
        rows, feats, values = [], [], []
        for i in range(n):
            f = rng.zipf(1.3, 60) % 3000
            if toxic[i]:
                f = np.concatenate([f, 10_000 + rng.integers(0, words, 4)])
            u, c = np.unique(f, return_counts=True)
            rows.append(np.full(len(u), i))
            feats.append(u)
            values.append(np.log1p(c))
        row, feat, value = map(np.concatenate, (rows, feats, values))
        label = (toxic ^ (rng.random(n) < 0.02 * (rate > 0.1))).astype(np.int64)
        held = np.arange(n) >= 3 * n // 4
        train = ~held[row]
        y = label[~held]
        model = toxicity.fit_ordinal(row[train], feat[train], value[train], toxicity.grade_labels(row[train], feat[train], y))
        found = model.above(np.bincount(row, weights=model.weights[feat] * value, minlength=n))[:, 0] >= toxicity.DECISION
        assert found[held & toxic].mean() > 0.8
        assert found[held & ~toxic].mean() < 0.02
