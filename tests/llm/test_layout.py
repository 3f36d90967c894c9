"""The secret field does not depend on partitions; its likelihood against all tag sequences; short rows."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundamentals_spark.llm import secret_scan as S


def test_two_layouts_give_equal_models_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, "x"), (10**7, None), (10**7 + 1, "token = abcdefgh12345678")], docs.schema))
    one, many = docs.repartition(1), docs.repartition(7, F.xxhash64("text"))
    a, b = S.train_secrets(one), S.train_secrets(many)
    assert (a.weights == b.weights).all() and (a.moves == b.moves).all()
    assert (a.weights[S.MASKED] == 0).all() and a.weights.any()
    spans = lambda df, m: sorted((str(r.doc_id), str(r.spans)) for r in S.scan_secrets(df, m).collect())
    assert spans(one, a) == spans(many, b)


def test_windows_of_short_rows():
    import pyarrow as pa
    from fundamentals_spark.llm import bytehash

    tok = S.tokens_of(*bytehash.text_buffer(pa.array(["token = abcdefgh", "", None, "a b " * 20])))
    tag = np.full(len(tok.start), S.OUTSIDE, dtype=np.int8)
    tag[1] = S.BEGIN
    feats, tags = S._windows(tok, tag, np.arange(4, dtype=np.uint64))
    at = np.flatnonzero((tags == S.BEGIN).any(axis=1))
    assert len(at) == 1 and (feats[at[0], 2:] == S.PAD).all() and tags[at[0], 1] == S.BEGIN
    assert S._windows(S.tokens_of(np.zeros(0, dtype=np.uint8), np.zeros(2, dtype=np.int64)), tag[:0], np.zeros(1, dtype=np.uint64))[0].shape[0] == 0


def test_fit_is_maximum_likelihood(monkeypatch):
    monkeypatch.setattr(S, "N_FEATURES", 6)
    monkeypatch.setattr(S, "MASKED", 5)
    rng = np.random.default_rng(3)
    feats, tags, l2 = rng.integers(0, 5, (4, 3, 2)), rng.integers(0, 3, (4, 3)), 0.05

    def loss(w, t):
        total = 0.0
        for f, y in zip(feats, tags):
            e = w[f].sum(axis=1)
            score = lambda s: sum(e[i, s[i]] for i in range(3)) + sum(t[s[i], s[i + 1]] for i in range(2))  # noqa: B023,E731
            total += np.log(sum(np.exp(score(s)) for s in product(range(3), repeat=3))) - score(y)
        return total / len(feats) + l2 * (w**2).sum() / 2 + 10 * l2 * (t**2).sum() / 2

    m = S.fit_crf(feats, tags, steps=4000, l2=l2)
    for x in (m.weights, m.moves):
        for i in np.ndindex(x.shape):
            if x is m.weights and i[0] == 5:
                continue
            kept, v = x[i], []
            for d in (1e-5, -1e-5):
                x[i] = kept + d
                v.append(loss(m.weights, m.moves))
            x[i] = kept
            assert (v[0] - v[1]) / 2e-5 == pytest.approx(0, abs=2e-3)
