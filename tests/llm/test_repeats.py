"""Removal of repeated strings against a plain search over all strings."""

import random
from collections import Counter

import numpy as np
import pytest

from fundamentals_spark.llm import repeats


def plain(rows):
    """rows of (doc_id, text); ids differ."""
    docs = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0]))
    first, out = {}, Counter()
    for i, raw in docs:
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - repeats.LENGTH + 1):
            key = raw[s : s + repeats.LENGTH]
            if first.setdefault(key, (i, s)) != (i, s):
                gone[s : s + repeats.LENGTH] = True
        kept = bytes(np.frombuffer(raw, dtype=np.uint8)[~gone]) if raw else b""
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(raw), int(gone.sum()), runs, kept)] += 1
    return out


def result(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(df).collect())


def rows_of(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, line = text(400), text(90)
    rows = [(1, text(300)), (2, None), (3, ""), (4, "a" * 700), (5, "xy" * 300), (6, text(99)), (7, passage), (8, text(50) + passage[37:290] + text(80)), (9, passage[:150] + "#" + passage[150:])]
    rows += [(10 + k, text(60) + line + text(60)) for k in range(12)] + [(40 + k, text(rng.randrange(40)) + passage[k : k + 99 + k % 4] + text(30)) for k in range(40)]
    base = text(500)
    for k in range(15):
        b = list(base)
        for _ in range(k % 4):
            b[rng.randrange(500)] = "Z"
        rows.append((100 + k, "".join(b)))
    rows += [(200, rows[0][1]), (201, "a" * 650 + text(20)), (None, passage), (300, passage[:100]), (301, passage[100:200] + passage[:100])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [1 << 20, 600])
def test_against_all_strings(spark, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(repeats, "SORT_ROWS", 50)
    rows = rows_of(chunk)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id int, text string, g int, spans string").repartition(3)
    assert result(df) == plain(rows)


def test_shared_ids(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(1, t), (1, t), (2, t[:150]), (2, "q" + t[100:]), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert got == [(1, 300, 0), (1, 300, 0), (2, 150, 150), (2, 201, 200), (3, 0, 0)]
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_sorted_suffixes_against_sorted():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 300).astype(np.uint8)
    start = rng.integers(0, 280, 200)
    length = np.minimum(rng.integers(0, 25, 200), 300 - start)
    group = rng.integers(0, 4, 200)
    s = repeats.Suffixes(buf, start, length)
    order = s.sort(group)
    text = lambda i: (group[i], buf[start[i] : start[i] + length[i]].tobytes())
    assert [text(i) for i in order] == sorted(text(i) for i in range(200))
    for k, n in enumerate(s.neighbours(order, group)):
        if n >= 0:
            a, b = text(order[k - 1])[1], text(order[k])[1]
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
