"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fundamentals_spark.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, share=50):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(b >= least and len(x) == 3 and l == lang and w in (x[:2], x[1:]) and 100 * b >= share * a for (l, x), b in f.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "cat", "sat", "mat", "é", "ÉT", "x-y", "a", "\u00a0", "日本"]
    rows = []
    for _ in range(n):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " the cat sat "]) for _ in range(rng.randrange(0, 60)))
        rows.append((body, rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), ("...", "fr"), (None, None)] + [("new york city " * 400, "en")] * 2


@pytest.mark.parametrize("split", [1, 8192, 10**9])
def test_equal_to_plain_counts(spark, monkeypatch, split):
    monkeypatch.setattr(collocations, "SPLIT", split)
    rows = texts(split)
    docs = spark.createDataFrame([(*r, "p", 7) for r in rows], "text string, lang string, phrase string, n int")
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=5, top=20).collect())
    assert got == plain(rows, 5, 20) and len(got) > 30


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_exact_beyond_64_bits(spark):
    """10**6 a a passes 2**63 from three million occurrences on; here by weight of the decimals alone."""
    a, l, r = 4_000_000_000, 7_999_999_999, 4_000_000_001
    q = "(cast(1000000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(f"{q} as s").first()["s"] == 10**6 * a * a // (l * r)


def test_multikey_quicksort_counts():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 6, (4000, 3)) ** 2
    keys[:, 2] *= keys[:, 1] > 0
    weight = rng.integers(1, 4, 4000)
    want = Counter()
    for row, w in zip(keys.tolist(), weight.tolist()):
        for d in (1, 2, 3):
            if all(row[:d]):
                want[tuple(row[:d])] += w
    got = {tuple(keys[r, :d].tolist()): int(n) for d, rows, total in collocations.multikey_counts(keys, weight, 40) for r, n in zip(rows, total)}
    assert got == {k: n for k, n in want.items() if n >= 40}
