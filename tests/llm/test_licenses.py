"""Licence spans: chains against all subsets of matches, whole texts, look-alikes, spans by brute force."""

import random
from itertools import combinations

import pytest

from fundamentals_spark.llm import license_scan as L

ALL = [L._MIT, L._APACHE, L._ISC]


def plain_best(found, max_gap):
    best = 0
    for k in range(1, len(found) + 1):
        for part in combinations(sorted(found), k):
            cover, ok = part[0][1], True
            for (e0, _, t0), (e, n, t) in zip(part, part[1:]):
                over = max(0, e0 - (e - n), t0 - (t - n))
                ok &= e - n - e0 <= max_gap and e0 < e and t0 < t and over < n and t - n - t0 <= max_gap
                cover += n - over
            best = max(best, cover if ok else 0)
    return best


def test_best_chain_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(300):
        found = list({(rng.randrange(5, 40), rng.randrange(1, 6), rng.randrange(5, 40)) for _ in range(rng.randrange(1, 8))})
        got = L.chains(found, 1, 4)
        assert got[0][0] == plain_best(found, 4)
        assert all(b[1] >= a[2] or b[2] <= a[1] for a, b in combinations(got, 2))
    assert L.chains([], 1) == []


def scan(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for r in sorted(L.scan_licenses(df, **kw).collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("whole", [True, False])
def test_labels(spark, whole):
    cases = [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
        ("You may obtain a copy of the License at the town hall when it opens.", ""), ("Permission is hereby granted, free of charge, to any person obtaining a badge.", ""),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
         "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "lgpl-2.1"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3"), ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        (f"Copyright 2001 A. Nobody\n{L._MIT}", "mit"), (f"{L._BSD_TOP} {L._BSD_END}", "bsd-2"), (f"{L._BSD_TOP} {L._BSD_NAMES} {L._BSD_END}".replace("COPYRIGHT HOLDERS", "REGENTS"), "bsd-3"), (L._ISC, "isc"), (L._MPL, "mpl-2"),
        (f"{L._MIT} and then {L._ISC}", "isc,mit"), ("permission notice of a public concert", ""), ("", ""), (None, ""),
    ]
    pad = " ".join(f"word{i}" for i in range(40)) if whole else ""
    for (text, want), r in zip(cases, scan(spark, [None if t is None else f"{pad} {t} {pad}" for t, _ in cases]), strict=True):
        assert r.labels == want, (text, r.labels)
        assert (r.cover > 0) == bool(r.spans) and r.cover <= 1
        assert ",".join(sorted({s.label for s in r.spans})) == want
        for s in r.spans:
            assert (40 if whole else 0) <= s.start < s.end <= r.n_words - (40 if whole else 0)


def test_spans_by_brute_force(spark):
    """Short templates whose whole appearance is searched word by word."""
    rng = random.Random(2)
    templates = (("a", "one two three four five six"), ("b", "three four five six seven eight nine"), ("c", "alpha beta gamma delta epsilon"))
    texts = []
    for _ in range(60):
        parts = [rng.choice(["one two three four five six", "three four five six seven eight nine", "one two three four five six seven eight nine", "alpha beta gamma delta epsilon", "x", "y z", "one two", "beta gamma delta"]) for _ in range(rng.randrange(6))]
        texts.append(" q ".join(parts))
    for text, r in zip(texts, scan(spark, texts, templates=templates, phrases=(), min_share=1.0, min_cover=5)):
        words, claims = text.split(), []
        for label, t in templates:
            t = t.split()
            claims += [(-len(t), label, i, i + len(t)) for i in range(len(words) - len(t) + 1) if words[i : i + len(t)] == t]
        kept = []
        for n, label, lo, hi in sorted(claims, key=lambda c: (c[0], c[1], c[2])):
            if all(hi <= a or lo >= b for _, a, b in kept):
                kept.append((label, lo, hi))
        assert [(s.label, s.start, s.end) for s in r.spans] == sorted(kept, key=lambda k: k[1])
        assert r.labels == ",".join(sorted({k[0] for k in kept})) and r.score == r.cover == (1.0 if kept else 0.0)
