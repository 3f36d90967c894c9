"""Near duplicates against all pairs."""

import random
import re
from collections import Counter

import pytest

from fundamentals_spark.llm import neardup
from fundamentals_spark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain(rows, similarity=0.8):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 10 >= (len(sets[i]) + len(sets[j]) - both) * 8:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return Counter((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def family(rng, i, size, words=120, edits=3):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((i * 1000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 9])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(5)
    rows = [r for i in range(8) for r in family(rng, i + 1, 12, words=40 + 30 * i, edits=4)]
    rows += [(9000, None), (9001, ""), (9002, "a b c"), (9003, "a  b\nc"), (9004, "a b d"), (1001, rows[0][1]), (None, rows[0][1]), (9005, "  "), (9006, "z " * 5000), (9007, "z " * 4000), (None, "alone text here is not a copy of any")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, k1 int, comp string")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == plain(rows)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, neardup.near_duplicates(docs).collect())) == plain(rows)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_depth_is_shortened_until_the_recall():
    d = neardup.prefix_depth(0.8)
    assert 1 - (1 - 0.8**d) ** neardup.TREES >= neardup.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** neardup.TREES


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 7), (200, 200), (None, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 110: 100, 120: 100, 200: 200}
