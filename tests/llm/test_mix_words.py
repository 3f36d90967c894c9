"""Whole copies of the mix against the words that each source is to give."""

import random
from collections import defaultdict

from fundamentals_spark.llm import mixing


def test_even_copies_meet_the_targets(spark):
    rng = random.Random(5)
    sources = ["hot"] * 120 + [f"s{k % 9}" for k in range(240)]
    rows = [(i, "w " * (rng.randrange(1500, 4000) if k == "hot" or i % 5 == 0 else rng.randrange(1, 400)), k) for i, k in enumerate(sources)]
    rows += [(1000, None, "hot"), (1001, "", None), (1002, "a b c", None), (1003, "w " * 2000, "hot"), (1003, "w " * 2000, "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    source = {i: k for i, _, k in rows}
    kept, target, longest = defaultdict(int), {}, defaultdict(int)
    got = mixing.apply_mix(df, rounding="even").collect()
    assert len(got) == len(rows)
    for r in got:
        k = source[r.doc_id]
        kept[k] += r.copies * r.size
        target[k], longest[k] = r.target, max(longest[k], r.size)
        assert r.copies == 1 if r.size == 0 else abs(r.copies - r.taken / r.size) < 1
    assert all(abs(kept[k] - target[k]) <= longest[k] + 1 for k in target)
    assert kept["hot"] > 0.9 * target["hot"]
    # rounding each row by itself loses most of the hot source
    nearest = sum(r.copies * r.size for r in mixing.apply_mix(df).collect() if source[r.doc_id] == "hot")
    assert nearest < 0.5 * target["hot"]
