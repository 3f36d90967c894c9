"""Spelling variants against a plain version over all pairs."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from fundamentals_spark.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}


def plain(words):
    links = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in links.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 2 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(links[w]), words[form[w]] if w in form else None) for w, n in words.items()}


WORDS = {
    "colour": 40, "color": 9, "colours": 20, "colors": 4, "colur": 3, "cólour": 3, "aaaaa": 12, "aaaaaa": 6, "aaaaaaa": 3, "abaaa": 24, "bcdef": 5, "acdef": 5, "zcdef": 11, "bcdefg": 11, "bcdeg": 3, "ébcdef": 3, "solitary": 7,
    "x" * 70: 3, "x" * 69 + "y": 9, "x" * 71: 30,
}


@pytest.mark.parametrize("leaf", [1, 2, 4, 50_000])
def test_variants_equal_all_pairs(spark, leaf):
    got = spelling.spelling_variants(spark.createDataFrame(list(WORDS.items()), "word string, n long"), leaf=leaf).collect()
    assert len(got) == len(WORDS) and {tuple(r) for r in got} == plain(WORDS)


def test_words_of_documents(spark):
    rows = [(1, "Hello hello HELLO, hellos-hellos hellos"), (2, None), (3, ""), (None, "Ärger ärger Ärger Ärger x1straße straße2straße"), (3, "a b cd"), (1, "Hello hello HELLO, hellos-hellos hellos")]
    rows += [(k, "wordy wordy longer") for k in range(200)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, w string, n int")
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert got == plain_words(rows) and len(got) > 5  # some damaged words among them


def test_empty_table_and_repeat(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.vocabulary(empty)).count() == 0


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted(["tap", "taps", "top", "tops", "stop"])
    symbols = {c: k for k, c in enumerate(sorted(set("".join(words))))}
    a = spelling.Acceptor(words, symbols)
    for place, w in enumerate(words):
        q, at = a.start, 0
        for c in w:
            arc = a.by[q, symbols[c]]
            q, at = a.target[arc], at + a.skip[arc]
        assert a.final[q] and at == place
    rights = defaultdict(set)  # states of a minimal acceptor have different right languages
    for w in words:
        q = a.start
        for k, c in enumerate(w):
            rights[q].add(w[k:])
            q = a.target[a.by[q, symbols[c]]]
        rights[q].add("")
    assert len({frozenset(v) for v in rights.values()}) == len(rights) == len(a.final)
