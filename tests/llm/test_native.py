"""Quality rules, personal data and mixing against plain Python versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from fundamentals_spark.llm import mixing, privacy, quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__q_words` int, spans string"
LINE = "one two three four five six seven eight nine ten"
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a@b.c_d@e.f x@y a.b@c-d.e.f@g.h"), (5, "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 999999999999.1.1.1"),
    (6, "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 12345678901234567890123"), (7, "+1 (212) 555-0100 or +49 30 123456 +12"), (8, "\n".join([LINE] * 30)), (8, "\n".join([LINE] * 30)),
    (9, "é" * 3 + " ñ@x.yz ü😀 mail q@w.er"), (10, "1 " * 20000), (11, "@a" + ".a" * 20000 + " b@a" + ".a" * 20000), (12, "9" * 50000), (13, "GB82 WEST 1234 5698 7654 32 is my IBAN"),
    (None, "word " * 40), (14, "x y  z"), (15, " ".join(f"w{i}" for i in range(7))), (16, LINE + " " + LINE), (17, "ssn 123-45-6789"), (18, "%%% " * 30),
]


def documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [(*r, 1, "s") for r in rows] + [(i if i is None else i + 10**6, t, "en", None if k % 3 else "src0", 0, 1, "s") for k, (i, t) in enumerate(EDGE)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def base_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_quality(spark):
    rows, df = documents(spark)
    got = quality.quality_rules(df).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r[0], *base_quality(r[1])) for r in rows)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.quality_rules(df.limit(0)).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def test_pii(spark):
    rows, df = documents(spark)
    df.createOrReplaceTempView("pii_docs")
    found = privacy.find_personal_data(df)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append([(s.start, privacy.BASE.index(s.kind), s.end, s.kind) for s in r.spans if s.kind in privacy.BASE])
        if r.doc_id == 10**6 + 13:
            assert [s.kind for s in r.spans] == ["iban"] and r.spans[0].score > 0.5
        if r.doc_id == 10**6 + 17:
            assert [s.kind for s in r.spans] == ["ssn"]
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(base_pii(r[1]))
    assert got == want
    assert privacy.find_personal_data(df.limit(0)).count() == 0
    out, name = privacy.with_spans(df)
    red = {r[0]: r[1] for r in out.select("doc_id", privacy.redacted("text", name)).collect()}
    assert red[10**6 + 9] == "ééé ñ@x.yz ü😀 mail <EMAIL>"
    assert red[10**6 + 1] is None


def test_pii_query_digest(spark):
    got = {r.doc_id: r for r in queries.op4_pii(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = base_pii(r.text)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[r.doc_id].n_email == sum(s[3] == "email" for s in spans)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w, total, full = {s: 1 + i % 3 for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        t = {s: 3.0 * sizes[s] if s in full else left * w[s] / free for s in names}
        over = {s for s in names if s not in full and t[s] > 3 * sizes[s]}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("block,shard", [(512, 1024), (16, 7)])
def test_mixing(spark, block, shard):
    rows, df = documents(spark)
    got = mixing.mix_sources(df, block_words=block, shard_slots=shard).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    target, by_source = plain_targets(size), defaultdict(Counter)
    of = {r[0]: r[3] for r in rows}
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        by_source[s][0] += r.taken
    for s in size:
        assert abs(by_source[s][0] - target[s]) <= 1
    again = mixing.mix_sources(df.repartition(3), block_words=block, shard_slots=shard).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        xs = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(xs) == list(range(n))
