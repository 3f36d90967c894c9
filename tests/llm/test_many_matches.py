"""Texts with tens of thousands of matches: the same results, without a cost that grows with their square."""

import random
import time

from pyspark.sql import functions as F

from fundamentals_spark.llm import license_scan, privacy


def test_personal_data_and_redaction(spark):
    rng = random.Random(4)
    parts, spans, at = [], [], 0
    for k in range(30_000):
        gap, mail = "é" * rng.randrange(1, 4) + " ", f"u{k}@h{k % 7}.example.org"
        parts += [gap, mail]
        spans.append((at + len(gap), at + len(gap) + len(mail)))
        at += len(gap) + len(mail)
    text = "".join(parts) + " end"
    df = spark.createDataFrame([(1, text), (2, None), (3, "a@b.c 1.2.3.4")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in privacy.find_personal_data(df).collect()}
    assert got == {1: [("email", a, b) for a, b in spans], 2: [], 3: [("email", 0, 5), ("ip", 6, 13)]}
    out, name = privacy.with_spans(df)
    clean = {r.doc_id: r.x for r in out.select("doc_id", privacy.redacted("text", name).alias("x")).collect()}
    assert clean == {1: "".join(p if k % 2 == 0 else "<EMAIL>" for k, p in enumerate(parts)) + " end", 2: None, 3: "<EMAIL> <IP>"}
    assert time.monotonic() - began < 60


def test_spans_over_block_borders_join(spark):
    spans = [("a", 0, 2)] + [("b", k, k + 3) for k in range(1, 400)] + [("c", 402, 403), ("d", 405, 406)]
    df = spark.createDataFrame([("x" * 410, [dict(zip(("kind", "start", "end"), s)) for s in spans])], "text string, s array<struct<kind:string,start:int,end:int>>")
    text, at, out = "x" * 410, 0, ""
    for kind, a, b in spans:
        if a >= at:
            out, at = out + text[at:a] + f"<{kind.upper()}>", b
        else:
            at = max(at, b)
    assert df.select(privacy.redacted("text", "s").alias("o")).first().o == out + text[at:]


def test_licence_notices(spark):
    notice = dict(license_scan.TEMPLATES)["mpl-2"]
    words = len(notice.replace("/", " ").replace(":", " ").replace(".", " ").split())
    began = time.monotonic()
    r = license_scan.scan_licenses(spark.createDataFrame([(1, (notice + " ") * 4000)], "doc_id long, text string")).first()
    assert r.labels == "mpl-2" and len(r.spans) == 4000 and abs(r.n_words / 4000 - words) < 4 and time.monotonic() - began < 60


def test_licences_by_paragraph_and_version(spark):
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    texts = [gnu, gnu.replace("version 2", "version 3"), "This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select(F.split("labels", ",").alias("l")).collect()
    assert [r.l for r in rows] == [["gpl-2"], ["gpl-3"], ["cc-by"], ["unlicense"]]
