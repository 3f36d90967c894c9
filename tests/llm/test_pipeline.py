"""The pipeline's stages against plain versions of their decisions."""

from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from fundamentals_spark.llm import bpe, mixing, privacy, quality, queries
from test_neardup import plain as plain_classes
from test_native import WORD, base_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(900001, None, "en", None, None), (900002, "", "en", "src0", 0), (None, "mail a@b.cd " + " ".join(f"u{i} the" for i in range(30)), "en", "src1", 5)]
    docs = docs.union(spark.createDataFrame(extra * 2, docs.schema))
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs_in = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append((docs_in.collect(), docs.collect()))
        if k < 4:
            assert docs.columns == docs_in.columns
    # quality: what stays is what the rules keep
    before, after = outs[0]
    kept = {r.doc_id for r in quality.quality_rules(docs_from(spark, before)).filter("kept").collect()}
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r in before if r.doc_id in kept)
    assert not any(base_quality(r.text)[-1] for r in after)
    # near duplicates: one of each class
    before, after = outs[1]
    classes = plain_classes([(r.doc_id, r.text) for r in before])
    assert sorted(str(r.doc_id) for r in after) == sorted({str(c) for _, c, _ in classes})
    # personal data: no confirmed span is left, clean texts are untouched
    before, after = outs[2]
    text = {r.doc_id: r.text for r in after}
    assert "mail <EMAIL> u0" in text[None]
    found = {r.doc_id: r.spans for r in privacy.find_personal_data(docs_from(spark, before)).collect()}
    assert all(text[r.doc_id] == r.text for r in before if not found[r.doc_id])
    assert all(r.n_chars == len(r.text) for r in after)
    # mixing: copies are what the mix takes of a document, up or down to whole ones, and each source's words meet its target to its longest row
    before, after = outs[3]
    mixed = {r.doc_id: r for r in mixing.mix_sources(docs_from(spark, before)).collect()}
    n, source = Counter(r.doc_id for r in after), {r.doc_id: r.source for r in before}
    assert all(abs(n[d] - r.taken / r.size) < 1 for d, r in mixed.items() if r.size)
    words, longest, target = Counter(), Counter(), {}
    for d, r in mixed.items():
        words[source[d]] += n[d] * r.size
        longest[source[d]] = max(longest[source[d]], r.size)
        target[source[d]] = r.target
    assert all(abs(words[s] - t) <= longest[s] + 1 for s, t in target.items())
    assert Counter(map(tuple, set(map(tuple, after)))) <= Counter(map(tuple, before))
    # tokens
    before, after = outs[4]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(queries.VOCABULARY))}, special_tokens={})
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in after) == Counter((r.doc_id, len(ids := library.encode_ordinary(r.text)), tuple(ids)) for r in before)
    assert sum(len(WORD.findall(r.text)) for r in before) > 0


def docs_from(spark, rows):
    return spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)


def test_empty_and_run(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 50
