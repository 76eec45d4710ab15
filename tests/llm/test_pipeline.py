"""run() against the same five stages in plain Python, on the smallest tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import corpus_pipeline
from folioweave.llm import bpe, mixing, quality_rules, secrets, simhash

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect() if quality_rules.judge(r.text, field)[6]}
    ids = sorted(rows)
    prints = dict(zip(ids, (int(x) & (2**64 - 1) for x in simhash.fingerprints([rows[i].text for i in ids])), strict=True))
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    ids = [i for i in ids if root[i] == i]
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in secrets.scan(spark, SF).collect()}

    def redact(text, found):
        out, at = "", 0
        for a, b in sorted(found):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    texts = {i: redact(rows[i].text or "", spans[i]) for i in ids}
    size = Counter()
    for i in ids:
        size[rows[i].source] += len(texts[i])
    weight = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    own, expected = bpe.codec(bpe.default_path()), Counter()
    for i in ids:
        rate = mixing.EPOCHS * sum(size.values()) * weight[rows[i].source] / (sum(weight.values()) * size[rows[i].source])
        assert rate < mixing.RATE_STEP
        u = int(hashlib.md5(f"{mixing.SEED}:1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        if n:
            expected[i, tuple(own.tokenizer.encode(texts[i], add_special_tokens=False).ids)] += n
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == expected and len(got) > 20


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
