"""The training-data operators against plain Python, on rows that are null, empty, long, repeated or tied, and on empty tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from folioweave.llm import bpe, media, mixing, pii, pu_quality, quality_rules, queries, secrets, simhash, tool_calls, warc
from folioweave.llm.common import Scratch
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, fp string, row string, copies int, `_row` int, base string"


def long_text(n: int, seed: int = 1) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(n))


def texts() -> list[str | None]:
    same = long_text(60, 3)
    near = same + " end"
    hexes = "".join(random.Random(2).choices("0123456789abcdef", k=40))
    mixed = "".join(random.Random(3).choices("ABCDEFGHIJKLMNopqrstuvwxyz0123456789", k=44))
    return [
        None, "", "   \n\t ", "one", "two words", same, same, near, same.upper(), "e" * 70_000, long_text(9_000, 5), "".join(random.Random(7).choices("abcdefg", k=50_000)), " " * 40_000 + "x",
        f"password = 'abcdefgh1' and token=short, token=secret:abcdefgh1 AKIA{'Q' * 16} AKIA12 {hexes}", f"key {mixed} and {mixed[:30]}", "id 123e4567-e89b-12d3-a456-426614174000 " + "donaudampfschifffahrtsgesellschaft",
        "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (555) 555-5555 iban DE89 3704 0044 0532 0130 00", "card 378282246310005 ssn 078-05-1120 " + "1" * 9_000 + " " + "a." * 9_000 + "@b" + ".c" * 9_000,
        "<|endoftext|>a<|endoftext|><|endoft" + "ext|> don't 中文字 é́ 'Re 'll  \n\n  x", "x\n" * 500, "same line here now\n" * 20, "###$$$ | a | b |\n" * 30, "ßİ   \x85 nbsp word " * 30,
    ]


@pytest.fixture(scope="module")
def tricky(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tricky"))
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "x", "y", "z", 1, 2, "b") for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, texts()[5], None, None, None, *rows[0][5:]), (None, None, None, "s1", None, *rows[0][5:])]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 1, 0), (21, 0, 0), (None, 1, 0), (10, None, 0), (99, 1, 1), (20, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "u", "same"), (2, "u\r\nX: y", "same"), (3, None, None), (4, "v", ""), (5, "w", "é" * 90_000), (5, "w", "é" * 90_000), (None, "n", "same"), (None, "n", "alone")] + [(100 + i, f"u{i}", long_text(40, i)) for i in range(300)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, 1, "assistant", None), (1, 2, "user", None), (None, 1, "assistant", "a"), (1, 1, "assistant", "zz"), (2, 4, "user", "orphan"), (3, None, "assistant", "x" * 50_000)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(1, long_text(12, 9)), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tricky, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "conversations", "benchmark"):
        spark.read.parquet(f"{tricky}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op1_secret_scans", "op2_simhash_near_dedup", "op3_quality_rules", "op5_quality_classifier", "op7_bpe", "op9_pii", "op10_media_columns"])
def test_one_row_per_document(spark, tricky, name):
    assert queries.QUERIES[name](spark, tricky).count() == spark.read.parquet(f"{tricky}/documents.parquet").count()


def rows_by_text(spark, tricky, name):
    """Rows of a query with their texts, for ids that name one text."""
    known = dict(enumerate(texts()))
    return [(known[r.doc_id], r) for r in queries.QUERIES[name](spark, tricky).collect() if r.doc_id is not None]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_secrets(spark, tricky):
    for text, r in rows_by_text(spark, tricky, "op1_secret_scans"):
        found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "", re.I | re.A) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)))
        assert set(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).split(",")) - {""} <= set(r.spans.split(","))
    by_text = dict(rows_by_text(spark, tricky, "op1_secret_scans"))
    assert "entropy_b64" in by_text[texts()[14]].spans and "entropy" not in by_text[texts()[15]].spans


@pytest.mark.parametrize("name", ["op1_secret_scans", "op9_pii"])
def test_spans_equal_their_sql(spark, tricky, name):
    for folder in (SF, tricky):
        documents = spark.read.parquet(f"{folder}/documents.parquet").toPandas()
        con = duckdb.connect()
        con.register("documents", documents)
        assert difference(queries.QUERIES[name](spark, folder), con, queries.ORACLES[name]) == ""


def test_sql_fences_meet_at_one_character(spark, tmp_path):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"]
    lines = ["iban " + " ".join(ibans), "iban é" + ",".join(ibans) + "x", "ssn 078-05-1120 078-05-1120,078-05-1120-", "ssn 078-05-1120", "x" + ibans[0] + " iban " + ibans[1]]
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.QUERIES["op9_pii"](spark, str(tmp_path))
    assert difference(df, con, queries.ORACLES["op9_pii"]) == ""
    assert df.where("doc_id = 3").first().spans == "ssn:4:15"


def test_entropy_windows_equal_brute_force(spark):
    kinds = secrets.CLASSES["entropy_b64"]
    r = random.Random(4)
    values = ["".join(r.choices(kinds[1][: r.randint(3, 60)], k=r.randint(20, 70))) for _ in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", secrets.hot_windows(F.col("v"), kinds[1], secrets.WINDOW, kinds[2]).alias("w"))
    for row in df.collect():
        hot = [i for i in range(len(row.v) - 19) if -sum(c / 20 * np.log2(c / 20) for c in (row.v[i : i + 20].count(x) for x in set(row.v[i : i + 20]))) >= kinds[2] - 1e-9]
        merged: list[list[int]] = []
        for i in hot:
            if merged and i <= merged[-1][1]:
                merged[-1][1] = i + 20
            else:
                merged.append([i, i + 20])
        assert [[w.start, w.end] for w in row.w] == merged


@pytest.mark.parametrize("kind", ["hyphens", "base64", "addresses", "passwords"])
def test_long_texts_take_linear_time(spark, tmp_path, kind):
    r = random.Random(9)
    text = {
        "hyphens": "ab-" * 40_000, "base64": "".join(r.choices(secrets.CLASSES["entropy_b64"][1], k=300_000)), "addresses": "ab@c.de " * 30_000, "passwords": "password=abcdefgh1 " * 20_000,
    }[kind]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    found = {n: queries.QUERIES[n](spark, str(tmp_path)).first() for n in ("op1_secret_scans", "op9_pii")}
    assert found["op9_pii"].n_email == text.count("@") and found["op1_secret_scans"].n_assign == text.count("password")
    assert ("entropy_b64" in found["op1_secret_scans"].spans) == (kind == "base64")
    if kind in ("passwords", "addresses"):
        out = (secrets.redact_documents if kind == "passwords" else pii.mask_documents)(docs).first().text
        assert out in ("[SECRET] " * 20_000, "[PII] " * 30_000)
    assert time.monotonic() - began < 90


def test_redaction_keeps_every_document(spark, tricky):
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    out = secrets.redact_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert [r.text for r in out.where("doc_id = 13").collect()][0].startswith("password = 'abcdefgh1'"[:0] + "[SECRET]")


def test_simhash(spark, tricky):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in enumerate(texts())}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    for r in queries.QUERIES["op2_simhash_near_dedup"](spark, tricky).collect():
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == root(r.doc_id)


def test_anchors_lose_no_link_in_dense_and_blocked_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 6, dtype=np.int64)
    fps = [int(b) for b in base]
    for b in base:
        for _ in range(60):
            flips = r.choice(64, r.integers(1, 6), replace=False)
            fps.append(int(np.int64(b) ^ np.bitwise_or.reduce(np.left_shift(np.uint64(1), flips.astype(np.uint64))).astype(np.int64)))
    fps = sorted(set(fps))
    got = {x.node: x.root for x in simhash.components(simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    v = np.array(fps, dtype=np.int64).view(np.uint64)
    label = np.arange(len(v))
    for i in range(len(v)):
        met = np.unique(label[np.bitwise_count(v ^ v[i]) <= 4])
        label[np.isin(label, met)] = met[0]
    groups, expected = {}, {}
    for f, c in zip(fps, label, strict=True):
        expected.setdefault(int(c), set()).add(f)
        groups.setdefault(got.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(51)}) == 1 and len({got[i] for i in range(100, 130)}) == 1 and got[0] != got[100]


def test_deduplication_keeps_one_of_each_group(spark, tricky):
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    out = simhash.deduplicate_documents(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(5) == 1 and not {6, 8} & set(ids) and ids.count(None) == 2


def test_quality_rules(spark, tricky):
    for text, r in rows_by_text(spark, tricky, "op3_quality_rules"):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = {}
        for g in grams:
            n[g] = n.get(g, 0) + 1
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), dup, len(covered))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r.base_failed and r.kept)


def test_viterbi_equals_enumeration():
    r = random.Random(6)
    for _ in range(60):
        n = r.randint(1, 9)
        field = quality_rules.Field((), tuple(tuple(r.uniform(-1, 1) for _ in range(2)) for _ in range(2)))
        scores = [r.uniform(-2, 2) for _ in range(n)]
        total = lambda y: sum(s for s, l in zip(scores, y, strict=True) if l) + sum(field.transition[a][b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, E741, B023
        best = max(total([k >> i & 1 for i in range(n)]) for k in range(2**n))
        assert abs(total(quality_rules.viterbi(field, scores)) - best) < 1e-9


def test_quality_labels_are_met(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rules = [r for r in queries.QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == bool(labels[r.doc_id]) for r in rules]) > 0.97
    scored = [r for r in queries.QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    good, bad = ([r.score for r in scored if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_training_slopes_equal_numeric_ones():
    r = np.random.default_rng(5)
    k = len(quality_rules.FEATURES)
    docs = [([int(b) for b in r.integers(0, 2**k, n)], [int(x) for x in r.integers(5, 60, n)], int(y)) for n, y in zip(r.integers(1, 7, 12), r.integers(0, 2, 12), strict=True)]
    lines, w, t, tilt = quality_rules.lines_of(docs, 0.4), r.normal(0, 0.5, k), r.normal(0, 0.5, (2, 2)), r.normal(0, 1, 12)
    _, slope, slope_t, share = quality_rules.gain(lines, w, t, tilt)
    for i in range(k):
        d = np.zeros(k)
        d[i] = 1e-2
        assert abs((quality_rules.gain(lines, w + d, t, tilt)[0] - quality_rules.gain(lines, w - d, t, tilt)[0]) / 2e-2 - slope[i]) < 2e-3
    for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
        d = np.zeros((2, 2))
        d[a, b] = 1e-3
        assert abs((quality_rules.gain(lines, w, t + d, tilt)[0] - quality_rules.gain(lines, w, t - d, tilt)[0]) / 2e-3 - slope_t[a, b]) < 1e-3
    for j, (n, own) in enumerate(zip(lines.lengths, tilt, strict=True)):  # shares by enumeration of all labellings
        e = lines.x[:n, j] @ w + own
        odds = {y: np.exp(sum(x for x, l in zip(e, y, strict=True) if l) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=n)}  # noqa: E741
        assert abs(sum(v * np.dot(y, lines.sizes[:n, j]) for y, v in odds.items()) / sum(odds.values()) - share[j]) < 1e-4


def test_planted_boilerplate_in_good_documents_is_found(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    field = quality_rules.train(docs, labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    known = [(quality[r.doc_id], [x for x in r.text.split("\n") if x.split()]) for r in docs.collect() if r.doc_id in quality]
    junk = [x for q, rows in known if not q for x in rows if any(m in x for m in ("!! ", "|", "***", "&&&", "###", "$$$", "%%%"))]
    junk += ["Copyright 2020 A Company. All rights reserved.", "Home | About | Contact | Login", "Accept cookies to continue", "Click here to read more >>", "Subscribe to our newsletter!"] * 40
    rnd, planted, content = random.Random(1), [], []
    for rows in [rows for q, rows in known if q and len(rows) > 3][:60]:
        mixed = [(x, p) for i, x in enumerate(rows) for x, p in ([(x, 0)] if i % 2 else [(x, 0), (rnd.choice(junk), 1)])]
        bits = quality_rules.describe("\n".join(x for x, _ in mixed))[5]
        for (_, p), label in zip(mixed, quality_rules.viterbi(field, quality_rules.emissions(field, bits)), strict=True):
            (planted if p else content).append(label)
    assert len(planted) > 100 and np.mean(planted) > 0.95 and np.mean(content) < 0.05


@pytest.mark.parametrize("prior", [0.15, 0.4, 0.8])
def test_prior_is_found_without_negatives(prior):
    r = np.random.default_rng(7)
    n = int(4_000 * prior)
    positive, unlabelled = r.normal(1.5, 1, (3_000, 3)), np.vstack((r.normal(1.5, 1, (n, 3)), r.normal(-1.5, 1, (4_000 - n, 3))))
    assert abs(pu_quality.prior_of(positive, unlabelled[r.permutation(4_000)]) - prior) < 0.06


def test_quality_scores_equal_plain_arithmetic(spark, tricky):
    docs, labels = spark.read.parquet(f"{tricky}/documents.parquet"), spark.read.parquet(f"{tricky}/labels.parquet")
    model = pu_quality.train(docs, labels)
    for text, r in rows_by_text(spark, tricky, "op5_quality_classifier"):
        x = [max(-8, min(8, (v - m) / s)) for v, m, s in zip(plain_features(text or ""), model.mean, model.scale, strict=True)]
        score = 1 / (1 + np.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True)) + model.bias))))
        assert abs(r.score - score) < 1e-9 and r.predicted == (r.score >= 0.7)


def plain_features(text):
    """FEATURES of a text, by loops over words and characters."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip()]
    n, size, low = max(1, len(words)), max(1, len(text)), [w.lower() for w in words]
    grams = [tuple(low[i : i + 4]) for i in range(len(low) - 3)]
    upper = len([w for w in words if len(w) > 1 and w.isupper()]) / n
    runs, i = 0, 0
    while i < len(text):  # runs of two or more equal characters that are no letter, digit, blank, underscore or full stop
        j = i
        while j < len(text) and text[j] == text[i]:
            j += 1
        runs += j - i > 1 and not (text[i].isalnum() or text[i] in "_." or text[i].isspace() or re.match(r"\w", text[i]) is not None)
        i = j
    pipes = text.count("|") / n
    ends = len(re.findall(r"[.?]+(?=\s|\Z)", text))
    tail = sum(1 for w in words if not (re.match(r"\w", w[-1]) or w[-1] in ".,;:!?\"')-"))
    return [
        np.log1p(len(words)), sum(len(w) for w in words) / n / 10, upper, sum(text.count(c) for c in "#*$%&|<>{}[]\\^~_=") / size * 10, text.count("!") / n, sum(text.count(c) for c in "0123456789") / size * 10,
        len(set(low)) / n, len([w for w in words if len(w) <= 3]) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(grams)) / max(1, len(grams)), np.log1p(n / max(1, len(lines))) / 5,
        ends / n * 5, runs / n, pipes, tail / n, len([c for c in text if ord(c) > 127]) / size, float(upper > 0.2), float(runs / n > 0.05), float(pipes > 0.05),
    ]


def test_quality_features_of_a_megabyte_take_linear_time():
    for piece in (".", "?", ".x", "a", "#", "!?", "\n", "| ", "..\n"):
        began = time.time()
        pu_quality.features(piece * (1_000_000 // len(piece)) + "x")
        assert time.time() - began < 15, piece
    for text in ("a... b? c?! d.", "..", "x..y ..", "?. \n.", "end."):
        assert pu_quality.ENDS.findall(text) == re.findall(r"[.?]+(?=\s|$)", text)


def test_a_repeated_id_is_featurised_once(spark, monkeypatch):
    rows = [(i, long_text(20, i)) for i in range(300)] + [(8, long_text(20, k % 7)) for k in range(600)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    made = []

    def counting(df, sample):
        made.append((df.count(), df.select("order").distinct().count()))
        return real(df, sample)

    real = pu_quality.gathered
    monkeypatch.setattr(pu_quality, "gathered", counting)
    model = pu_quality.train(documents, labels)
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert made[1] == (len(learnt), len({i for i, _ in learnt}))  # a row of the table at most once, then one for each id
    once = [r for i, r in enumerate(rows) if r[0] != 8] + [(8, min(t for i, t in rows if i == 8))]
    assert model == pu_quality.train(spark.createDataFrame(once, "doc_id long, text string"), labels)


def test_pu_risk_learns_without_negatives():
    r = np.random.default_rng(3)
    positive, unlabelled = r.normal(1, 1, (500, 3)), np.vstack((r.normal(1, 1, (300, 3)), r.normal(-2, 1, (700, 3))))
    model = pu_quality.fit(positive, unlabelled, 0.3)
    assert (model.scores(r.normal(1, 1, (500, 3))) > 0.5).mean() > 0.85 and (model.scores(r.normal(-2, 1, (500, 3))) > 0.5).mean() < 0.05


def test_tool_calls(spark, tricky):
    rows = queries.QUERIES["op4_chat_formatting"](spark, tricky).collect()
    assert [(r.kind, r.copies, r.n_errors) for r in rows if r.conv_id is None] == [("call", 1, 1)]
    assert sorted((r.kind, "duplicate" in r.record) for r in rows if r.conv_id == "1") == [("call", False), ("call", True)]
    assert [r.kind for r in rows if r.conv_id == "2"] == ["orphan"]
    for folder in (SF, "/root/testdata/sf0.01"):
        assert difference(queries.QUERIES["op4_chat_formatting"](spark, folder), connect(folder), queries.ORACLES["op4_chat_formatting"]) == ""
    con = duckdb.connect()
    con.register("conversations", spark.read.parquet(f"{tricky}/conversations.parquet").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert difference(queries.QUERIES["op4_chat_formatting"](spark, tricky), con, queries.ORACLES["op4_chat_formatting"]) == ""


CALLS = "conv_id string, turn long, call_id string, name string, arguments string, depends array<string>"
RESULTS = "conv_id string, turn long, call_id string, content string"


def chat(spark, calls, results):
    linked = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS))
    return [(r, json.loads(r.record)) for r in tool_calls.records(linked, Scratch(spark, "test")).collect()]


def test_tool_call_errors_and_cycles(spark):
    args = ['{"query":"q","limit":3}', '{"limit":"3","query":1}', '{"query":"q","limit":99,"z":1,"a":2}', "[1]", "{bad", '{"b":1,"query":"x\\u00e9","a":{"d":1,"c":[2,1]}}', None]
    calls = [("c", i, f"c-{i}", "search", a, [f"c-{(i + 1) % 3}"] if i < 3 else []) for i, a in enumerate(args)] + [("c", 9, "c-9", "fly", "{}", ["elsewhere"])]
    rows = chat(spark, calls, [("c", 1, "c-0", "r1"), ("c", 0, "c-0", "r0")])
    found = {d["id"]: d for r, d in rows if r.kind == "call"}
    assert [found[f"c-{i}"]["errors"] for i in range(5)] == [[], ["type:limit", "type:query"], ["range:limit", "unknown:a", "unknown:z"], ["json"], ["json"]]
    assert found["c-9"]["errors"] == ["tool"] and found["c-6"]["errors"] == ["json"] and found["c-0"]["result"] == "r0"
    assert [d["result"] for r, d in rows if r.kind == "orphan"] == ["r1"]
    assert any('"arguments":{"a":{"c":[2,1],"d":1},"b":1,"query":"xé"}' in r.record for r, _ in rows)
    # c-0 waits for c-1, c-1 for c-2, c-2 for c-0: the first two wait for later ones and are freed
    assert {d["id"]: (r.level, r.cyclic) for r, d in rows if r.kind == "call" and d["id"] < "c-3"} == {"c-0": (0, True), "c-1": (0, True), "c-2": (1, False)}


def test_levels_equal_longest_paths(spark):
    r = random.Random(12)
    calls = [("k" if i % 3 else "m", i, f"x{i}", "search", '{"query":"q"}', [f"x{j}" for j in r.sample(range(60), r.randint(0, 3)) if j < i] + ["none"]) for i in range(60)]
    r.shuffle(calls)
    by_id = {c[2]: c for c in calls}

    def level(c):
        return max((1 + level(by_id[d]) for d in c[5] if d in by_id and by_id[d][0] == c[0]), default=0)

    got = {d["id"]: (row.level, row.cyclic) for row, d in chat(spark, calls, [])}
    assert got == {c[2]: (level(c), False) for c in calls} and max(v for v, _ in got.values()) >= 2


def ordered_by_parts(calls):
    """{id: (level, cyclic)} of calls(conversation, turn, id, dependencies): loops over strongly connected parts found by reachability."""
    key = {c[2]: (c[0], c[1]) for c in calls}
    deps = {c[2]: [d for d in dict.fromkeys(c[3]) if d in key and key[d][0] == c[0]] for c in calls}
    leads = {}
    for i in deps:
        seen, stack = set(), list(deps[i])
        while stack:
            if (j := stack.pop()) not in seen:
                seen.add(j)
                stack += deps[j]
        leads[i] = seen
    kept = {i: [j for j in js if not (key[j][1] >= key[i][1] and i in leads[j])] for i, js in deps.items()}
    level: dict[str, int] = {}
    while len(level) < len(kept):
        level |= {i: max((1 + level[j] for j in js), default=0) for i, js in kept.items() if i not in level and all(j in level for j in js)}
    return {i: (level[i], len(kept[i]) < len(deps[i])) for i in deps}


def linked_graph(spark, calls):
    rows = [(c, t, i, "search", '{"query":"q"}', d) for c, t, i, d in calls]
    made = spark.createDataFrame(rows, "conv_id string, turn long, call_id string, name string, arguments string, depends array<string>")
    return tool_calls.link(made, spark.createDataFrame([], "conv_id string, turn long, call_id string, content string"))


@pytest.mark.parametrize("bound", [2_048, 0])
def test_calls_between_cycles_keep_their_order(spark, bound):
    bridge = [("b", 1, "A1", ["A2", "B"]), ("b", 2, "A2", ["A1"]), ("b", 5, "B", ["C1"]), ("b", 6, "C1", ["C2"]), ("b", 7, "C2", ["C1"])]
    r = random.Random(3)
    graphs = []
    for g in range(60 if bound else 4):
        n = r.randint(1, 70 if bound and g % 20 == 0 else 9)
        graphs += [(f"g{g}", t, f"g{g}-{t}", [f"g{g}-{r.randrange(n)}" for _ in range(r.choice((0, 1, 1, 2, 3)))]) for t in range(n)]
    calls = bridge + graphs
    scratch = Scratch(spark, "test")
    linked = scratch.written(linked_graph(spark, calls), "linked")
    found = linked.join(tool_calls.levels(linked, scratch, bound), "node", "left").collect()
    wanted = ordered_by_parts(calls)
    assert {r.call_id: (r.level or 0, bool(r.cyclic)) for r in found} == wanted
    assert wanted["C1"] == (0, True) and wanted["B"] == (1, False) and wanted["A1"] == (2, True)
    assert any(c for _, c in wanted.values())
    scratch.clear()


def test_long_chains_take_no_round_per_call(spark):
    n = 1_000
    calls = [("up", t, f"u{t}", [f"u{t - 1}", f"u{t - 2}"]) for t in range(n)] + [("down", t, f"d{t}", [f"d{t + 1}"]) for t in range(n)] + [("ring", t, f"r{t}", [f"r{(t + 1) % n}"]) for t in range(n)]
    scratch = Scratch(spark, "test")
    linked = scratch.written(linked_graph(spark, calls), "linked")
    began = time.time()
    found = {r.call_id: (r.level or 0, bool(r.cyclic)) for r in linked.join(tool_calls.levels(linked, scratch), "node", "left").collect()}
    assert time.time() - began < 60
    assert all(found[f"u{t}"] == (t, False) and found[f"d{t}"] == (n - 1 - t, False) and found[f"r{t}"] == ((0, True) if t < n - 1 else (1, False)) for t in range(n))
    scratch.clear()


def test_warc(spark, tricky):
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.QUERIES["op6_warc"](spark, tricky).collect())
    pages = spark.read.parquet(f"{tricky}/pages.parquet").collect()
    largest: dict[str, int | None] = {}
    for p in pages:
        h = p.html or ""
        largest[h] = max((x for x in (largest.get(h), p.page_id) if x is not None), default=None)
    expected = []
    for p in pages:
        body, top = (p.html or "").encode(), largest[p.html or ""]
        expected.append((p.page_id is None, p.page_id or 0, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if top == p.page_id else "revisit", None if top == p.page_id else top))
    assert got == sorted(expected, key=lambda r: r[:4]) or sorted(map(str, got)) == sorted(map(str, expected))


def test_warc_damage_is_reported():
    records = [warc.record(i, f"http://x/{i}", f"payload {i} ".encode() * 200, None) for i in range(120)]
    data = warc.archive(records)
    assert warc.load_dictionary(data)[0] is not None
    found = [warc.parse(c) for _, c in warc.frames(data)]
    assert [r["page_id"] for r in found] == list(range(120)) and all(r["error"] is None for r in found)
    starts = [at for at, _ in warc.frames(data)]
    broken = bytearray(data)
    broken[starts[5] : starts[5] + 4] = b"\0\0\0\0"
    errors = [warc.parse(c)["error"] for _, c in warc.frames(bytes(broken))]
    assert errors.count(None) == 119 and errors[5] == "frame can't be decoded"
    assert warc.parse(records[0].replace(b"payload 0", b"payload X", 1))["error"] == "block digest differs"
    assert "Content-Length" in warc.parse(records[0][:-5])["error"] and "missing" in warc.parse(records[0].replace(b"WARC-Date", b"X-Date"))["error"]
    assert warc.load_dictionary(warc.archive(records[:2]))[0] is None
    with pytest.raises(ValueError, match="cut off"):
        warc.load_dictionary(data[:20])


def test_warc_dictionary_frames_without_a_size_are_read_within_a_bound():
    made = [warc.record(i, "u", long_text(400, i).encode(), None) for i in range(300)]
    data = warc.archive(made)
    size = int.from_bytes(data[4:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    stream = zstandard.ZstdCompressor(level=9, write_content_size=False).compressobj()
    body = stream.compress(raw) + stream.flush()
    with pytest.raises(zstandard.ZstdError):  # the header doesn't tell the size
        zstandard.ZstdDecompressor().decompress(body)
    again = data[:4] + len(body).to_bytes(4, "little") + body + data[8 + size :]
    assert [x for _, x in warc.frames(again)] == made
    assert warc.load_dictionary(again)[0].as_bytes() == raw
    with pytest.raises(ValueError, match="larger than"):
        warc.load_dictionary(again, most=len(raw) - 1)
    half = body[: len(body) // 2]
    with pytest.raises(ValueError, match="cut off"):
        warc.load_dictionary(data[:4] + len(half).to_bytes(4, "little") + half)


def test_bpe_equals_the_library(spark, tricky):
    own = bpe.codec(bpe.default_path())
    for text, r in rows_by_text(spark, tricky, "op7_bpe"):
        ids = own.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded_sha256 == sha(own.tokenizer.decode(ids, skip_special_tokens=False))


def test_bpe_trees_of_small_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "UNSPLIT", 40)
    monkeypatch.setattr(bpe, "WINDOW", 4)
    own, r = bpe.codec(bpe.default_path()), random.Random(8)
    parts = [" ", "\n\n", "'re", "don't", "ab" * 20, "é", "中文字" * 5, "12345", "  \t ", "<|endoftext|>", "!!!'s", "\n\n\n\n're", "etaoins" * 9]
    for _ in range(800):
        text = "".join(r.choices(parts, k=r.randint(1, 20)))
        leaf = r.randint(1, 40)
        got = own.tree([(text[i : i + leaf], own.encode(text[i : i + leaf])) for i in range(0, len(text), leaf)])
        assert got == own.tokenizer.encode(text, add_special_tokens=False).ids
        assert own.decode(got) == text


def test_mixing(spark, tricky):
    assert difference(queries.QUERIES["op8_mixing"](spark, SF), connect(SF), queries.ORACLES["op8_mixing"]) == ""
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit("x").alias("text"))
    n = {r.source: r["count"] for r in mixing.mixed(many, mixing.source_rates(many, {"a": 1.0, "b": 1.0})).groupBy("source").count().collect()}
    assert abs(n["a"] - 10_000) < 400 and abs(n["b"] - 10_000) < 400
    high = mixing.mixed(many.where("id < 400" if "id" in many.columns else "doc_id < 400"), mixing.source_rates(many.where("doc_id < 400"), {"a": 1.0, "b": 0.0}, epochs=60.0))
    assert abs(high.count() - 24_000) < 800 and high.select("source").distinct().count() == 1


def test_pii(spark, tricky):
    def luhn(x):
        return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(x))) % 10 == 0

    for text, r in rows_by_text(spark, tricky, "op9_pii"):
        t, found = text or "", []
        found += [(0, m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x) < 9 and int(x) <= 255 for x in m[0].split("."))]
        for kind, at, low, high, pattern in (("card", 2, 16, 19, r"[0-9]([\x20-]?[0-9])+"), ("phone", 3, 8, 15, r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in re.finditer(pattern, t):
                d = re.sub("[^0-9]", "", m[0])
                if low <= len(d) <= high and (kind == "phone" or luhn(d)):
                    found.append((at, m.start(), m.end(), kind))
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(found)))
    by_text = dict(rows_by_text(spark, tricky, "op9_pii"))
    assert "iban:" in by_text[texts()[16]].spans and "short_card:" in by_text[texts()[17]].spans and "ssn:" in by_text[texts()[17]].spans
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    masked = pii.mask_documents(docs)
    assert masked.columns == docs.columns and "[PII]" in masked.where("doc_id = 16").first().text


def test_media(spark, tricky):
    for text, r in rows_by_text(spark, tricky, "op10_media_columns"):
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        whole = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.media_bytes, r.media_sha256) == (len(whole), hashlib.sha256(whole).hexdigest())
        steps = sum(abs(a - b) for a, b in zip(payload, payload[1:], strict=False))
        gear, chunks, start, h = media.gear_table(), 1, 0, 0
        for i, byte in enumerate(whole[:-1]):  # a rolling hash, cut by cut
            h = (h * 2 + int(gear[byte])) % 2**32
            if i + 1 - start >= media.LEAST and len(whole) - start > media.LEAST and (h >> (32 - media.CUT_BITS) == 0 or i + 1 - start == media.MOST):
                chunks, start = chunks + 1, i + 1
        assert r.feature == f"{len(payload) // 64}:{1000 * sum(payload) // len(payload)}:{min(payload)}:{max(payload)}:{len(set(payload))}:{1000 * steps // (len(payload) - 1)}:{chunks}"


def test_gear_cuts_equal_a_rolling_loop_and_survive_an_insertion():
    gear = media.gear_table()
    data = long_text(30_000, 9).encode()
    h, places = 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(gear[b])) & 0xFFFFFFFF
        if h >> (32 - media.CUT_BITS) == 0:
            places.append(i + 1)
    at, expected = 0, []
    while len(data) - at > media.LEAST:
        at = min([p for p in places if p >= at + media.LEAST][:1] + [at + media.MOST, len(data)])
        expected.append(at)
    assert media.cuts(data, gear) == (expected if expected[-1] == len(data) else [*expected, len(data)])
    split = lambda d: {d[a:b] for a, b in zip([0, *media.cuts(d, gear)[:-1]], media.cuts(d, gear), strict=True)}
    assert len(split(data) & split(data[:999] + b"inserted" + data[999:])) >= len(split(data)) - 3
