"""Parts of the job that were once left out, each on the least rows that show it."""

from __future__ import annotations

import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import bpe, media, pii, queries, simhash, tool_calls
from folioweave.llm.common import Scratch


def test_isolated_pairs_at_one_cut_anchor_stay_linked(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(200):  # two bits apart in parts 1 and 2 each, so that only the anchor of part 3, which all share, meets both
        one, two = rng.choice(22, 2, replace=False), 22 + rng.choice(21, 2, replace=False)
        fp = int(rng.integers(0, 2**43)) | 5 << 43
        pairs.append((fp, fp ^ sum(1 << int(b) for b in (*one, *two))))
    fps = spark.createDataFrame([(x,) for p in pairs for x in p], "fp long")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.fingerprint_links(fps).collect()}
    assert found == {tuple(sorted(p)) for p in pairs}


def test_calls_of_other_conversations_and_calls_without_an_identifier_stay(spark):
    calls = [(c, 1, "call_1", "search", '{"query":"q"}', []) for c in ("a", "b")] + [("a", t, None, "search", '{"query":"q"}', [None]) for t in (2, 2, 3)] + [(None, 1, "call_1", "search", '{"query":"q"}', [])]
    results = [("a", 2, "call_1", "of a"), ("b", 2, "call_1", "of b"), ("b", 3, None, "lost"), ("b", 3, None, "lost"), (None, 2, "call_1", "of none")]
    linked = tool_calls.link(
        spark.createDataFrame(calls, "conv_id string, turn long, call_id string, name string, arguments string, depends array<string>"),
        spark.createDataFrame(results, "conv_id string, turn long, call_id string, content string"),
    )
    rows = [(r.conv_id, r.kind, r.turn, r.call_id, r.copies, list(r.errors), r.result) for r in linked.collect()]
    assert sorted(rows, key=str) == sorted([
        ("a", "call", 1, "call_1", 1, [], "of a"), ("b", "call", 1, "call_1", 1, [], "of b"), ("a", "call", 2, None, 2, ["id"], None), ("a", "call", 3, None, 1, ["id"], None),
        ("b", "orphan", 3, None, 2, ["orphan"], "lost"), (None, "call", 1, "call_1", 1, ["conversation"], None), (None, "orphan", 2, "call_1", 1, ["orphan"], "of none"),
    ], key=str)


def test_components_are_the_same_however_anchors_are_cut(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = []
    for block in (3, 20_000):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found.append(sorted(map(tuple, simhash.near_duplicates(docs).collect())))
    assert found[0] == found[1]


def test_of_rows_with_one_id_the_least_stays(spark):
    docs = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, None, 5), (None, "a", 1)], "doc_id long, text string, n long").repartition(3)
    kept = sorted((r.doc_id is None, r.text, r.n) for r in simhash.deduplicate_documents(docs).collect())
    assert kept == [(False, None, 5), (True, "a", 1)]


def test_tokens_keep_the_order_of_files_and_equal_long_texts_meet(spark, tmp_path):
    rng = random.Random(2)
    long = ["x" * 40_000, " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(9_000))]
    rows = [(i, long[i % 2] if i % 7 == 0 else f"short text {i}") for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionById(4, F.pmod("doc_id", F.lit(4)).cast("int"))
    docs.write.parquet(f"{tmp_path}/docs")
    own = bpe.codec(bpe.default_path())
    written = [r for i in range(4) for f in sorted(tmp_path.glob(f"docs/part-0000{i}*")) for r in spark.read.parquet(str(f)).collect()]
    got = bpe.token_files(spark.read.parquet(f"{tmp_path}/docs"), bpe.default_path()).collect()
    assert [(r.doc_id, list(r.ids)) for r in got] == [(r.doc_id, own.encode(r.text)) for r in written]


def test_scratch_is_cleared_by_its_owner(spark):
    scratch = Scratch(spark, "test")
    a, b = scratch.written(spark.range(3), "a"), scratch.written(spark.range(4), "b")
    local = pathlib.Path(scratch.path.removeprefix("file:"))
    assert len(list(local.iterdir())) == 2
    scratch.drop(a)
    assert len(list(local.iterdir())) == 1 and b.count() == 4
    scratch.clear()
    assert not local.exists() and scratch not in Scratch.live


def test_short_media_share_the_chunks_of_a_common_passage(spark, tmp_path):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=5)) for _ in range(n))
    passage = words(500)
    docs = spark.createDataFrame([(i, f"{words(20)} {passage}") for i in range(3)], "doc_id long, text string")
    lists = [set(map(bytes, r.chunks)) for r in media.recipes(docs).collect()]
    common = lists[0] & lists[1] & lists[2]
    assert common and min(map(len, lists)) > 1
    assert media.chunk_store(docs).count() == len(set.union(*lists)) < sum(map(len, lists))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op10_media_columns"](spark, str(tmp_path)).collect()
    assert len(rows) == 3 and all(int(r.feature.split(":")[-1]) > 1 for r in rows)


def test_ibans_among_other_capitals_and_digits_are_masked(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947"
    cases = {
        f"{de} 12 May": "[PII] 12 May", f"{de.replace(' ', '')} BIC COBADEFFXXX": "[PII] BIC COBADEFFXXX", f"{gb} A customer": "[PII] A customer",
        f"{no} {gb} {de}": "[PII] [PII] [PII]", f"AB12 {gb} now": "AB12 [PII] now", f"at the border, in order to pay {gb}": "at the border, in order to pay [PII]",
        "GB83WEST12345698765432 A customer": "GB83WEST12345698765432 A customer", f"x{gb}": f"x{gb}", f"{gb} " + "A1 " * 9_000: "[PII] " + "A1 " * 9_000,
    }
    rows = pii.mask_documents(spark.createDataFrame([(t,) for t in cases], "text string")).collect()
    assert sorted(r.text for r in rows) == sorted(cases.values())


def test_every_chunk_is_kept_in_one_container_and_lent_to_the_other_media(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=5)) for _ in range(n))
    passage = words(900)
    texts = [f"{words(90)} {passage} {words(90)}" for _ in range(5)] + [passage * 3, "x" * 200_000, words(300), "", None, passage * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists = media.media_lists(media.recipes(docs)).cache()
    linked = media.links(lists).cache()
    store = {bytes(r.media_id): r.bodies for r in media.containers(media.packed(docs), linked).collect()}
    ids = {bytes(r.media_id): [bytes(c) for c in r.chunks] for r in lists.collect()}
    assert store.keys() == ids.keys() and all(len(store[m]) == len(ids[m]) for m in ids)
    kept = [c for m in ids for c, body in zip(ids[m], store[m], strict=True) if body is not None]
    assert len(kept) == len(set(kept)) and set(kept) == {c for m in ids for c in ids[m]} and len(kept) < sum(map(len, ids.values()))
    places = {(bytes(r.media_id), r.place): (bytes(r.chunk_id), r.lends) for r in linked.collect()}
    every = [(m, i, c) for m in ids for i, c in enumerate(ids[m])]
    first = {c: (m, i) for m, i, c in sorted(every, reverse=True)}
    assert places == {(m, i): (c, first[c] == (m, i)) for m, i, c in every if sum(c == d for _, _, d in every) > 1}
    whole = media.containers(media.packed(docs), linked)
    chunks = {bytes(r.media_id): int(r.feature.split(":")[-1]) for r in media.rebuild(whole, linked).collect()}
    assert chunks == {m: len(ids[m]) for m in ids}
    lost = linked.where("not lends").orderBy("media_id", "place").first()
    with pytest.raises(Exception, match="lacks a chunk"):
        media.rebuild(whole, linked.where((F.col("media_id") != F.lit(lost.media_id)) | (F.col("place") != lost.place) | F.col("lends"))).collect()


def test_bodies_of_chunks_cross_one_exchange(spark, tmp_path):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    docs = [(i, "".join(rng.choices(letters, k=20_000))) for i in range(100)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")

    def shuffled() -> dict[int, int]:
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    before, threshold = shuffled(), "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # a small store would be broadcast, which large ones aren't
    try:
        queries.QUERIES["op10_media_columns"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set(threshold, usual)
    crossed = sum(n for stage, n in shuffled().items() if stage not in before)
    stored = sum(len(r.body) for r in media.chunk_store(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    assert stored < crossed < 1.5 * stored
