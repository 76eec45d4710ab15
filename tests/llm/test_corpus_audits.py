"""Decontamination, periodic runs and the filter audit against plain loops, on whole and on tricky tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioweave.llm import decontamination, filter_audit, queries, tandem_runs
from folioweave.llm.common import Scratch
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n long, salt int, digest string, classes string, signature string, n_runs int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ITEMS = [
    (1, prose(30, 1)), (2, prose(10, 2)), (3, "Seven short words, of one test item"), (4, "unique"), (5, None), (6, ""), (7, "... !!"), (8, prose(30, 1)), (9, "Ünïcode wörter ÉCOLE " + prose(12, 9)),
    (10, "a " * 40), (11, "long" * 60 + " " + prose(14, 11)), (None, prose(11, 12)), (3, prose(12, 13)), (12, " ".join(prose(30, 1).split()[5:18])), (1, prose(30, 1)),
]


def texts() -> list[str | None]:
    one, long = prose(30, 1), prose(30_000, 77)
    return [
        None, "", " \n\t", "word", one, one.upper(), one.replace(" ", "\n - "), prose(5, 3) + " " + one[20:] + " tail", "x " + prose(10, 2) + " " + prose(10, 2), "SEVEN short words -- of one test item! unique",
        "seven short words of one test", "Ünïcode wörter École " + prose(12, 9), "a " * 25 + "b", "a " * 9 + "b", "long" * 60 + " " + prose(14, 11), "long" * 61 + " " + prose(14, 11), prose(11, 12), prose(12, 13),
        long + " " + one + " " + long, "x" * 2_000_000 + " " + one, "a b " * 300, "same line\n" * 50, "A" * 50 + " #", "q " * 5, "q " * 6, "p q " * 4, "p q r p q r p q r p q", "p q r " * 4, "ß " * 8 + "ß",
    ]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audits"))
    rest = ("p", 3, 4, 5, "d", "c", "s", 6)
    rows = [(i, t, ("en", "de", None, "")[i % 4], "s", 0, *rest) for i, t in enumerate(texts())]
    rows += [rows[4], rows[4], (None, texts()[4], "en", None, None, *rest), (None, None, None, None, None, *rest), (4, "another text of the same id", "fr", None, None, *rest), (900, texts()[20], "en", None, None, *rest)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("item_id", "text", "'x' AS window", "1 AS class", "2 AS doc_id").write.parquet(f"{path}/benchmark.parquet")
    labels = [(4, 1, 0), (4, 0, 1), (5, 0, 0), (None, 1, 1), (20, None, 1), (900, 1, None), (12345, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part", "3 AS n").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty-audits"))
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", ["op11_benchmark_decontamination", "op12_periodic_runs", "op13_filter_audit"])
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


# ---- decontamination ----


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(text: str | None, items) -> tuple:
    words, hit, held = item_words(text), set(), set()
    for item, t in items:
        w = item_words(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            for at in (k for k in range(len(words) - m + 1) if words[k] == w[i] and words[k : k + m] == w[i : i + m]):
                hit |= set(range(at, at + m))
                held |= set() if item is None else {str(item)}
    return len(words), len(hit), len(held), sha(",".join(sorted(held))), bool(hit)


@pytest.mark.parametrize("size", [200_000, 7])
def test_contamination_equals_plain_search(spark, tables, monkeypatch, size):
    monkeypatch.setattr(decontamination, "PIECE", 5_000)
    scratch = Scratch(spark, "test")
    docs, benchmark = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontamination.contaminated(docs, benchmark, scratch, size)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    wanted = Counter((r.doc_id, *plain_contamination(r.text, ITEMS)) for r in docs.collect())
    assert Counter(map(tuple, found.collect())) == wanted
    scratch.clear()


@pytest.mark.parametrize("where", ["tables", SF])
def test_contamination_equals_its_sql(spark, tables, where):
    path = tables if where == "tables" else where
    con = connect(SF)
    if where == "tables":
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    assert difference(decontamination.scan(spark, path), con, decontamination.ORACLE) == ""


def test_an_empty_benchmark_marks_nothing(spark, tables, empty):
    scratch = Scratch(spark, "test")
    found = decontamination.contaminated(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{empty}/benchmark.parquet"), scratch).collect()
    assert len(found) == len(texts()) + 6
    assert not any(r.contaminated or r.n_items for r in found)
    assert {r.n_words for r in found if r.doc_id == 20} == {600}


@pytest.mark.parametrize("m", [1, 2, 3, 10])
def test_shift_tables_skip_no_occurrence(m):
    rng = random.Random(m)
    words = [b"abcdefghijklmnopqrstuvwxyz"[k : k + 1] for k in range(5)]
    for _ in range(200):
        windows = {tuple(rng.choices(words, k=m)) for _ in range(rng.randint(1, 6))}
        text = rng.choices(words, k=60)
        for w in list(windows)[:2]:
            at = rng.randrange(60 - m)
            text[at : at + m] = w
        found = {(e, n) for e, n in decontamination.Matcher([(w, b"".join(w)) for w in windows], m).found(text)}
        assert found == {(i + m, b"".join(text[i : i + m])) for i in range(60 - m + 1) if tuple(text[i : i + m]) in windows}


# ---- periodic runs ----


def plain_runs(w: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(least, exponent * q) and not any(all(w[x] == w[x + d] for x in range(s, s + n - d)) for d in range(1, q)):
                out.append((s, n, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_result(doc_id: int | None, text: str | None) -> tuple:
    words = re.findall(SPACE, text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept)


@pytest.mark.parametrize("batch", [1, 3_000, 400_000])
def test_runs_equal_a_plain_search(spark, batch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 9000")
    found = tandem_runs.with_runs(docs, batch)
    assert found.columns == ["doc_id", *tandem_runs.NAMES]
    rows = Counter(map(tuple, found.collect()))
    assert rows == Counter(plain_result(r.doc_id, r.text) for r in docs.collect())
    assert sum(r[1] for r in rows) > 20


def test_runs_of_tricky_texts(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("text is null or length(text) < 20000")
    found = Counter(map(tuple, tandem_runs.with_runs(docs).collect()))
    assert found == Counter(plain_result(r.doc_id, r.text) for r in docs.collect())
    whole = tandem_runs.scan(spark, tables)
    assert whole.count() == len(texts()) + 6


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 40), rng.choice((1, 2, 2, 3, 5))
            d = [rng.randrange(k) for _ in range(n)]
            if n > 3 and rng.random() < 0.5:
                p, a = rng.randint(1, max(1, n // 4)), rng.randint(0, n // 3)
                d = d[:a] + [d[a + (i - a) % p] for i in range(a, n)]
            docs.append(d)
        owner, *rest = tandem_runs.runs_of_documents(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]))
        for i, d in enumerate(docs):
            assert [tuple(int(c[j]) for c in rest) for j in np.flatnonzero(owner == i)] == plain_runs(d)
        if docs[0]:  # all runs of two periods and more, without the words left out before
            found = tandem_runs.all_runs(np.array(docs[0], np.int64), 2, 2)
            assert sorted(zip(*(c.tolist() for c in found), strict=True), key=lambda r: (r[0], r[2])) == plain_runs(docs[0], 2, 2)


def test_covering_squares_and_walks_meet_every_square():
    rng = random.Random(8)
    for _ in range(300):
        s = [rng.randrange(2) for _ in range(rng.randint(2, 40))]
        e = tandem_runs.Extensions.of(np.array(s, np.int64))
        start, period = tandem_runs.covering_squares(e)
        reached = {tuple(s[i + t : i + t + 2 * p]) for i, p in zip(start.tolist(), period.tolist(), strict=True) for t in range(len(s)) if i + t + 2 * p <= len(s) and all(s[x] == s[x + p] for x in range(i, i + t + p))}
        squares = {tuple(s[i : i + 2 * p]) for p in range(1, len(s) // 2 + 1) for i in range(len(s) - 2 * p + 1) if s[i : i + p] == s[i + p : i + 2 * p]}
        assert reached == squares


def test_runs_of_long_texts_end():
    for s in (np.zeros(200_000, np.int64), np.tile(np.arange(50_000), 5), np.tile(np.arange(7), 40_000)):
        start, length, period = tandem_runs.all_runs(s)
        assert (start.tolist(), length.tolist()) == ([0], [len(s)])
        assert period[0] == (1, 50_000, 7)[(0 if s.max() == 0 else 1 if s.max() > 7 else 2)]


# ---- filter audit ----


def plain_audit(docs, labels) -> set[tuple]:
    good, toxic = ({r.doc_id for r in labels if getattr(r, c) == 1} for c in ("quality", "toxic"))
    fails = []
    for d in docs:
        text = d.text or ""
        words = re.findall(SPACE, text)
        repeat = d.doc_id is not None and any(o.doc_id is not None and o.doc_id < d.doc_id and (o.text or "") == text for o in docs)
        checks = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), repeat)
        fails.append((d.lang or "", {c for c, bad in zip("ABCDE", checks, strict=True) if bad}, d.doc_id is not None and d.doc_id in good, d.doc_id is not None and d.doc_id in toxic))
    out = []
    for part in {f[0] for f in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                mine = [f for f in fails if f[0] == part and c in f[1]]
                out.append((part, order, step, len(left), len(gone), len(mine) - len(gone), sum(f[1] == {c} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)))
    total = Counter()
    for r in out:
        total[r[0], r[1][r[2] - 1]] += r[4]
    return {(*r, total[r[0], r[1][r[2] - 1]]) for r in out}


def test_audit_equals_plain_filters(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet").collect() for t in ("documents", "labels"))
    found = filter_audit.scan(spark, tables)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = list(map(tuple, found.collect()))
    assert set(rows) == plain_audit(docs, labels)
    assert len(rows) == 4 * 600  # en, de, fr, and the empty part, which the null one joins


def test_audit_equals_its_sql(spark):
    assert difference(filter_audit.scan(spark, SF), connect(SF), filter_audit.ORACLE) == ""


def test_parity_sums_are_inverted_exactly(spark):
    rng = random.Random(2)
    cells = [("p", rng.random() < 0.5, rng.random() < 0.5, rng.randrange(8), rng.randrange(10**12)) for _ in range(60)]
    masks = spark.createDataFrame(cells, "part string, good boolean, toxic boolean, mask int, n long")
    sums = filter_audit.parity_sums(masks, 3)
    row = sums.select(*(filter_audit.inverted(sums[c], 3).alias(c) for c in ("every", "good", "toxic"))).first()
    for name, keep in (("every", lambda c: True), ("good", lambda c: c[1]), ("toxic", lambda c: c[2])):
        assert row[name] == [sum(c[4] for c in cells if c[3] == m and keep(c)) for m in range(8)]
    audited = filter_audit.audit(masks, "XYZ").collect()
    assert len(audited) == 6 * 3
    for letter in "XYZ":
        mine = [r for r in audited if r.filter_order[r.step - 1] == letter]
        assert {r.shapley for r in mine} == {sum(r.removed for r in mine)}
