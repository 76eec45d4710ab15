"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate; the content share decides.

The lines of a text that hold a word form a sequence.  Each has binary features (FEATURES); the field scores label 1
(boilerplate) by the sum of their weights, and neighbouring labels by a transition table.  Viterbi decoding gives the best labelling;
a document is kept if lines labelled content hold at least CONTENT_SHARE of its word characters, and the base rules don't fail.

The field is trained on a bounded sample: the lines of at most SAMPLE labelled documents, at most SAMPLE_LINES lines of each (these
bounds concern the fit alone).  Line labels are latent.  A document's label only bounds the share of its characters that is boilerplate: at most
GOOD_SHARE for quality 1, at least BAD_SHARE for quality 0.  Training starts from rules for lines (DEFAULT) and is drawn back to them; each round tilts
the scores of the documents that break their bound, and moves the weights from the field's expectations towards the tilted ones.  So a notice within a
good document stays boilerplate, and prose within a bad one content.  Transitions are held close to their start: labels that hold for whole documents
would make them too strong to label a single line.  Without labels of both kinds, DEFAULT itself holds.

Defined cases: null text has no words; texts without words fail the base rules; repeated rows are judged row by row;
labels that are null, or contradict each other, are left out of the sample, and of rows with one labelled id the least is taken; empty tables give no rows; other columns aren't carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
RUN = re.compile(r"([#*$%&|<>~=_-])\1\1")
DIGIT = re.compile(r"[0-9]")
LINK = re.compile(r"https?:|www\.|cookie|copyright|all rights reserved|licen[cs]e|subscribe|javascript|newsletter|click here|privacy policy|terms of (?:use|service)", re.I)
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
CONTENT_SHARE = 0.5
SAMPLE, SAMPLE_LINES = 3_000, 60
ROUNDS, RATE, RIDGE, TRANSITION_RIDGE = 80, 3.0, 0.005, 0.2
#: Bounds of the boilerplate share, and of the tilt of a document that breaks its own.
GOOD_SHARE, BAD_SHARE, TILT, TILT_STEP = 0.2, 0.8, 8.0, 4.0
#: Training ends when no weight moves by more.
STILL = 1e-3
#: Order of a line's feature bits.
FEATURES = (
    "bias", "under_3_words", "under_8_words", "over_40_words", "some_symbols", "many_symbols", "pipe", "some_upper", "mostly_upper", "ends_sentence",
    "repeats_a_line", "few_distinct", "long_words", "short_words", "shouts", "digits", "symbol_run", "link_or_notice", "ends_with_pipe",
)


@dataclass(frozen=True)
class Field:
    """Weights of label 1 by feature, and transition[a][b] from label a to b."""

    weights: tuple[float, ...]
    transition: tuple[tuple[float, float], tuple[float, float]]


#: Rules for lines, as weights: what a line shows by itself, and a light pull towards its neighbours.
DEFAULT = Field((-1.5, 0.3, 0.1, -0.2, 0.8, 2.5, 1.5, 0.8, 2.5, -0.5, 1.0, 1.0, 0.5, 0.3, 2.0, 0.8, 2.5, 3.0, 0.8), ((0.25, -0.25), (-0.25, 0.25)))


def line_bits(line: str, words: list[str], repeats: bool) -> int:
    n, chars = len(words), sum(map(len, words))
    symbols, upper = len(SYMBOL.findall(line)), sum(map(str.isupper, words))
    tests = (
        True, n < 3, n < 8, n > 40, symbols > 0.02 * chars, symbols > 0.08 * chars, "|" in line, upper > 0.3 * n, upper > 0.8 * n, words[-1][-1] in ".?!:\"'",
        repeats, n >= 10 and len(set(words)) < 0.5 * n, chars > 9 * n, chars < 2.5 * n, line.count("!!") > 0.25 * n, len(DIGIT.findall(line)) > 0.2 * chars,
        RUN.search(line) is not None, LINK.search(line) is not None, words[-1][-1] == "|",
    )
    return sum(1 << i for i, x in enumerate(tests) if x)


def repeated_words(words: list[str], window: int = REPEAT_WINDOW) -> int:
    """Words in windows that are found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    rank = codes[:n]
    for k in range(1, window):  # rank: of the window so far, exact
        pair = rank * (len(ids) + 1) + codes[k : k + n]
        rank = np.unique(pair, return_inverse=True)[1]
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def describe(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; of each line with a word, its feature bits and word characters."""
    text = text or ""
    seen: set[str] = set()
    every: list[str] = []
    bits, sizes, dup = [], [], 0
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        repeats = line in seen
        dup += repeats
        seen.add(line)
        every += words
        bits.append(line_bits(line, words, repeats))
        sizes.append(sum(map(len, words)))
    return len(every), sum(sizes), len(SYMBOL.findall(text)), dup, repeated_words(every), bits, sizes


def emissions(field: Field, bits: list[int]) -> list[float]:
    return [sum(w for i, w in enumerate(field.weights) if b >> i & 1) for b in bits]


def viterbi(field: Field, scores: list[float]) -> list[int]:
    """The labelling of greatest score; of equals, label 0 from the end."""
    if not scores:
        return []
    (t00, t01), (t10, t11) = field.transition
    zero, one = 0.0, scores[0]
    back: list[tuple[int, int]] = []
    for s in scores[1:]:
        a, b, c, d = zero + t00, one + t10, zero + t01, one + t11
        back.append((int(b > a), int(d > c)))
        zero, one = max(a, b), max(c, d) + s
    label = int(one > zero)
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


@dataclass(frozen=True)
class Lines:
    """Line features of documents, longest first: x[i, j] of line i of document j; `active[i]` documents have a line i."""

    x: np.ndarray
    sizes: np.ndarray
    lengths: np.ndarray
    active: np.ndarray
    label: np.ndarray
    weight: np.ndarray


def lines_of(sequences: list[tuple[list[int], list[int], int]], boilerplate: float) -> Lines:
    """From (bits, sizes, label of the document); boilerplate: the share of label 1 among all labelled documents."""
    ordered = sorted(sequences, key=lambda s: -len(s[0]))
    k, longest, n = len(FEATURES), len(ordered[0][0]), len(ordered)
    x, sizes = np.zeros((longest, n, k), dtype=np.float32), np.zeros((longest, n))
    for j, (bits, size, _) in enumerate(ordered):
        x[: len(bits), j] = (np.array(bits)[:, None] >> np.arange(k)) & 1
        sizes[: len(bits), j] = size
    lengths, label = np.array([len(b) for b, _, _ in ordered]), np.array([y for _, _, y in ordered])
    # Either kind of document counts by its share of all labelled ones, not of the sample; its lines share its weight.
    weight = np.where(label == 1, boilerplate / max(1, (label == 1).sum()), (1 - boilerplate) / max(1, (label == 0).sum())) / lengths
    return Lines(x, sizes / np.maximum(1, sizes.sum(axis=0)), lengths, np.array([(lengths > i).sum() for i in range(longest)]), label, weight)


def expectations(lines: Lines, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document the log of the partition sum; of each line the probability of label 1; of each pair of labels the weighted expectation."""
    longest, n = e.shape
    alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
    alpha[0, :, 1] = e[0]
    for i in range(1, longest):
        before, k = alpha[i - 1], lines.active[i]
        alpha[i, :k, 0] = np.logaddexp(before[:k, 0] + t[0, 0], before[:k, 1] + t[1, 0])
        alpha[i, :k, 1] = np.logaddexp(before[:k, 0] + t[0, 1], before[:k, 1] + t[1, 1]) + e[i, :k]
    for i in range(longest - 2, -1, -1):
        k = lines.active[i + 1]
        zero, one = beta[i + 1, :k, 0], e[i + 1, :k] + beta[i + 1, :k, 1]
        beta[i, :k, 0], beta[i, :k, 1] = np.logaddexp(t[0, 0] + zero, t[0, 1] + one), np.logaddexp(t[1, 0] + zero, t[1, 1] + one)
    last = alpha[lines.lengths - 1, np.arange(n)]
    total = np.logaddexp(last[:, 0], last[:, 1])
    p = np.zeros((longest, n))
    pairs = np.zeros((2, 2))
    for i in range(longest):
        k = lines.active[i]
        p[i, :k] = np.exp(alpha[i, :k, 1] + beta[i, :k, 1] - total[:k])
        if i:
            for a in (0, 1):
                for b in (0, 1):
                    pairs[a, b] += (np.exp(alpha[i - 1, :k, a] + t[a, b] + b * e[i, :k] + beta[i, :k, b] - total[:k]) * lines.weight[:k]).sum()
    return total, p, pairs


def gain(lines: Lines, w: np.ndarray, t: np.ndarray, tilt: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """How much likelier the tilt makes the labellings, its slopes by w and t, and each document's tilted boilerplate share."""
    e = lines.x @ w.astype(np.float32)
    total, p, pairs = expectations(lines, e, t)
    tilted, q, tilted_pairs = expectations(lines, e + tilt[None, :] * (np.arange(len(e))[:, None] < lines.lengths), t)
    slope = np.tensordot((q - p) * lines.weight, lines.x, axes=([0, 1], [0, 1]))
    return float(((tilted - total) * lines.weight).sum()), slope, tilted_pairs - pairs, (q * lines.sizes).sum(axis=0)


def fit(sequences: list[tuple[list[int], list[int], int]], boilerplate: float, rounds: int = ROUNDS) -> Field:
    """The field after `rounds` of tilting and climbing, from DEFAULT."""
    lines = lines_of(sequences, boilerplate)
    w, t = np.array(DEFAULT.weights), np.array(DEFAULT.transition)
    w0, t0, tilt = w.copy(), t.copy(), np.zeros(len(lines.label))
    for _ in range(rounds):
        _, slope, slope_t, share = gain(lines, w, t, tilt)
        step = RATE * (slope - RIDGE * (w - w0))
        w = w + step
        t = t + RATE * (slope_t - TRANSITION_RIDGE * (t - t0))
        tilt = np.where(lines.label == 1, np.clip(tilt + TILT_STEP * (BAD_SHARE - share), 0, TILT), np.clip(tilt - TILT_STEP * (share - GOOD_SHARE), -TILT, 0))
        if np.abs(step).max() < STILL:
            break
    return Field(tuple(map(float, w)), tuple(tuple(map(float, r)) for r in t))  # type: ignore[arg-type]


def sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[x[:SAMPLE_LINES] for x in describe(t)[5:]] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)), b.column(2)], names=["order", "bits", "sizes", "quality"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fits the field on the labelled documents whose ids hash lowest, half of them of each quality; bounded by sample."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    known = known.select("doc_id", "quality")
    chosen = [hashed_sample(known.where(F.col("quality") == q), ["doc_id"], sample // 2, 0) for q in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # at most `sample` rows
    rows = documents.select("doc_id", "text").join(picked, "doc_id").select("order", "text", "quality")
    lines = rows.mapInArrow(sample_lines, "order long, bits array<long>, sizes array<long>, quality int").where(F.size("bits") > 0)
    each = lines.groupBy("order").agg(F.min(F.struct("bits", "sizes", "quality")).alias("x"))  # one row for each id
    sequences = [(list(r.x.bits), list(r.x.sizes), 1 - r.x.quality) for r in each.orderBy("order").collect()]
    share = known.agg(F.avg(1 - F.col("quality"))).first()[0]
    return fit(sequences, share) if len({label for *_, label in sequences}) == 2 else DEFAULT


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(text: str | None, field: Field, known: dict[int, float] | None = None) -> tuple:
    """A row of COLUMNS; known holds the scores of feature bits met before."""
    n_words, chars, symbols, dup, repeat, bits, sizes = describe(text)
    known = {} if known is None else known
    for b in {*bits} - known.keys():
        known[b] = emissions(field, [b])[0]
    labels = viterbi(field, [known[b] for b in bits])
    share = sum(s for s, label in zip(sizes, labels, strict=True) if not label) / chars if chars else 0.0
    failed = n_words < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n_words
    return n_words, chars, symbols, dup, repeat, failed, not failed and share >= CONTENT_SHARE, share


def with_verdict(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """df's columns (any but those in COLUMNS), and COLUMNS."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        for b in batches:
            found = [judge(t, field, known) for t in b.column(at).to_pylist()]
            made = [pa.array([r[i] for r in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{own}, {COLUMNS}")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: one row per document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(documents, table(spark, sf_dir, "labels"))
    return with_verdict(documents, field).drop("text")


def filter_documents(docs: DataFrame, field: Field) -> DataFrame:
    """Pipeline stage: the documents that are kept, whole."""
    columns = docs.columns
    inner = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    judged = with_verdict(inner, field, f"c{columns.index('text')}").where("kept")
    return judged.select([F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
