"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are documents labelled quality 1, unlabelled are documents of the web text as they come, whatever
their label.  With prior p, positive risk R_P+ and the risks R_P-, R_U- of calling positives and unlabelled negative, training
minimises  p R_P+ + max(0, R_U- - p R_P-)  by gradient descent; where the second term is negative, its gradient is turned round.
The model is linear over dense text features (FEATURES) under the logistic loss, so the score is a probability.

The prior is estimated from positives and unlabelled rows alone: a linear model tells the two apart on one half of each; on the other half, the share of
unlabelled rows above a score, over that of positives above it, bounds the prior from above at every score.  The estimate is the least such bound, each
widened by what chance allows (prior_of).  Only rows whose crc32(doc_id as text) mod 4 is not 2 are learnt from, as positives and as unlabelled.  The fit takes at most SAMPLE
ids of each kind, those that hash lowest; an id that several rows share counts once, with its least text.  Scores are given to every row.

Defined cases: null and empty texts get the score of the all-zero counts; without positives the score is the prior everywhere (0.5 if
no labels at all); repeated rows get equal scores; a null doc_id is held out; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, table

SAMPLE = 6_000
ROUNDS, RATE, RIDGE = 800, 0.05, 1e-3
CUT = 0.7
#: Chance that a bound on the prior fails.
CONFIDENCE = 0.1
HELD_OUT = 2
FEATURES = (
    "log_words", "mean_word", "upper_words", "symbols", "bangs", "digits", "distinct", "stops", "repeat_lines", "repeat_grams", "words_per_line",
    "sentences", "symbol_runs", "pipes", "symbol_ends", "non_ascii", "upper_any", "runs_any", "pipes_any",
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~_=]")
RUNS = re.compile(r"([^\w\s.])\1+")
#: A run of marks is tried once, from its first mark: time stays linear where a long run ends in a letter.
ENDS = re.compile(r"(?<![.?])[.?]++(?=\s|$)")
DIGITS = re.compile(r"[0-9]")
WIDE = re.compile(r"[^\x00-\x7f]")
LETTER_END = re.compile(r"[\w.,;:!?\"')-]$")


def features(text: str | None) -> list[float]:
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    words = WORD.findall(text)
    n, size = max(1, len(words)), max(1, len(text))
    lower = [w.lower() for w in words]
    upper = sum(len(w) > 1 and w.isupper() for w in words) / n
    grams = list(zip(lower, lower[1:], lower[2:], lower[3:], strict=False))
    runs, pipes = len(RUNS.findall(text)) / n, text.count("|") / n
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n / 10, upper, len(SYMBOLS.findall(text)) / size * 10, text.count("!") / n, len(DIGITS.findall(text)) / size * 10,
        len(set(lower)) / n, sum(len(w) <= 3 for w in words) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(grams)) / max(1, len(grams)),
        float(np.log1p(n / max(1, len(lines)))) / 5, len(ENDS.findall(text)) / n * 5, runs, pipes, sum(LETTER_END.search(w) is None for w in words) / n,
        len(WIDE.findall(text)) / size, float(upper > 0.2), float(runs > 0.05), float(pipes > 0.05),
    ]


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = (np.clip((rows - np.array(self.mean)) / np.array(self.scale), -8, 8)) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(prior: float) -> Model:
    k = len(FEATURES)
    p = min(max(prior, 1e-6), 1 - 1e-6)
    return Model((0.0,) * k, float(np.log(p / (1 - p))), (0.0,) * k, (1.0,) * k)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS, separate: bool = False) -> Model:
    """Minimises the non-negative unbiased risk (full batches, Adam steps); with `separate`, the plain logistic risk of telling the two sets apart."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    theta = np.zeros(p.shape[1] + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    with_one = lambda x: np.hstack((x, np.ones((len(x), 1))))
    p, u = with_one(p), with_one(u)
    for step in range(1, rounds + 1):
        zp, zu = p @ theta, u @ theta
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # logistic loss: l(z, +) = log(1 + e^-z), with derivative s - 1; l(z, -) = log(1 + e^z), with derivative s
        off = 0.0 if separate else prior
        negative = np.logaddexp(0, zu).mean() - off * np.logaddexp(0, zp).mean()
        slope = (u * su[:, None]).mean(axis=0) - off * (p * sp[:, None]).mean(axis=0)
        grad = prior * (p * (sp - 1)[:, None]).mean(axis=0) + slope if negative >= 0 else -slope
        grad[:-1] += RIDGE * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(tuple(map(float, theta[:-1])), float(theta[-1]), tuple(map(float, mean)), tuple(map(float, scale)))


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from 0.02 to 0.98."""
    apart = fit(positive[::2], unlabelled[::2], 0.5, separate=True)
    p, u = (apart.scores(x if len(x) else y) for x, y in ((positive[1::2], positive), (unlabelled[1::2], unlabelled)))
    at = np.unique(p)
    above = lambda s: 1 - np.searchsorted(np.sort(s), at, side="left") / len(s)
    slack = sum(np.sqrt(np.log(4 / CONFIDENCE) / (2 * len(s))) for s in (p, u))
    enough = above(p) > 0
    a, b = above(p)[enough], above(u)[enough]
    best = int(np.argmin((b + slack) / a))
    return float(min(max(b[best] / a[best], 0.02), 0.98))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(True))


def to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["order", "x"])


def gathered(rows: DataFrame, sample: int) -> np.ndarray:
    """Features of rows(order, text), one text for each order and at most `sample` of them, in an order of their own."""
    each = rows.groupBy("order").agg(F.min("text").alias("text"))  # before the features: a repeated id is one row
    found = each.mapInArrow(to_features, "order long, x array<double>").orderBy("order").limit(sample).collect()
    return np.array([r.x for r in found]) if found else np.empty((0, len(FEATURES)))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """documents(doc_id, text), labels(doc_id, quality)."""
    known = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    share, n = known.agg(F.avg("quality"), F.count("*")).first()
    if not n:
        return constant(0.5)
    learnt = documents.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    by_hash = lambda df, seed: hashed_sample(df.select("doc_id").distinct(), ["doc_id"], sample, seed)
    # Both lists are bounded by `sample`, so they may be broadcast.
    trusted = gathered(learnt.join(F.broadcast(by_hash(known.where("quality = 1"), 1)), "doc_id").select("order", "text"), sample)
    web = gathered(learnt.join(F.broadcast(by_hash(learnt.select("doc_id"), 2)), "doc_id").select("order", "text"), sample)
    return fit(trusted, web, prior_of(trusted, web)) if len(trusted) and len(web) else constant(share)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double) of every row of docs(doc_id, text)."""
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: one row per document."""
    documents = table(spark, sf_dir, "documents")
    scored = with_scores(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
