"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, with_batches

#: Documented bounds of the sample that the classifier is fitted on (the smallest hashes of doc_id).
POSITIVES = 6000
UNLABELLED = 6000
ACCEPT = 0.3

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\f", b".", b",;:", b"!?", b"#$%&*+=~^_", b"@/\\", b"|<>{}[]", b"\"'()-`"]
_CLASS = np.full(256, len(_GROUPS), dtype=np.uint8)
for _i, _g in enumerate(_GROUPS):
    _CLASS[np.frombuffer(_g, dtype=np.uint8)] = _i
_CLASS[128:] = len(_GROUPS) + 1
_N = len(_GROUPS) + 2
SHAPE_FEATURES = 9


def features(text: bytes) -> np.ndarray:
    """Shape of a whole text: shares of pairs of character classes, and how much of its words and lines repeats."""
    out = np.zeros(_N * _N + SHAPE_FEATURES, dtype=np.float32)
    if not text:
        return out
    kind = _CLASS[np.frombuffer(text, dtype=np.uint8)]
    pairs = np.bincount(kind[:-1].astype(np.int32) * _N + kind[1:], minlength=_N * _N)
    out[: _N * _N] = np.sqrt(pairs / len(text))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    ends = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
    caps = sum(map(bytes.isupper, words))
    out[_N * _N :] = (np.log1p(len(words)), np.log1p(len(text)) - np.log(n), len(set(words)) / n, len(set(lines)) / len(lines), ends / n, caps / n, np.log1p(len(lines)), len(lines) / n, sum(map(eq, words, words[1:])) / n)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> float:
    """Share of positives among the unlabelled, from these two samples alone.

    Where a text is surely positive, the density of the unlabelled is the
    prior times that of the positives. A logistic fit of the one sample
    against the other gives that ratio; each half of the rows is judged by
    the fit of the other half, and the median over the positives is taken.
    """
    every = np.vstack([positive, unlabelled]).astype(np.float64)
    x = np.column_stack([(every - every.mean(0)) / (every.std(0) + 1e-3), np.ones(len(every))])
    y = np.arange(len(every)) < len(positive)
    half = np.concatenate([np.arange(len(positive)), np.arange(len(unlabelled))]) % 2
    odds = np.zeros(len(every))
    for side in (0, 1):
        a, b = x[half != side], y[half != side]
        w = m = v = np.zeros(x.shape[1])
        for t in range(1, steps + 1):
            grad = a.T @ (_sigmoid(a @ w) - b) / max(1, len(b)) + decay * np.append(w[:-1], 0.0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        g = _sigmoid(x[half == side] @ w)
        odds[half == side] = g / (1 - g)
    return float(np.clip(len(positive) / len(unlabelled) / np.median(odds[y]), 0.05, 0.95))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> dict:
    """Linear scores g minimising prior R_p(+) + max(0, R_u(-) - prior R_p(-)), logistic loss (Kiryo et al., 2017)."""
    every = np.vstack([positive, unlabelled]).astype(np.float64)
    mean, spread = every.mean(0), every.std(0) + 1e-3
    p, u = (positive - mean) / spread, (unlabelled - mean) / spread
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        gp, gu = p @ w + b, u @ w + b
        sp, su = _sigmoid(gp), _sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        cp, cu = -prior * (1 - sp) / len(p), np.zeros(len(u))
        if negative >= 0:
            cp, cu = cp - prior * sp / len(p), su / len(u)
        else:  # the correction: climb back where the estimate of a risk is below zero
            cp, cu = prior * sp / len(p), -su / len(u)
        grad = np.append(p.T @ cp + u.T @ cu + decay * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return {"mean": mean, "spread": spread, "w": w, "b": b}


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict | None:
    """Model from trusted positives (labels.quality = 1) and unlabelled texts of `docs`; None where there are none.

    Only labels with crc32(doc_id as text) mod `folds` other than 0 are read,
    and of those the positive ones alone: the class prior is estimated from
    the two samples. Both are bounded by parameters and chosen by hash of
    doc_id; rows without a doc_id are scored, never learnt from, and of rows
    that repeat one each counts.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    seen = labels.where(fold != 0)
    trusted = seen.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(positives)
    anyone = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id").limit(unlabelled).distinct()
    picks = [(int(r[0]), True) for r in trusted.collect()] + [(int(r[0]), False) for r in anyone.collect()]
    if not picks:
        return None
    chosen = F.broadcast(spark.createDataFrame(picks, "doc_id long, trusted boolean"))  # at most positives + unlabelled rows
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            yield [pa.array([features(x).tolist() for x in text_bytes(b.column(0))], type=pa.list_(pa.float32()))]

    got = with_batches(texts, run, [("f", "array<float>")], ["text"]).select("doc_id", "trusted", "f").toPandas().sort_values(["trusted", "doc_id"], kind="stable")
    of = lambda x: np.array(got.loc[got.trusted == x, "f"].tolist(), dtype=np.float32)
    p, u = of(True), of(False)
    if not len(p) or not len(u):
        return None
    return fit_nnpu(p, u, estimate_prior(p, u))


def score_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with `score` (0 to 1, of whole texts) and `predicted` (1 if score >= ACCEPT).

    Reads the text alone. Null counts as empty and is scored like any other.
    Without a model (no labelled positives) every score is 0.5. Very long texts
    are read whole; rows that repeat are scored each; an empty table gives an
    empty one. Columns named score or predicted are replaced, all others pass
    through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            texts = text_bytes(b.column(0))
            if model is None or not texts:
                got = np.full(len(texts), 0.5)
            else:
                x = (np.array([features(t) for t in texts], dtype=np.float64) - model["mean"]) / model["spread"]
                got = 1 / (1 + np.exp(-np.clip(x @ model["w"] + model["b"], -30, 30)))
            yield [pa.array(got), pa.array((got >= ACCEPT).astype(np.int32))]

    return with_batches(docs, run, [("score", "double"), ("predicted", "int")], ["text"])


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier accepts, with the columns of docs."""
    from .common import pack

    scored = score_quality(pack(docs, [F.col("text")]), fit(docs, labels))
    return scored.where("predicted = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
