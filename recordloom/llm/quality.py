"""Quality by positive-unlabelled learning.

Trusted positives and a sample of unlabelled texts train a small network on measures of a text's form. The risk is the
non-negative unbiased one: positives weigh with the class prior, and what they take away from the unlabelled part's
negative risk never makes that negative. The prior is estimated from how far the unlabelled scores can be explained by
the positives' (the least ratio of the two tails).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_training_row, map_steps
from .toxicity import TEXT_BYTES, training_texts

#: Bounds of the sample that is learnt from: positives, unlabelled texts.
POSITIVES, UNLABELLED = 4000, 8000
HIDDEN, STEPS, RATE, BATCH = 16, 1500, 0.01, 1024
#: A text's measures are taken as if it had so many more words of the average kind, so short texts stay near the average.
BORROWED = 8
_MARKS = np.frombuffer(b"#$%&*@^~+<>=\\/_[]{}`", np.uint8)


def measures(text: str | None) -> list[float]:
    """Form, not subject: shares of kinds of characters, word lengths, repetition; last, the number of words."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(1, int(counts.sum()))
    words = text.lower().split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    upper = int(counts[65:91].sum())
    return [
        upper / n,
        (int(counts[97:123].sum()) + int(counts[128:].sum())) / n,
        int(counts[_MARKS].sum()) / m,
        int(counts[124]) / m,
        int(counts[33]) / m,
        int(counts[48:58].sum()) / n,
        n / m / 10,
        len(set(words)) / m,
        sum(map(str.__eq__, words, words[1:])) / m,
        len(set(lines)) / max(1, len(lines)),
        int(counts[46]) / m,
        int(counts[44]) / m,
        float(len(words)),
    ]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward(self.layers, _scaled(x, self.mean, self.scale))[0])


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    words = x[:, -1:]
    return np.clip((x[:, :-1] - mean) / scale, -8, 8) * (words / (words + BORROWED))


def _forward(layers, x):
    w, b, v, c = layers
    h = np.tanh(x @ w + b)
    return h @ v + c, h


def _descend(x: np.ndarray, gradient, seed: int) -> tuple:
    """Adam over a one-layer network; gradient(g(x), rows) gives the derivative of the risk by each output."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.5, HIDDEN), np.zeros(1)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, STEPS + 1):
        rows = rng.integers(0, len(x), min(BATCH, len(x)))
        out, h = _forward(p, x[rows])
        g = gradient(out, rows)
        dh = np.outer(g, p[2]) * (1 - h * h)
        grads = [x[rows].T @ dh, dh.sum(0), h.T @ g, np.array([g.sum()])]
        for i in range(4):
            grads[i] = grads[i] + 1e-4 * p[i]
            m[i] = 0.9 * m[i] + 0.1 * grads[i]
            s[i] = 0.999 * s[i] + 0.001 * grads[i] ** 2
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, slack: float = 0.02) -> float:
    """The least ratio of the unlabelled to the positive share above a score, where enough positives are above it."""
    cuts = np.quantile(positive, np.linspace(0.005, 0.5, 100))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    noise = slack * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled))) / p
    return float(np.clip(((u / p) + noise).min(), 0.02, 0.98))


def fit(positives: list[str], unlabelled: list[str]) -> Model | None:
    """A model, or None if there are too few texts."""
    if len(positives) < 8 or len(unlabelled) < 8:
        return None
    p, u = (np.array([measures(t) for t in z]) for z in (positives, unlabelled))
    both = np.concatenate([p, u])
    mean, scale = p[:, :-1].mean(0), both[:, :-1].std(0) + 1e-3
    x = _scaled(both, mean, scale)
    is_p = np.arange(len(x)) < len(p)
    half = np.arange(len(x)) % 2 == 0

    def tell(out, rows):  # positives against unlabelled, each side with weight 1
        y = is_p[half][rows]
        return np.where(y, (_sigmoid(out) - 1) / max(1, y.sum()), _sigmoid(out) / max(1, (~y).sum()))

    first = _descend(x[half], tell, 1)
    s = _forward(first, x[~half])[0]
    prior = estimate_prior(s[is_p[~half]], s[~is_p[~half]])

    def risk(out, rows):  # logistic losses: positive log(1+e^-g), negative log(1+e^g)
        y = is_p[rows]
        n_p, n_u = max(1, y.sum()), max(1, (~y).sum())
        negative = np.log1p(np.exp(np.clip(out, -30, 30)))
        rest = negative[~y].sum() / n_u - prior * negative[y].sum() / n_p
        s = _sigmoid(out)
        if rest < 0:  # the negative part has been fitted beyond what it can be: step back
            return np.where(y, prior * s / n_p, -s / n_u)
        return np.where(y, prior * (s - 1) / n_p - prior * s / n_p, s / n_u)

    return Model(mean, scale, _descend(x, risk, 2), prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from bounded samples: positives among training rows, unlabelled texts from all documents."""
    positives = training_texts(docs, labels, label, 1, POSITIVES, id_col, text_col)
    d = docs.select(F.col(text_col).alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    total = d.count()
    some = d.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(max(1, total // (2 * UNLABELLED)))) == 0)
    unlabelled = [r.text for r in some.orderBy(F.xxhash64("text"), "text").limit(UNLABELLED).collect()]
    return fit(positives, unlabelled)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher for better), predicted (1 from threshold on).

    Null and empty texts are scored by their measures, as the empty text. Without a model (too few labelled rows) every
    score is 1. Null or repeated ids are kept as rows of their own; a null id is not held out. An empty table gives no
    rows; further columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        s = m.score(np.array([measures(t) for t in batch.column("text").to_pylist()])) if m is not None else np.ones(batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(~is_training_row(F.col(id_col)), F.lit(False))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return map_steps(d, kernel, "doc_id long, held_out boolean, score double, predicted int")
