"""Toxicity by compression distance.

Two zstandard dictionaries are trained on windows (words) of toxic and of ordinary texts; each window is compressed
with both. Runs of zeros stand around it: a short block alone would be stored as it is, and the last bytes of a block
are never matched. How the two lengths differ says, window length by window length, how much likelier the window is in
toxic text: thresholds and weights come from texts that the dictionaries have not seen. A text's score is a calibrated
sum of its most telling windows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, is_training_row, map_steps

#: Bounds of the sample that is learnt from: toxic and ordinary texts, and bytes of a text that may be drawn.
TOXIC_TEXTS, ORDINARY_TEXTS, TEXT_BYTES = 2000, 4000, 32 << 10
#: Tried sizes of dictionaries, of their segments and of what these are chosen by; the best on unseen texts is taken.
SHAPES = ((4096, 24, 8), (2048, 16, 6), (4096, 16, 6))
#: Windows are remembered up to this number in each worker; longer ones than LONGEST bytes are cut into pieces.
REMEMBERED, LONGEST = 200_000, 64
#: Log-likelihood ratio from which a window counts, how many of a text's best windows are summed, and the sum's cap.
TELLING, BEST, CAP = 1.5, 8, 40.0
HEAD, TAIL = bytes(64), bytes(16)
#: How much commoner pieces of words are in toxic texts, as a logarithm and in standard deviations, to stand for these.
LOG_RATIO, DEVIATIONS = 1.2, 5.0
_GRAMS, _LENGTHS, _SPREAD = (5, 7), 24, 256


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words, very long ones in pieces."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def windows(text: str | None) -> list[bytes]:
    """Words with a blank on either side."""
    return [b" " + w + b" " for w in words_of(text)]


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray  # log-likelihood ratios by window length and difference of compressed lengths
    slope: float
    shift: float


class Judge(dict):
    """A model's compressors, and the cells of weights of the words that they have measured so far."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.a, self.b = _compressor(model.toxic), _compressor(model.ordinary)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        framed = HEAD + b" " + word + b" " + TAIL
        d = len(self.b(framed)) - len(self.a(framed))
        c = self[word] = min(len(word), _LENGTHS) * _SPREAD + min(_SPREAD - 1, max(0, _SPREAD // 2 + d))
        return c

    def cells(self, text: str | None) -> np.ndarray:
        w = words_of(text)
        return np.fromiter(map(self.__getitem__, w), np.int64, len(w))

    def total(self, text: str | None) -> float:
        return _total(self.model.weights, self.cells(text))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.model.slope * self.total(text) + self.model.shift))))


def _total(weights: np.ndarray, cells: np.ndarray) -> float:
    w = weights[cells]
    w = w[w > TELLING]
    return min(CAP, float(np.sort(w)[-BEST:].sum()))


def _compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content)
    p = zstandard.ZstdCompressionParameters.from_level(9, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


def _distinct(texts: list[str]) -> list[str]:
    """One text of each kind of copies: those with the same least hash of three words."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        key = min((zlib.crc32(" ".join(w[j : j + 3]).encode("utf-8", "replace")) for j in range(max(1, len(w) - 2))), default=0)
        if key not in seen:
            seen.add(key)
            out.append(t)
    return out


def _grams(texts: list[str]) -> Counter:
    found: Counter = Counter()
    for t in texts:
        words = set(windows(t))
        found.update({w[i : i + n] for w in words for n in _GRAMS for i in range(len(w) - n + 1)})
    return found


def _telling(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Pieces of words that are far commoner in toxic texts, beyond chance."""
    ct, co = _grams(toxic), _grams(ordinary)
    nt, no = len(toxic), len(ordinary)
    out = set()
    for g, c in ct.items():
        a, b, p = (c + 0.5) / (nt + 1), (co[g] + 0.5) / (no + 1), (c + co[g] + 0.5) / (nt + no + 1)
        if c > 1 and np.log(a / b) > LOG_RATIO and (a - b) / np.sqrt(p * (1 - p) * (1 / nt + 1 / no)) > DEVIATIONS:
            out.add(g)
    return out


def _joined(found: Counter, most: int = 50, together: int = 6) -> list[bytes]:
    """Training samples: windows, each up to so many times, in a fixed mixed order, some together."""
    w = [x[1:] for x, n in sorted(found.items()) for _ in range(min(n, most))]
    w = [w[i] for i in np.random.default_rng(0).permutation(len(w))]
    return [b" " + b"".join(w[i : i + together]) for i in range(0, len(w), together)]


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """A model of labelled texts, or None if there are too few to tell them apart."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    if len(toxic) < 8 or len(ordinary) < 8:
        return None
    ta, tb, oa, ob = toxic[::2], toxic[1::2], ordinary[::2], ordinary[1::2]
    # Toxic samples are the windows that hold pieces found in toxic texts far more often than in others.
    telling = _telling(ta, oa)
    has = lambda w: any(w[i : i + n] in telling for n in _GRAMS for i in range(len(w) - n + 1))
    tox = Counter(w for t in ta for w in windows(t) if has(w))
    rest = Counter(w for t in oa for w in windows(t) if not has(w))
    most = Counter(dict(sorted(rest.items(), key=lambda x: (-x[1], x[0]))[:20_000]))
    samples, others = _joined(tox), _joined(most)
    best: tuple[float, Model] | None = None
    for size, k, d in SHAPES:
        try:
            a, b = (zstandard.train_dictionary(size, x, k=k, d=d).as_bytes() for x in (samples, others))
        except zstandard.ZstdError:  # too few samples for this shape
            continue
        judge = Judge(Model(a, b, np.zeros(0), 1.0, 0.0))
        t, o = [judge.cells(x) for x in tb], [judge.cells(x) for x in ob]
        n = (_LENGTHS + 1) * _SPREAD
        x, y = (np.bincount(np.concatenate(z), minlength=n).astype(float) for z in (t, o))
        ratio = x.sum() / max(1.0, y.sum())
        weights = np.log((x + 2 * ratio) / (y + 2) / ratio)
        s = np.array([_total(weights, c) for c in t + o])
        label = np.repeat([1.0, 0.0], [len(t), len(o)])
        slope, shift = _logistic(s, label)
        p = 1 / (1 + np.exp(-(slope * s + shift)))
        loss = float(-np.mean(label * np.log(p + 1e-12) + (1 - label) * np.log(1 - p + 1e-12)))
        if best is None or loss < best[0]:
            best = (loss, Model(a, b, weights, slope, shift))
    return best[1] if best else None


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        w -= np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * np.eye(2), grad)
    return float(w[0]), float(w[1])


def training_texts(docs: DataFrame, labels: DataFrame, label: str, value: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most limit texts (of at most TEXT_BYTES) with this label, the first by a hash of the id, from training rows only."""
    ids = labels.where((F.col(label) == value) & is_training_row(F.col(id_col))).select(F.col(id_col).cast("long").alias("id")).distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(2 * limit)
    # At most 2 * limit ids are sent to the executors.
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= TEXT_BYTES)
    rows = d.join(F.broadcast(ids), "id").orderBy(F.xxhash64("id"), "id", "text").limit(limit)
    return [r.text for r in rows.select("text").collect()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    """A model from a bounded sample of training rows."""
    return fit(training_texts(docs, labels, label, 1, TOXIC_TEXTS), training_texts(docs, labels, label, 0, ORDINARY_TEXTS))


def _key(model: Model) -> tuple:
    return "toxicity", model.toxic, model.ordinary, model.weights.tobytes()


def judge_of(model: Model) -> Judge:
    """One judge for a stage in each Python process, so that windows are remembered from task to task."""
    return held(_key(model), lambda: Judge(model))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from threshold on).

    Null and empty texts have no windows and score as any text without telling ones. Without a model (too few labelled
    rows) every score is 0. Null or repeated ids are kept as rows of their own; a null id is not held out. An empty
    table gives no rows; further columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        judge = judge_of(m) if m is not None else None
        s = [judge.score(t) if judge is not None else 0.0 for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    out = F.coalesce(~is_training_row(F.col(id_col)), F.lit(False))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    return map_steps(d, kernel, "doc_id long, held_out boolean, score double, predicted int", key=_key(model) if model is not None else None)


def clean(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that score below the threshold; without a model, all. Rows as in score()."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        judge = judge_of(shared.value)
        at = batch.schema.get_field_index(text_col)
        return batch.filter(pa.array([judge.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_steps(docs, kernel, docs.schema, text=text_col, key=_key(model))
