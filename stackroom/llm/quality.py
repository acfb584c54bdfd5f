"""Quality rules: base rules and a calibrated logistic regression over hashed n-grams.

Word unigrams and bigrams and byte n-grams (two to four code units of the text as it
stands) hash into one space, weighted by log counts and normalised, beside a few dense
measures. A logistic regression is trained on a bounded sample of labelled rows; Platt
scaling on rows kept aside turns its margin into a probability, and a fixed threshold gives
the verdict. Texts are scored whole, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm import kernels as K
from stackroom.llm.sampling import sample_by_class

#: A power of two.
DIMS = 1 << 15
DENSE = 8
PER_CLASS = 1500
THRESHOLD = 0.5
PIECE = 1 << 20
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CONT = (np.arange(256) & 0xC0) == 0x80
_SYM = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_PUNCT = np.isin(np.arange(256), np.frombuffer(b"!?.,;:", np.uint8))


def measures(text: bytes | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), word hashes, byte histogram."""
    text = text or b""
    words = text.split()
    h = K.word_hashes(words)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    word_chars = int(len(text) - bytes_[_BLANK].sum() - bytes_[_CONT].sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\f")]
    repeat = 0
    if len(words) >= 4:
        w = K.rolling(h, 3)
        _, back, count = np.unique(w, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        if twice.any():
            cover = np.zeros(len(words), bool)
            for k in range(3):
                cover[k : k + len(w)] |= twice
            repeat = int(cover.sum())
    return (len(words), word_chars, int(bytes_[_SYM].sum()), len(lines) - len(set(lines)), repeat), h, bytes_


def features(text: bytes | None, dims: int = DIMS) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """Base measures, hashed dimensions (distinct) and their weights, dense ones last."""
    base, h, bytes_ = measures(text)
    text = text or b""
    # A power of two: its remainder is a mask.
    low, low64 = np.uint32(dims - 1), np.uint64(dims - 1)
    parts = [(x >> np.uint64(20) & low64).astype(np.uint32) for x in (h, K.rolling(h, 2))]
    acc = None
    for at in range(0, max(1, len(text)), PIECE):
        # Pieces overlap by three bytes; an n-gram counts in the piece it starts in.
        x = np.frombuffer(text[at : at + PIECE + 3], np.uint8).astype(np.uint32)
        run = x
        for n in range(2, 5):
            if len(run) < 2:
                break
            run = run[:-1] * np.uint32(0x01000193) + x[n - 1 :]
            parts.append((((run[:PIECE] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(12)) & low)
        own = np.bincount(np.concatenate(parts), minlength=dims) if parts else 0
        acc = own if acc is None else acc + own
        parts = []
    at = np.flatnonzero(acc != 0)
    w = np.log1p(acc[at])
    norm = np.sqrt((w * w).sum())
    w = w / norm if norm else w
    n, chars, sym, dup, rep = base
    size = max(1, len(text))
    dense = [1.0, min(1.0, chars / max(1, n) / 20), sym / max(1, n), min(1.0, dup / 5), rep / max(1, n), bytes_[_UPPER].sum() / size, bytes_[_DIGIT].sum() / size, bytes_[_PUNCT].sum() / max(1, n)]
    return base, np.concatenate((at, dims + np.arange(DENSE))), np.concatenate((w, dense))


class Model:
    """Weights, Platt coefficients and a threshold."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float, threshold: float):
        self.weights, self.slope, self.shift, self.threshold = weights, slope, shift, threshold

    def probability(self, at: np.ndarray, w: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (self.weights[at] @ w) + self.shift, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, threshold: float, *, ridge: float = 1e-4, rounds: int = 150) -> Model:
    """Full-batch logistic regression with classes of equal weight, then Platt scaling on every fifth row."""
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)

    def matrix(which, entries=500_000):
        # Chunks of rows, so that temporaries stay small beside the driver's heap.
        chunks, own, held_ = [], [], 0
        picked = [rows[i] for i in np.nonzero(which)[0]]
        for k, row in enumerate(picked):
            own.append(row)
            held_ += len(row[0])
            if held_ >= entries or k == len(picked) - 1:
                at = np.repeat(np.arange(len(own), dtype=np.int32), [len(a) for a, _ in own])
                chunks.append((at, np.concatenate([a for a, _ in own]), np.concatenate([w for _, w in own]), len(own)))
                own, held_ = [], 0
        return chunks

    def margin(m, weights):
        return np.concatenate([np.bincount(at, weights[cols] * w, minlength=n) for at, cols, w, n in m])

    def slopes(m, error):
        out, first = np.zeros(dims + DENSE), 0
        for at, cols, w, n in m:
            out += np.bincount(cols, error[first : first + n][at] * w, minlength=dims + DENSE)
            first += n
        return out

    size = dims + DENSE
    weights, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    fit = matrix(~held)
    target = y[~held]
    balance = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    for t in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-margin(fit, weights))) - target) * balance
        grad = slopes(fit, error) + ridge * weights
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        weights -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-10)
    check = matrix(held) if held.any() and 0 < y[held].sum() < held.sum() else fit
    own = y[held] if check is not fit else target
    z = margin(check, weights)
    soft = np.where(own == 1, (own.sum() + 1) / (own.sum() + 2), 1 / ((1 - own).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method in two dimensions
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([((p - soft) * z).sum(), (p - soft).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    return Model(weights, max(slope, 1e-3), shift, threshold)


def _vectors(dims):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                # Six bytes for each feature: what reaches the driver is small and bounded by the sample.
                packed = [d.astype(np.uint16).tobytes() + w.astype(np.float32).tobytes() for _, d, w in (features(t, dims) for t in K.raw(part.column(2)))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(packed, pa.binary())], names=["label", "key", "packed"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", dims: int = DIMS, per_class: int = PER_CLASS, threshold: float = THRESHOLD, seed: int = 11) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, 0 or 1).

    At most ``per_class`` labelled rows of each class are used, so the sampled labels are
    small enough to broadcast. None (the base rules alone decide) unless both classes occur.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("long").alias("label"))
    # Rows that repeat an id are one row of the sample, whose bound then holds whatever is repeated.
    picked = sample_by_class(usable, "label", F.xxhash64(F.lit(seed), F.col("doc_id")), per_class, 2 * per_class).dropDuplicates(["label", "key"])
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("label", "key").agg(F.min("text").alias("text"))
    rows = rows.mapInArrow(_vectors(dims), "label long, key long, packed binary").collect()
    rows.sort(key=lambda r: (r["key"], r["label"], bytes(r["packed"])))
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    sparse = []
    for r in rows:
        n = len(r["packed"]) // 6
        sparse.append((np.frombuffer(r["packed"], np.uint16, n), np.frombuffer(r["packed"], np.float32, n, 2 * n)))
    return train(sparse, y, dims, threshold)


def judge(text: bytes | None, model: Model | None, dims: int = DIMS) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability)."""
    base, at, w = features(text, dims)
    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
    p = model.probability(at, w) if model else 1.0
    return (*base, failed, not failed and (model is None or p >= model.threshold), p)


def _score(model, dims):
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())])

    def run(batches):
        for batch in batches:
            rows = list(zip(*(judge(t, model, dims) for t in K.raw(batch.column(1))))) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(rows, list(schema)[1:]))], schema=schema)

    return run


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS) -> DataFrame:
    """Base measures and verdict, one row for each row of ``docs``.

    Null and empty texts have no words and fail the base rules. Texts count whole, however
    long. A probability at the threshold passes. Ids are whole numbers or null. Repeated rows
    get the same verdict; other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_score(model, dims), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def _filter(model, dims):
    def run(batches):
        for batch in batches:
            texts = K.raw(batch.column("text"))
            yield batch.filter(pa.array([judge(t, model, dims)[6] for t in texts], pa.bool_()))

    return run


def keep_good(docs: DataFrame, model: Model | None, *, dims: int = DIMS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return docs.mapInArrow(_filter(model, dims), docs.schema)
