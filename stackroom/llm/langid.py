"""Language identification by nearest centroid.

N-grams of one to four bytes of the UTF-8 text (A-Z lower-cased; runs of blanks, digits and
ASCII punctuation folded to one blank) hash into a fixed number of dimensions. A document's vector is its log-scaled counts times
inverse document frequency, normalised. Each language has several centroids, found by
spherical k-means on its training rows; a document takes the language of the centroid of
highest cosine, and is marked ``rejected`` when it is farther from every centroid than all
but a small share of that language's training rows.

The classifier is fitted on a bounded sample of labelled rows, ``per_language`` documents
for each language in the order of a seeded hash; every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.llm import kernels as K
from stackroom.llm.sampling import sample_by_class

DIMS = 4096
PER_LANGUAGE = 400
CENTROIDS = 4
PIECE = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
for _c in b"0123456789!\"#$%&()*+,-./:;<=>?@[]^_{|}~\\`":
    _FOLD[_c] = 32


def counts_of(text: bytes, dims: int = DIMS) -> np.ndarray:
    """Hashed counts of byte n-grams of length 1 to 4 over the whole text.

    Long texts go in pieces that overlap by three bytes; each n-gram counts in the piece it
    starts in, so the pieces leave no trace.
    """
    out = np.zeros(dims, np.float64)
    folded = _FOLD[np.frombuffer(text, np.uint8)]
    if len(folded):
        blank = folded == 32
        folded = folded[~(blank & np.concatenate(([False], blank[:-1])))]
    for at in range(0, len(folded), PIECE):
        x = folded[at : at + PIECE + 3].astype(np.uint32)
        acc = x
        for n in range(1, 5):
            if n > 1:
                if len(acc) < 2:
                    break
                acc = acc[:-1] * np.uint32(0x01000193) + x[n - 1 :]
            h = ((acc[:PIECE] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
            out += np.bincount(h % np.uint32(dims), minlength=dims)
    return out


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _rows(counts: list[np.ndarray]) -> np.ndarray:
    return np.log1p(np.array(counts))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next the row farthest from all."""
    centres = [_unit(x.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[int((x @ np.array(centres).T).max(axis=1).argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


class Model:
    """IDF weights, unit centroids with their languages, and a rejection radius for each language."""

    def __init__(self, vectors: np.ndarray, langs: list[str], k: int, reject: float):
        self.idf = np.log((1 + len(vectors)) / (1 + (vectors > 0).sum(axis=0))) + 1.0
        x = _unit(vectors * self.idf)
        own = np.array(langs)
        centroids, names = [], []
        for lang in sorted(set(langs)):
            c = _cluster(x[own == lang], k)
            centroids.append(c)
            names += [lang] * len(c)
        self.centroids, self.names = np.concatenate(centroids), names
        best = (x @ self.centroids.T).max(axis=1)
        self.floor = {lang: float(np.quantile(best[own == lang], reject)) for lang in set(langs)}

    def predict(self, counts: list[np.ndarray]) -> list[tuple[str, float, bool]]:
        scores = _unit(_rows(counts) * self.idf) @ self.centroids.T
        at = scores.argmax(axis=1)
        return [(self.names[j], float(min(1.0, max(0.0, s[j]))), bool(s[j] < self.floor[self.names[j]])) for s, j in zip(scores, at.tolist())]


def _vectors(dims):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                counts = [counts_of(t, dims) for t in K.raw(part.column(2))]
                packed = [c.astype(np.float32).tobytes() for c in counts]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), pa.array(packed, pa.binary())], names=["lang", "key", "packed"])

    return run


def fit(labelled: DataFrame, *, dims: int = DIMS, per_language: int = PER_LANGUAGE, max_rows: int = 4000, centroids: int = CENTROIDS, reject: float = 0.005, seed: int = 7) -> Model | None:
    """A model from rows ``(doc_id, text, lang)``; None if no row has a language and a letter.

    At most ``per_language`` rows a language and ``max_rows`` in all are used.
    """
    usable = labelled.where(F.col("lang").isNotNull())
    rows = sample_by_class(usable, "lang", F.xxhash64(F.lit(seed), F.col("doc_id")), per_language, max_rows)
    # Rows that repeat an id are one row of the sample, whose bound then holds whatever is repeated.
    rows = rows.where(_has_letter()).groupBy("lang", "key").agg(F.min("text").alias("text"))
    rows = rows.select("lang", "key", "text").mapInArrow(_vectors(dims), "lang string, key long, packed binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["key"], bytes(r["packed"])))
    langs = [r["lang"] for r in rows]
    rows = [r for i, r in enumerate(rows) if i < per_language or langs[i - per_language] != langs[i]]
    if not rows:
        return None
    vectors = np.array([np.frombuffer(r["packed"], np.float32) for r in rows], np.float64)
    return Model(np.log1p(vectors), [r["lang"] for r in rows], centroids, reject)


def _score(model, dims, unknown):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                letters = part.column(2).to_pylist()
                texts = K.raw(part.column(1))
                todo = [i for i, ok in enumerate(letters) if ok and model is not None]
                got = [(unknown, 0.0, True)] * len(texts)
                if todo:
                    for i, r in zip(todo, model.predict([counts_of(texts[i], dims) for i in todo])):
                        got[i] = r
                cols = list(zip(*got))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], schema=schema)

    return run


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS, unknown: str = "und") -> DataFrame:
    """Rows ``(doc_id, lang_pred, score, rejected)``, one for each row of ``docs``.

    ``unknown`` where the text is null or has no letter, or without a model. Only id and
    text are read, whatever other columns are named. Texts count whole, however long. Ids are
    whole numbers or null. Languages that tie go by their name. Repeated rows get the same
    answer; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.withColumn("letter", _has_letter()).mapInArrow(_score(model, dims, unknown), "doc_id long, lang_pred string, score double, rejected boolean")
