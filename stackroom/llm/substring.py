"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A window is ``width`` consecutive words. Every window has an anchor, the smallest hash of
the ``anchor``-word runs inside it, so equal windows have equal anchors. Spark counts
anchors first, about one for each twenty words: a window under an anchor that only one
document holds has a count of one, and its hash need not travel. The hashes of all other
windows are counted in Spark, and overlapping repeated windows merge into maximal removal
intervals. No window is skipped that could repeat.

Documents with the same words form a class; all but the smallest id lose everything a
window covers, so only that one's windows are hashed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm import kernels as K
from stackroom.session import cut, drop_scratch, release

WIDTH = 50
ANCHOR = 8


def anchors_of(h: np.ndarray, width: int, anchor: int) -> np.ndarray:
    """The anchor of every window, in order."""
    return K.sliding_min(K.rolling(h, anchor), width - anchor + 1)


def merge(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals covered by windows that begin at ``starts`` (sorted, distinct)."""
    if not len(starts):
        return []
    gap = np.nonzero(np.diff(starts) > width)[0]
    first = np.concatenate((starts[:1], starts[gap + 1]))
    last = np.concatenate((starts[gap], starts[-1:])) + width
    return list(zip(first.tolist(), last.tolist()))


def _features(width, anchor):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("fp", pa.binary()), ("anchors", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            n, fp, own = [], [], []
            for text in K.raw(batch.column(1)):
                words = text.split() if text else []
                n.append(len(words))
                if len(words) < width:
                    fp.append(None)
                    own.append(np.empty(0, np.int64))
                    continue
                h = K.word_hashes(words)
                fp.append(xxhash.xxh3_128_digest(h.tobytes()))
                own.append(K.signed(np.unique(anchors_of(h, width, anchor))))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), K.long_lists(own)], schema=schema)

    return run


def _windows(width, anchor):
    schema = pa.schema([("w", pa.int64()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy()
            for doc, text, wanted in zip(ids, K.raw(batch.column(1)), K.list_rows(batch.column(2))):
                h = K.word_hashes(text.split())
                own = anchors_of(h, width, anchor)
                at = np.nonzero(np.isin(own, K.unsigned(np.ascontiguousarray(wanted))))[0]
                if len(at):
                    w = K.rolling(h, width)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(w)), pa.array(K.signed(own[at])), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32))], schema=schema)

    return run


def _apply(width, texts):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("intervals", pa.list_(pa.int64())), *([("kept_text", pa.string())] if texts else [])])

    def run(batches):
        for batch in batches:
            rows = []
            for text, whole, starts in zip(K.raw(batch.column(1)), batch.column(2).to_pylist(), K.list_rows(batch.column(3))):
                words = text.split() if text else []
                spans = [(0, len(words))] if whole and len(words) >= width else merge(np.unique(starts), width) if starts is not None else []
                keep = np.ones(len(words), bool)
                for a, b in spans:
                    keep[a:b] = False
                kept = b" ".join(w for w, k in zip(words, keep.tolist()) if k) if spans else b" ".join(words)
                rows.append((len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), np.array(spans, np.int64).ravel(), kept if texts else None))
            cols = list(zip(*rows)) or [[]] * 5
            out = [batch.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), K.long_lists(list(cols[3]))]
            if texts:
                out.append(pa.array(cols[4], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """Rows ``(doc_id, n_words, n_removed, kept_sha256, intervals[, kept_text])``, one for each row of ``docs``.

    A word goes if a window over it, as it stands in the input, also starts in a document
    with a smaller id. ``intervals`` lists start and end (exclusive) word positions. Null
    and empty texts have no words. A null id neither removes nor loses anything. Rows that
    repeat an id with the same text get the same result; with other texts under one id, a
    position removed in one is removed in all. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = cut(base.where("doc_id is not null").mapInArrow(_features(width, anchor), "doc_id long, n_words long, fp binary, anchors array<long>"), "anchors").where("fp is not null")
    classes = cut(feats.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").select("fp", "rep"), "classes")
    ranked = feats.join(classes, "fp", "left")
    copies = ranked.where("rep < doc_id").select("doc_id", F.lit(True).alias("whole")).distinct()
    entries = ranked.where("rep is null or rep = doc_id").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = cut(entries.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("anchor"), "shared")
    wanted = entries.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("wanted"))
    windows = cut(base.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_windows(width, anchor), "w long, anchor long, doc_id long, pos int"), "windows")
    release(docs.sparkSession)
    firsts = cut(windows.groupBy("w", "anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("w", "anchor", "first"), "firsts")
    starts = windows.join(firsts, ["w", "anchor"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_list(F.col("pos").cast("long")).alias("starts"), F.lit(False).alias("whole"))
    cuts = cut(starts.select("doc_id", "whole", "starts").unionByName(copies.withColumn("starts", F.lit(None).cast("array<long>"))), "cuts")
    for table in (feats, windows, firsts):
        drop_scratch(docs.sparkSession, table)
    release(docs.sparkSession)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<long>" + (", kept_text string" if texts else "")
    return base.join(cuts, "doc_id", "left").select("doc_id", "text", "whole", "starts").mapInArrow(_apply(width, texts), schema)
