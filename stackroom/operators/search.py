"""Phrase search over texts and transcripts, filters, and vector search."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions import text as T
from stackroom.functions import vectors as V
from stackroom.session import cut

LIMIT = 50
LOW_CONFIDENCE = 0.45


def postings(texts: DataFrame, *, id_col: str = "file_id", text_col: str = "body") -> DataFrame:
    """Inverted index ``(term, file_id, positions, length)``; write it partitioned by a hash of the term."""
    toks = texts.where(F.trim(text_col) != "").select(F.col(id_col).alias("file_id"), T.tokens(F.col(text_col)).alias("t"))
    terms = toks.select("file_id", F.size("t").alias("length"), F.posexplode("t").alias("position", "term"))
    return terms.groupBy("term", "file_id").agg(F.array_sort(F.collect_list("position")).alias("positions"), F.first("length").alias("length"))


def phrase_from_postings(index: DataFrame, phrase: str) -> DataFrame:
    """``(file_id, tf, length)`` from the index: only the phrase's terms are read."""
    words = T.query_tokens(phrase)
    if not words:
        return index.select("file_id", F.lit(0).alias("tf"), "length").limit(0)
    out = None
    for k, w in enumerate(words):
        one = index.where(F.col("term") == w).select("file_id", "length", F.transform("positions", lambda p: p - k).alias(f"p{k}"))
        out = one if out is None else out.join(one.drop("length"), "file_id")
    starts = reduce(F.array_intersect, (F.col(f"p{k}") for k in range(len(words))))
    return out.select("file_id", F.size(starts).alias("tf"), "length").where("tf > 0")


def phrase_hits(texts: DataFrame, phrase: str, *, id_col: str = "file_id", text_col: str = "body") -> DataFrame:
    """``(file_id, tf, length, position, tokens)`` of rows that hold the phrase; none for a blank phrase."""
    words = T.query_tokens(phrase)
    # One row per text with its tokens; a cheap test first, positions only where it holds.
    toks = texts.select(F.col(id_col).alias("file_id"), T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    hits = toks.where(T.contains_phrase(F.col("tokens"), phrase))
    if not words:
        return hits.select("file_id", F.lit(0).alias("tf"), F.lit(0).alias("length"), F.lit(0).alias("position"), "tokens")
    at = T.phrase_positions(F.col("tokens"), phrase)
    return hits.withColumn("at", at).select("file_id", F.size("at").alias("tf"), F.size("tokens").alias("length"), F.get("at", 0).alias("position"), "tokens")


def _measured(texts: DataFrame, phrase: str, id_col: str, text_col: str) -> DataFrame:
    """``(file_id, length, tf, snippet)`` of every text, from one tokenisation; the snippet only where the phrase is."""
    words = max(1, len(T.query_tokens(phrase)))
    toks = texts.select(F.col(id_col).alias("file_id"), T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    at = F.when(T.contains_phrase(F.col("tokens"), phrase), T.phrase_positions(F.col("tokens"), phrase)).otherwise(F.array().cast("array<int>"))
    return toks.withColumn("at", at).select("file_id", F.size("tokens").alias("length"), F.size("at").alias("tf"), F.when(F.size("at") > 0, T.snippet(F.col("tokens"), F.get("at", 0), words)).alias("snippet"))


def _ranked(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """``(file_id, tf, rank, ...)`` of hits ``(file_id, tf, length, ...)``; ``stats`` is one row ``(docs, avg_length, df)``."""
    rank = F.round(T.bm25(F.col("tf"), F.col("length"), F.col("docs"), F.col("df"), F.col("avg_length")), 6)
    return hits.crossJoin(F.broadcast(stats)).select("file_id", "tf", rank.alias("rank"), *[c for c in hits.columns if c not in ("file_id", "tf", "length")])


def _hits(texts: DataFrame, phrase: str, id_col: str, text_col: str) -> DataFrame:
    if not T.query_tokens(phrase):
        return texts.select(F.col(id_col).alias("file_id"), F.lit(0).alias("tf"), F.lit(0.0).alias("rank"), F.lit("").alias("snippet")).limit(0)
    every = cut(_measured(texts, phrase, id_col, text_col), "measured")
    stats = every.agg(F.count("*").alias("docs"), F.avg("length").alias("avg_length"), F.count_if(F.col("tf") > 0).alias("df"))
    return _ranked(every.where("tf > 0").select("file_id", "tf", "length", "snippet"), stats)


def bm25_search(texts: DataFrame, phrase: str, *, id_col: str = "file_id", text_col: str = "body", limit: int | None = LIMIT) -> DataFrame:
    """``(file_id, tf, rank, snippet)``, best (smallest) rank first, ties by id."""
    out = _hits(texts, phrase, id_col, text_col)
    return out.orderBy("rank", "file_id").limit(limit) if limit is not None else out


def _merged(live: DataFrame, written: DataFrame, spoken: DataFrame, limit: int) -> DataFrame:
    """Text hits, then transcript hits of files not among them: the first few of each source, then of both.

    Transcripts count only if all text hits show, so the texts that show say which files to leave out.
    """
    order = ["rank", "file_id"]
    first = cut(written.join(live, "file_id").groupBy("file_id", "path").agg(F.min(F.struct("rank", "snippet")).alias("b")).select("file_id", "path", F.lit(0).alias("src"), "b.*").orderBy(*order).limit(limit), "written")
    best = spoken.join(live, "file_id").join(F.broadcast(first.select("file_id")), "file_id", "left_anti")  # at most ``limit`` rows
    second = best.groupBy("file_id", "path").agg(F.min(F.struct("rank", "snippet")).alias("b")).select("file_id", "path", F.lit(1).alias("src"), "b.*").orderBy(*order).limit(limit)
    return first.unionByName(second).select("file_id", "path", "src", "rank", "snippet").orderBy("src", *order).limit(limit)


def exact_search(files: DataFrame, texts: DataFrame, transcripts: DataFrame, phrase: str, limit: int = LIMIT) -> DataFrame:
    """Text hits, then transcript hits of files not among them; indexed files only, ``limit`` in all.

    ``(file_id, path, src, rank, snippet)``; ``src`` is 0 for texts and 1 for transcripts.
    """
    if limit <= 0 or not T.query_tokens(phrase):
        limit = 0
    live = files.where(F.col("status") == "indexed").select("file_id", "path")
    hit = lambda df, col: _hits(df.where(F.trim(col) != ""), phrase, "file_id", col)
    return _merged(live, hit(texts, "body"), hit(transcripts, "text"), limit)


def build_index(texts: DataFrame, *, id_col: str = "file_id", text_col: str = "body") -> dict[str, DataFrame]:
    """A text index as tables to publish: ``postings`` and ``lengths`` ``(file_id, length)``. Blank texts are not indexed."""
    own = texts.where(F.trim(text_col) != "").select(F.col(id_col).alias("file_id"), T.tokens(F.col(text_col)).alias("t"))
    return {"postings": postings(texts, id_col=id_col, text_col=text_col), "lengths": own.select("file_id", F.size("t").alias("length"))}


def update_index(index: dict[str, DataFrame], texts: DataFrame, touched: DataFrame, *, id_col: str = "file_id", text_col: str = "body") -> dict[str, DataFrame]:
    """The index after files changed: all entries of ``touched`` files go, those of ``texts`` come."""
    gone = touched.select("file_id").distinct()
    fresh = build_index(texts, id_col=id_col, text_col=text_col)
    return {k: index[k].join(gone, "file_id", "left_anti").unionByName(fresh[k]) for k in index}


def search_index(index: dict[str, DataFrame], phrase: str, limit: int | None = LIMIT) -> DataFrame:
    """``(file_id, tf, rank)`` from the index alone: the phrase's terms and the lengths are read, no text."""
    hits = phrase_from_postings(index["postings"], phrase)
    stats = index["lengths"].agg(F.count("*").alias("docs"), F.avg("length").alias("avg_length")).crossJoin(hits.agg(F.count("*").alias("df")))  # one-row aggregates
    out = _ranked(hits, stats)
    return out.orderBy("rank", "file_id").limit(limit) if limit is not None else out


def transcript_text(segments: DataFrame) -> DataFrame:
    """One row per file: segment texts in start order, joined by blanks."""
    rows = F.array_sort(F.collect_list(F.struct("start", "text")))
    return segments.groupBy("file_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))


def has_transcript(segments: DataFrame, mirror: DataFrame) -> DataFrame:
    """Files with segments and an entry in the text mirror."""
    return segments.select("file_id").distinct().join(mirror.where(F.trim("text") != ""), "file_id", "left_semi")


class Filter:
    """Filters of a search: each is a semi-join on ``file_id``, applied after the limit as users see it."""

    @staticmethod
    def status(files: DataFrame, *statuses: str) -> DataFrame:
        return files.where(F.col("status").isin(*statuses)).select("file_id")

    @staticmethod
    def kind(files: DataFrame, *kinds: str) -> DataFrame:
        return files.where(F.col("kind").isin(*kinds)).select("file_id")

    @staticmethod
    def after(files: DataFrame, mtime: float) -> DataFrame:
        return files.where(F.col("mtime") > mtime).select("file_id")

    @staticmethod
    def before(files: DataFrame, mtime: float) -> DataFrame:
        return files.where(F.col("mtime") < mtime).select("file_id")

    @staticmethod
    def low_confidence(classifications: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
        return classifications.where(F.col("confidence") < threshold).select("file_id")

    @staticmethod
    def category(memberships: DataFrame, prefix: str) -> DataFrame:
        from stackroom.functions.paths import under

        return memberships.where(under(F.col("category_path"), prefix)).select("file_id").distinct()

    @staticmethod
    def duplicates(hashes: DataFrame) -> DataFrame:
        from stackroom.operators.duplicates import duplicate_ids

        return duplicate_ids(hashes)


def filtered(hits: DataFrame, *filters: DataFrame) -> DataFrame:
    return reduce(lambda df, f: df.join(f, "file_id", "left_semi"), filters, hits)


def filtered_search(files: DataFrame, texts: DataFrame, transcripts: DataFrame, phrase: str, filters: list[DataFrame], *, limit: int = LIMIT, prefilter: bool = False) -> DataFrame:
    """Search, then filters: fewer than ``limit`` rows may come back. ``prefilter`` filters first."""
    if prefilter:
        return exact_search(filtered(files, *filters), texts, transcripts, phrase, limit)
    return filtered(exact_search(files, texts, transcripts, phrase, limit), *filters).orderBy("src", "rank", "file_id")


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector)) if len(vector) <= 16 else F.split(F.lit(",".join(map(repr, map(float, vector)))), ",").cast("array<double>")


def vector_scores(vectors: DataFrame, query: list[float], model: str) -> DataFrame:
    """``(file_id, score)`` of every vector of one model space; unusable vectors drop out."""
    return vectors.where(F.col("model") == model).select("file_id", V.cosine_unit(F.col("vector"), literal(query)).alias("score")).where("score is not null")


def semantic_search(files: DataFrame, vectors: DataFrame, chunk_vectors: DataFrame | None, query: list[float], *, model: str, threshold: float = 0.30, k: int = 20) -> DataFrame:
    """``(file_id, path, score)``: best score of a file over its own and its chunks' vectors, top ``k``."""
    scores = vector_scores(vectors, query, model)
    if chunk_vectors is not None:
        scores = scores.unionByName(vector_scores(chunk_vectors, query, model))
    best = scores.where(F.col("score") >= threshold).groupBy("file_id").agg(F.max("score").alias("score"))
    live = files.where(F.col("status") == "indexed").select("file_id", "path")
    return best.join(live, "file_id").select("file_id", "path", "score").orderBy(F.desc("score"), "path").limit(k)


def feature_search(files: DataFrame, features: DataFrame, query: list[int], *, max_distance: float = 0.5, k: int = 20, distance=V.byte_distance) -> DataFrame:
    """``(file_id, path, distance)`` of the nearest feature prints, smallest distance first."""
    near = features.select("file_id", distance(F.col("feature"), literal([float(x) for x in query])).alias("distance")).where(F.col("distance") <= max_distance)
    live = files.where(F.col("status") == "indexed").select("file_id", "path")
    return near.join(live, "file_id").select("file_id", "path", "distance").orderBy("distance", "path").limit(k)


def best_visual_search(embedding_hits: DataFrame, feature_hits: DataFrame) -> DataFrame:
    """Embedding hits if there are any, else feature hits with ``1 - distance``, tagged by source.

    Decided inside the plan: feature hits survive an anti-join with a one-row marker.
    """
    marker = embedding_hits.limit(1).select(F.lit(1).alias("any"))
    first = embedding_hits.select("file_id", "path", "score", F.lit("embedding").alias("source"))
    second = feature_hits.select("file_id", "path", (1 - F.col("distance")).alias("score"), F.lit("feature-print").alias("source"), F.lit(1).alias("any")).join(F.broadcast(marker), "any", "left_anti").drop("any")
    return first.unionByName(second)


def first_non_empty(*results: DataFrame) -> DataFrame:
    """The first result that has rows, the last one if none has."""
    for df in results[:-1]:
        if not df.isEmpty():
            return df
    return results[-1]


def image_search(files: DataFrame, vectors: DataFrame, image_id: str, *, model: str, threshold: float = 0.30, k: int = 20) -> DataFrame:
    """``(file_id, path, score)`` of the images nearest to one of them, which is left out; no rows if it has no vector."""
    own = vectors.where((F.col("file_id") == image_id) & (F.col("model") == model)).select(F.col("vector").alias("query"), F.size("vector").alias("dim")).limit(1)
    others = vectors.where((F.col("model") == model) & (F.col("file_id") != image_id)).withColumn("dim", F.size("vector"))
    scored = others.join(F.broadcast(own), "dim").select("file_id", V.cosine_unit(F.col("vector"), F.col("query")).alias("score"))
    best = scored.where(F.col("score") >= threshold).groupBy("file_id").agg(F.max("score").alias("score"))
    live = files.where(F.col("status") == "indexed").select("file_id", "path")
    return best.join(live, "file_id").select("file_id", "path", "score").orderBy(F.desc("score"), "path").limit(k)


def cosine_matrix_recall(texts: DataFrame, images: DataFrame, labels: int, block: int = 1024) -> DataFrame:
    """Recall@1 of texts ``(label, vector)`` against images ``(column, vector)``; a column's label is its number modulo ``labels``.

    Both sides are dealt into blocks; a pair of blocks is one matrix product, of which each
    text's best column leaves the task.
    """
    dealt = lambda df, key, n: df.withColumn("at", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    blocks = lambda df: max(1, -(-df.count() // block))
    nt, ni = blocks(texts), blocks(images)
    left = dealt(texts, "label", nt).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(ni - 1)))).select(F.col("at").alias("i"), F.col("o").alias("j"), F.lit(True).alias("text"), F.col("label").cast("long").alias("number"), "vector")
    right = dealt(images, "column", ni).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(nt - 1)))).select(F.col("o").alias("i"), F.col("at").alias("j"), F.lit(False).alias("text"), F.col("column").cast("long").alias("number"), "vector")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        t, m = pdf[pdf["text"]], pdf[~pdf["text"]].sort_values("number", kind="mergesort")
        if t.empty or m.empty:
            return pd.DataFrame({"label": pd.Series(dtype="int64"), "column": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        unit = lambda v: (x := np.array(v.tolist(), np.float64)) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        score = unit(t["vector"]) @ unit(m["vector"]).T
        at = score.argmax(axis=1)  # the first of equals: the smallest column
        return pd.DataFrame({"label": t["number"].to_numpy(), "column": m["number"].to_numpy()[at], "score": score[np.arange(len(t)), at]})

    met = left.unionByName(right).groupBy("i", "j").applyInPandas(best, "label long, column long, score double")
    one = met.groupBy("label").agg(F.max_by("column", F.struct("score", -F.col("column"))).alias("column"))
    return one.agg(F.avg((F.col("column") % labels == F.col("label")).cast("double")).alias("recall_at_1"))
