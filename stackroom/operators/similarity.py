"""Similarity graph: edges from adapters, clusters by relation, incremental updates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackroom.functions import vectors as V
from stackroom.operators.components import connected_components
from stackroom.session import cut

NEAR, SEMANTIC = "nearDuplicate", "semantic"


def canonical(edges: DataFrame) -> DataFrame:
    """Ends in order, one edge for each (a, b, relation, signal): that of the highest score."""
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "relation", "signal")
        .where("a <> b and score is not null and not isnan(score)")
        .groupBy("a", "b", "relation", "signal")
        .agg(F.max("score").alias("score"))
        .select("a", "b", "score", "relation", "signal")
    )


def _edge(relation: str, signal: str | Column) -> list:
    return [F.lit(relation).alias("relation"), (F.lit(signal) if isinstance(signal, str) else signal).alias("signal")]


def exact_edges(nodes: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Edges between nodes ``(id, exact_hash)`` of one hash, score 1."""
    left = nodes.where("exact_hash is not null").select(F.col("id").alias("a"), "exact_hash")
    if changed is not None:
        left = left.join(changed.select(F.col("id").alias("a")), "a", "left_semi")
    right = nodes.where("exact_hash is not null").select(F.col("id").alias("b"), "exact_hash")
    test = F.col("a") < F.col("b") if changed is None else F.col("a") != F.col("b")
    return left.join(right, "exact_hash").where(test).select("a", "b", F.lit(1.0).alias("score"), *_edge(NEAR, "exactHash"))


def exact_edge_count(nodes: DataFrame) -> DataFrame:
    """One row ``(graph_edges)``: how many edges :func:`exact_edges` has, without making them."""
    sizes = nodes.where("exact_hash is not null").groupBy("exact_hash").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("graph_edges"))


def exact_family_edges(nodes: DataFrame) -> DataFrame:
    """The same components with one edge a node: each to the smallest of its hash. For large families."""
    own = nodes.where("exact_hash is not null")
    first = own.groupBy("exact_hash").agg(F.min("id").alias("b"))
    return own.join(first, "exact_hash").where("id <> b").select(F.col("b").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"), *_edge(NEAR, "exactHash"))


def feature_edges(nodes: DataFrame, *, threshold: float = 0.50, scorer: Callable[[Column, Column], Column] = V.position_agreement, changed: DataFrame | None = None, block: int = 2048) -> DataFrame:
    """Edges between feature prints ``(id, feature)`` whose score reaches the threshold (exact, all pairs, in blocks of about ``block``).

    The default scorer compares two blocks at a time in numpy; any other is evaluated by Spark, pair by pair.
    """
    if scorer is V.position_agreement:
        pairs = _agreeing(nodes, changed, threshold, block)
    else:
        blocks = max(1, -(-nodes.where("feature is not null").count() // block))
        met = _pairs(nodes.where("feature is not null").select("id", F.col("feature").alias("x")), changed, blocks)
        pairs = met.select("a", "b", scorer(F.col("xa"), F.col("xb")).cast("double").alias("score")).where(F.col("score") >= threshold)
    return pairs.select("a", "b", "score", *_edge(NEAR, "featurePrint"))


def _agreeing(nodes: DataFrame, changed: DataFrame | None, threshold: float, block: int) -> DataFrame:
    """``(a, b, score)`` of pairs whose share of equal positions reaches the threshold.

    A group holds two blocks of prints of one size, whose values become small numbers, and counts
    equal positions a few rows at a time. Prints that are empty or hold a null have no score.
    """
    usable = nodes.where((F.size("feature") > 0) & ~F.exists("feature", lambda x: x.isNull())).select("id", F.size("feature").alias("dim"), "feature")
    blocks = max(1, -(-usable.count() // block))
    own = usable.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    to = lambda rows, o, i, j, side: rows.withColumn("o", F.explode(o)).select("dim", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "id", "feature")
    first, last = F.lit(0), F.lit(blocks - 1)
    everything = changed is None
    if everything:
        left = to(own, F.sequence(F.col("k"), last), "k", "o", 0)
        right = to(own.where("k > 0"), F.sequence(first, F.col("k") - 1), "o", "k", 1)
    else:
        left = to(own.join(changed.select("id"), "id", "left_semi"), F.sequence(first, last), "k", "o", 0)
        right = to(own, F.sequence(first, last), "o", "k", 1)

    def kernel(key_, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = key_
        side = pdf["side"].to_numpy()
        ids, values = pdf["id"].to_numpy(), np.stack(pdf["feature"].to_numpy())
        kinds, codes = np.unique(values, return_inverse=True)
        codes = codes.reshape(values.shape).astype(np.min_scalar_type(len(kinds)))
        alone = everything and i == j
        p, q = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        x, y = codes[p], np.ascontiguousarray(codes[q].T)
        enough = np.arange(dim + 1) / dim >= threshold  # the score as Spark would divide it
        least = int(np.argmax(enough)) if enough.any() else dim + 1
        found = []
        for at in range(0, len(x), 64) if len(q) else ():
            same = np.zeros((len(x[at : at + 64]), len(q)), np.min_scalar_type(dim))
            for d in range(dim):
                same += x[at : at + 64, d, None] == y[d]
            r, k = np.nonzero(same >= least)
            found.append((p[at + r], q[k], same[r, k]))
        r, k, n = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int),) * 3
        a, b = ids[r], ids[k]
        keep = a < b if alone else a != b
        return pd.DataFrame({"a": a[keep], "b": b[keep], "score": n[keep] / dim})

    id_type = dict(usable.dtypes)["id"]
    met = left.unionByName(right).groupBy("dim", "i", "j").applyInPandas(kernel, f"a {id_type}, b {id_type}, score double")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def embedding_edges(vectors: DataFrame, *, threshold: float = 0.75, exclude: tuple[str, ...] = ("dinov3",), changed: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """Edges between unit vectors ``(id, model, vector)`` of one model space: exact, all pairs.

    Vectors are dealt into blocks of about ``block`` rows; a pair of blocks is one matrix product
    in double precision, and only pairs at the threshold leave it. Empty and non-finite vectors
    and pairs of unequal size have no edge.
    """
    usable = vectors.where(~F.col("model").isin(*exclude) & (F.size("vector") > 0) & V.finite(F.col("vector"))).select("id", "model", F.size("vector").alias("dim"), "vector")
    key = ["model", "dim"]

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
        return rows.join(n, key).withColumn(name, F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumnRenamed("n", f"n{name}")

    own = dealt(usable, "k")
    to = lambda rows, i, j, side: rows.select(*key, i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "id", "vector")
    last = F.col("nk") - 1
    if changed is None:
        left = to(own.withColumn("o", F.explode(F.sequence(F.col("k"), last))), F.col("k"), F.col("o"), 0)
        right = to(own.where("k > 0").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))), F.col("o"), F.col("k"), 1)
    else:
        fresh = dealt(usable.join(changed.select("id"), "id", "left_semi"), "k")
        counts = own.select(*key, F.col("nk").alias("others")).distinct()
        left = to(fresh.join(counts, key).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1))), F.col("k"), F.col("o"), 0)
        blocks = fresh.select(*key, F.col("nk").alias("fresh")).distinct()
        right = to(own.join(blocks, key).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("fresh") - 1))), F.col("o"), F.col("k"), 1)

    everything = changed is None

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        alone = everything and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        if alone:
            b = a
        if a.empty or b.empty:
            return pd.DataFrame({"a": a["id"][:0], "b": b["id"][:0], "score": np.empty(0)})
        x, y = np.array(a["vector"].tolist(), np.float64), np.array(b["vector"].tolist(), np.float64)
        score = np.clip(x @ y.T, -1.0, 1.0)
        p, q = np.nonzero(score >= threshold)
        ia, ib = a["id"].to_numpy()[p], b["id"].to_numpy()[q]
        keep = ia < ib if alone else ia != ib
        return pd.DataFrame({"a": ia[keep], "b": ib[keep], "score": score[p, q][keep]})

    id_type = dict(usable.dtypes)["id"]

    def named(key_, pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(pdf).assign(model=key_[0])[["a", "b", "model", "score"]]

    met = left.unionByName(right).groupBy("model", "dim", "i", "j").applyInPandas(named, f"a {id_type}, b {id_type}, model string, score double")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", *_edge(SEMANTIC, F.concat(F.lit("embedding:"), F.col("model"))))


def _pairs(nodes: DataFrame, changed: DataFrame | None, blocks: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs a < b of nodes, or of changed nodes with all others, by an equi-join on block pairs.

    Each node goes to ``blocks`` of the block pairs, so every pair meets exactly once, in a
    task that holds two blocks: no broadcast and no cross join.
    """
    keys = keys or []
    own = nodes.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    all_ = F.sequence(F.lit(0), F.lit(blocks - 1))
    if changed is None:
        left = own.withColumn("o", F.explode(F.sequence(F.col("k"), F.lit(blocks - 1)))).select(*keys, F.col("k").alias("i"), F.col("o").alias("j"), F.col("id").alias("a0"), F.col("x").alias("x0"))
        right = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k")))).select(*keys, F.col("o").alias("i"), F.col("k").alias("j"), F.col("id").alias("b0"), F.col("x").alias("x1"))
        met = left.join(right, [*keys, "i", "j"]).where("(i < j) or (a0 < b0)")
    else:
        fresh = own.join(changed.select("id"), "id", "left_semi")
        left = fresh.withColumn("j", F.explode(all_)).select(*keys, "j", F.col("id").alias("a0"), F.col("x").alias("x0"))
        right = own.select(*keys, F.col("k").alias("j"), F.col("id").alias("b0"), F.col("x").alias("x1"))
        met = left.join(right, [*keys, "j"]).where("a0 <> b0")
    swap = F.col("a0") > F.col("b0")
    return met.select(*keys, F.least("a0", "b0").alias("a"), F.greatest("a0", "b0").alias("b"), F.when(swap, F.col("x1")).otherwise(F.col("x0")).alias("xa"), F.when(swap, F.col("x0")).otherwise(F.col("x1")).alias("xb"))


def lsh_embedding_edges(vectors: DataFrame, *, threshold: float = 0.75, dim: int, bands: int = 16, bits: int = 8, seed: int = 1) -> DataFrame:
    """Opt-in blocking by random hyperplanes (Charikar 2002) with an exact check; may lose recall."""
    import random

    rng = random.Random(seed)
    keys = []
    for band in range(bands):
        planes = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(bits)]
        sign = lambda p: (V.dot(F.col("vector"), F.split(F.lit(",".join(map(repr, p))), ",").cast("array<double>")) >= 0).cast("long")
        keys.append(F.struct(F.lit(band).alias("band"), reduce(lambda a, b: a * 2 + b, map(sign, planes)).alias("bucket")))
    placed = vectors.select("id", "model", "vector", F.explode(F.array(*keys)).alias("key"))
    left = placed.select("model", "key", F.col("id").alias("a"), F.col("vector").alias("xa"))
    right = placed.select("model", "key", F.col("id").alias("b"), F.col("vector").alias("xb"))
    met = left.join(right, ["model", "key"]).where("a < b").dropDuplicates(["a", "b", "model"])
    return met.select("a", "b", "model", V.cosine_unit(F.col("xa"), F.col("xb")).alias("score")).where(F.col("score") >= threshold).select("a", "b", "score", *_edge(SEMANTIC, F.concat(F.lit("embedding:"), F.col("model"))))


def edge_scan(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """Edges, of one relation if named, ordered by ends, relation and signal."""
    rows = edges if relation is None else edges.where(F.col("relation") == relation)
    return rows.orderBy("a", "b", "relation", "signal")


def build_edges(*adapters: DataFrame) -> DataFrame:
    """The union of what adapters found, canonical."""
    return canonical(reduce(DataFrame.unionByName, adapters))


def clusters(edges: DataFrame, nodes: DataFrame | None = None, *, min_score: float = 0.50) -> DataFrame:
    """Families of each relation: ``(id, relation, representative, confidence, reason, members)``.

    Relations never mix. The confidence is the weakest edge's score; the representative has the
    largest sum of scores, then node confidence, then the smallest id; the reason is the signal of
    the strongest edge. Ids depend on the members alone.
    """
    kept = cut(canonical(edges).where(F.col("score") >= min_score), "kept-edges")
    # One run for all relations: prefixed ids keep them apart.
    tag = lambda c: F.concat_ws("\u001f", "relation", c)
    comps = connected_components(kept.select(tag("a").alias("a"), tag("b").alias("b")), contract=False)
    comps = comps.select(F.substring_index("node", "\u001f", 1).alias("relation"), F.substring_index("node", "\u001f", -1).alias("node"), F.substring_index("component", "\u001f", -1).alias("component"))
    comps = cut(comps, "components")
    by_edge = kept.join(comps.withColumnRenamed("node", "a"), ["relation", "a"])
    facts = by_edge.groupBy("relation", "component").agg(F.min("score").alias("confidence"), F.max_by("signal", F.struct("score", "signal")).alias("signal"))
    degree = kept.select("relation", F.col("a").alias("node"), "score").unionByName(kept.select("relation", F.col("b").alias("node"), "score")).groupBy("relation", "node").agg(F.sum(F.col("score").cast("decimal(38,12)")).alias("degree"))
    ranked = comps.join(degree, ["relation", "node"])
    if nodes is not None:
        ranked = ranked.join(nodes.select(F.col("id").alias("node"), F.col("confidence").alias("node_confidence")), "node", "left")
    else:
        ranked = ranked.withColumn("node_confidence", F.lit(None).cast("double"))
    order = F.struct(-F.col("degree"), -F.coalesce("node_confidence", F.lit(0.0)), F.col("node"))
    members = ranked.groupBy("relation", "component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.min_by("node", order).alias("representative"))
    return members.join(facts, ["relation", "component"]).select(cluster_id(F.col("relation"), F.col("members")).alias("id"), "relation", "representative", "confidence", F.concat(F.lit("connected by "), "signal").alias("reason"), "members")


def cluster_id(relation: Column, members: Column) -> Column:
    """A stable identifier of relation and sorted members: 16 hex digits of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", relation, F.array_join(F.array_sort(members), "|")), 256), 1, 16)


def updated_edges(edges: DataFrame, changed: DataFrame, removed: DataFrame, rescored: DataFrame) -> DataFrame:
    """Edges after a change: those of changed or removed nodes go, rescored ones come."""
    touched = changed.select("id").unionByName(removed.select("id")).distinct()
    for end in ("a", "b"):
        edges = edges.join(touched.withColumnRenamed("id", end), end, "left_anti")
    gone = removed.select("id")
    for end in ("a", "b"):
        rescored = rescored.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return canonical(edges.select("a", "b", "score", "relation", "signal").unionByName(rescored.select("a", "b", "score", "relation", "signal")))


def update_graph(edges: DataFrame, nodes: DataFrame, vectors: DataFrame, changed: DataFrame, removed: DataFrame, *, threshold: float = 0.75, min_score: float = 0.50) -> tuple[DataFrame, DataFrame]:
    """``(edges, clusters)`` after files changed or went: their edges go, they are scored anew, all is clustered again.

    ``nodes`` ``(id, exact_hash)`` and ``vectors`` ``(id, model, vector)`` are the current ones.
    """
    gone = lambda df: df.join(removed.select("id").distinct(), "id", "left_anti")
    touched = gone(changed.select("id").distinct())
    rescored = build_edges(exact_edges(gone(nodes), touched).select("a", "b", "score", "relation", "signal"), embedding_edges(gone(vectors), threshold=threshold, changed=touched))
    after = cut(updated_edges(edges, changed, removed, rescored), "edges")
    return after, clusters(after, min_score=min_score)


def wide_nodes(files: DataFrame, hashes: DataFrame, features: DataFrame, vectors: DataFrame, classifications: DataFrame) -> DataFrame:
    """One row for each indexed file: hash, feature print, model -> vector map, confidence (0 by default)."""
    maps = vectors.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "vector")))).alias("embeddings"))
    return (
        files.where(F.col("status") == "indexed")
        .select("file_id")
        .join(hashes.select("file_id", F.col("sha256").alias("exact_hash")), "file_id", "left")
        .join(features.select("file_id", "feature"), "file_id", "left")
        .join(maps, "file_id", "left")
        .join(classifications.select("file_id", "confidence"), "file_id", "left")
        .select(F.col("file_id").alias("id"), "exact_hash", "feature", "embeddings", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    )


def organization_graph(files: DataFrame, memberships: DataFrame, review_ids: DataFrame, cluster_rows: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the typed organisation graph."""
    from stackroom.functions.paths import basename, category_path

    node = lambda p, c: F.concat(F.lit(p + ":"), c)
    known = files.select("file_id")
    file_nodes = files.select(node("file", F.col("file_id")).alias("id"), basename(F.col("path")).alias("label"), F.when(F.coalesce("kind", F.lit("")) == "", "file").otherwise(F.col("kind")).alias("kind"))
    missing = files.where(F.col("status") == "missing").select(node("file", F.col("file_id")).alias("source_id"), F.lit("category:Missing").alias("target_id"), F.lit("missing").alias("relation"), F.lit(1.0).alias("weight"))
    review = known.join(review_ids.select("file_id").distinct(), "file_id", "left_semi").select(node("file", F.col("file_id")).alias("source_id"), F.lit("category:Review").alias("target_id"), F.lit("review").alias("relation"), F.lit(1.0).alias("weight"))
    named = memberships.join(known, "file_id", "left_semi").withColumn("p", category_path(F.col("category_path"))).where("p <> ''")
    in_category = named.select(node("file", F.col("file_id")).alias("source_id"), node("category", F.col("p")).alias("target_id"), F.lit("category").alias("relation"), F.lit(1.0).alias("weight"))
    member = cluster_rows.where("id <> '' and not isnan(confidence)").select("id", "relation", "confidence", F.explode("members").alias("file_id")).join(known, "file_id", "left_semi")
    near = F.col("relation") == NEAR
    in_cluster = member.select(node("file", F.col("file_id")).alias("source_id"), node("cluster", F.col("id")).alias("target_id"), F.when(near, "duplicate").otherwise("semantic").alias("relation"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("weight"))
    status_nodes = missing.select("target_id").unionByName(review.select("target_id")).distinct().select(F.col("target_id").alias("id"), F.substring_index("target_id", ":", -1).alias("label"), F.lit("status").alias("kind"))
    # A category that bears a status' name shadows it, as a later write would.
    category_nodes = named.select(node("category", F.col("p")).alias("id"), F.col("p").alias("label"), F.lit("category").alias("kind")).distinct()
    cluster_nodes = member.select(node("cluster", F.col("id")).alias("id"), F.when(near, "Near-duplicate family").otherwise("Semantic cluster").alias("label"), F.lit("similarity").alias("kind")).distinct()
    nodes = file_nodes.unionByName(status_nodes.join(category_nodes, "id", "left_anti")).unionByName(category_nodes).unionByName(cluster_nodes)
    edges = reduce(DataFrame.unionByName, [missing, review, in_category, in_cluster])
    if extra is not None:
        sound = extra.where("not isnan(weight) and weight >= 0 and weight < double('infinity')")
        for end in ("source_id", "target_id"):
            sound = sound.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        edges = edges.unionByName(sound.select("source_id", "target_id", "relation", "weight"))
    return nodes, edges.groupBy("source_id", "target_id", "relation").agg(F.max("weight").alias("weight"))


def representatives(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """``(component, representative)`` by weighted degree, ties to the smallest id."""
    degree = edges.select(F.col("a").alias("node"), "score").unionByName(edges.select(F.col("b").alias("node"), "score")).groupBy("node").agg(F.sum("score").alias("degree"))
    best = Window.partitionBy("component").orderBy(F.desc(F.round("degree", 9)), "node")
    return comps.join(degree, "node").withColumn("n", F.row_number().over(best)).where("n = 1").select("component", F.col("node").alias("representative"))
