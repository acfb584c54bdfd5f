"""Dashboards, coverage, summaries and paged views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions import paths as P
from stackroom.operators.duplicates import duplicate_ids

PAGE = 1000


def status_counts(files: DataFrame, vectors: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    """One row: files by status, total without unscoped ones, vector rows and bytes."""
    counts = files.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "indexed", "missing", "failed")), F.count_if(F.col("status") != "unscoped").alias("total"))
    size = lambda df, p: df.agg(F.count("*").alias(f"{p}_rows"), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0)).cast("long").alias(f"{p}_bytes"))
    return counts.crossJoin(size(vectors, "embedding")).crossJoin(size(chunk_vectors, "embedding_chunk"))  # one-row aggregates


def review_summary(inbox: DataFrame) -> DataFrame:
    return inbox.agg(F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") == "resolved").alias("resolved"))


def review_inbox(classifications: DataFrame, now: float = 0.0) -> DataFrame:
    """Files that need a look: below 0.80 confidence, unless already marked unknown."""
    return classifications.where((F.col("confidence") < 0.80) & ~F.array_contains("categories", "Review/Unknown")).select("file_id", F.lit("open").alias("state"), F.when(F.col("confidence") < 0.45, "needs-review").otherwise("ambiguous").alias("reason"), F.lit(now).alias("updated"))


def review_page(inbox: DataFrame, files: DataFrame, classifications: DataFrame, limit: int = 50) -> DataFrame:
    """Open items, newest first, with path and classification."""
    joined = inbox.where("state = 'open'").join(files.select("file_id", "path"), "file_id").join(classifications.select("file_id", "categories", "confidence"), "file_id", "left")
    return joined.select("file_id", "path", "reason", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "updated").orderBy(F.desc("updated"), "file_id").limit(max(1, limit))


def dashboard(files: DataFrame, inbox: DataFrame, categories: DataFrame, hashes: DataFrame, edge_count: DataFrame) -> DataFrame:
    """Seven scalars from five tables; ``edge_count`` is one row ``(graph_edges)``."""
    indexed = files.where("status = 'indexed'").select("file_id")
    groups = hashes.join(indexed, "file_id", "left_semi").groupBy("size", "sha256").count().where("count > 1")
    parts = [
        files.agg(F.count_if(F.col("status") != "unscoped").alias("total"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "missing").alias("missing")),
        inbox.agg(F.count_if(F.col("state") == "open").alias("review")),
        categories.agg(F.count_if(F.col("path") != "Review").alias("categories")),
        groups.agg(F.count("*").alias("duplicate_groups")),
        edge_count.select("graph_edges"),
    ]
    return reduce(DataFrame.crossJoin, parts)  # one-row aggregates


def kind_histogram(files: DataFrame, root: str | None = None, top: int = 16) -> DataFrame:
    rows = files if root is None else files.where(P.under(F.col("path"), root))
    return rows.groupBy("kind").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "kind").limit(top)


def project_summary(files: DataFrame, inbox: DataFrame, vectors: DataFrame, chunk_vectors: DataFrame, roots: list[str], top: int = 16) -> DataFrame:
    """One row per root: counts, files with vectors, vector rows and bytes, kinds, and a sentence.

    Roots are few (a person picks them); a file under several counts in each.
    """
    hit = files.where("status <> 'unscoped'").withColumn("root", F.explode(F.array_compact(F.array(*(F.when(P.under(F.col("path"), r), F.lit(P.strip_slash(r))) for r in roots)))))
    review = inbox.where("state = 'open'").select("file_id", F.lit(True).alias("open"))
    stored = vectors.select("file_id", F.size("vector").alias("n")).unionByName(chunk_vectors.select("file_id", F.size("vector").alias("n"))).groupBy("file_id").agg(F.count("*").alias("rows"), F.sum(F.col("n") * 4).alias("bytes"))
    wide = hit.join(review, "file_id", "left").join(stored, "file_id", "left")
    base = wide.groupBy("root").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if(F.col("open").isNotNull()).alias("review"),
        F.count_if(F.col("rows").isNotNull()).alias("with_vectors"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("vector_rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("vector_bytes"),
    )
    kinds = hit.groupBy("root", "kind").agg(F.count("*").alias("n")).groupBy("root").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind"))), 1, top).alias("k"))
    told = F.array_join(F.transform("k", lambda k: F.concat(-k["o"], F.lit(" "), k["kind"])), ", ")
    sentence = F.concat(F.col("files"), F.lit(" files, "), F.col("indexed"), F.lit(" indexed, "), F.col("missing"), F.lit(" missing, "), F.col("review"), F.lit(" to review: "), told)
    return base.join(kinds, "root").select("root", "files", "indexed", "missing", "review", "with_vectors", "vector_rows", "vector_bytes", F.map_from_entries(F.array_sort(F.transform("k", lambda k: F.struct(k["kind"], (-k["o"]).alias("n"))))).alias("kind_counts"), sentence.alias("summary"))


def fan_out(vectors: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    """Files with vectors, rows, and the largest number of rows of one file."""
    per = vectors.select("file_id").unionByName(chunk_vectors.select("file_id")).groupBy("file_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("max_rows"))


def coverage(files: DataFrame, inbox: DataFrame, roots: list[str], excluded: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(overall, by_root)`` of authorised roots; excluded rows are counted with their reasons.

    Counts skip what lies under an excluded prefix or a directory of an excluded name.
    """
    prefixes = sorted(P.strip_slash(x) for x in excluded or [])
    path = F.col("path")
    parts = F.filter(F.split(path, "/"), lambda c: c != "")
    named = F.get(F.filter(parts, lambda c: c.isin(*P.EXCLUDED_DIRECTORIES)), 0)
    prefix_hit = F.coalesce(*(F.when(P.under(path, x), F.lit("excluded-prefix:" + x.rsplit("/", 1)[-1])) for x in prefixes), F.lit(None).cast("string"))
    reason = F.coalesce(prefix_hit, F.when(named.isNotNull(), F.concat(F.lit("excluded-directory:"), named)))
    mine = reduce(lambda a, b: a | b, (P.under(path, r) for r in roots), F.lit(False))
    rows = files.where((F.col("status") != "unscoped") & mine).withColumn("reason", reason).join(inbox.where("state = 'open'").select("file_id", F.lit(True).alias("open")).distinct(), "file_id", "left")
    ok = F.col("reason").isNull()
    sums = [F.count_if(ok).alias("eligible"), F.count_if(ok & (F.col("status") == "indexed")).alias("indexed"), F.count_if(ok & F.col("open").isNotNull()).alias("review"), F.count_if(ok & (F.col("status") == "missing")).alias("missing"), F.count_if(~ok).alias("skipped")]
    overall = rows.agg(F.lit(len(roots)).alias("authorized_roots"), F.lit(len(prefixes)).alias("excluded_roots"), *sums)
    each = rows.withColumn("root", F.explode(F.array_compact(F.array(*(F.when(P.under(path, r), F.lit(P.strip_slash(r))) for r in roots)))))
    why = each.where("reason is not null").groupBy("root", "reason").agg(F.count("*").alias("n")).groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return overall, each.groupBy("root").agg(*sums).join(why, "root", "left")


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def files_page(files: DataFrame, classifications: DataFrame | None = None, *, cursor: str = "", limit: int = 200, kinds: tuple[str, ...] = (), category: str | None = None, memberships: DataFrame | None = None, root: str | None = None, duplicates_of: DataFrame | None = None) -> DataFrame:
    """A keyset page by path: predicates reach the scan, ``limit`` is clamped to 0..1000."""
    tests = [F.col("status") != "unscoped", F.col("path") > cursor]
    if kinds:
        tests.append(F.col("kind").isin(*kinds))
    if root is not None:
        tests.append(P.under(F.col("path"), root))
    rows = files.where(all_of(tests))
    if category is not None:
        rows = rows.join(memberships.where(P.under(F.col("category_path"), category)).select("file_id"), "file_id", "left_semi")
    if duplicates_of is not None:
        rows = rows.where(~F.col("status").isin("missing", "unscoped")).join(duplicate_ids(duplicates_of), "file_id", "left_semi")
    page = rows.select("file_id", "path", "kind", "size", "status").orderBy("path").limit(min(max(0, limit), PAGE))
    if classifications is not None:
        page = page.join(classifications.select("file_id", "categories", "confidence"), "file_id", "left").orderBy("path")
    return page


def clusters_page(clusters: DataFrame, *, cursor: str = "", limit: int = 200, relation: str | None = None) -> DataFrame:
    rows = clusters.where(F.col("id") > cursor)
    if relation is not None:
        rows = rows.where(F.col("relation") == relation)
    return rows.orderBy("id").limit(min(max(0, limit), PAGE))


def summaries_page(summaries: DataFrame, limit: int = 64) -> DataFrame:
    return summaries.orderBy("root").limit(min(max(1, limit), 1024))


def deepest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``(file_id, path, root)``: the longest root that holds a file.

    Joins on path prefixes, so it is an equi-join however many roots there are.
    """
    parts = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = files.select("file_id", "path", F.explode(prefix).alias("p")).withColumn("p", F.when(F.col("p") == "", "/").otherwise(F.col("p")))
    clean = roots.select(F.when(F.length("root") > 1, F.regexp_replace("root", "/$", "")).otherwise(F.col("root")).alias("p")).distinct()
    return each.join(clean, "p").groupBy("file_id", "path").agg(F.max_by("p", F.length("p")).alias("root"))
