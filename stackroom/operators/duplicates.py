"""Exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.session import bloom_joins, cut

WINDOW_BYTES = 64 * 1024


def exact_hashes(files: DataFrame, content_col: str = "content") -> DataFrame:
    """``(file_id, size, sha256)`` of every file's whole content."""
    return files.select("file_id", F.octet_length(content_col).cast("long").alias("size"), F.sha2(content_col, 256).alias("sha256"))


def size_buckets(hashes: DataFrame) -> DataFrame:
    """Sizes that more than one file has."""
    return hashes.groupBy("size").agg(F.count("*").alias("files")).where("files > 1")


def partial_fingerprint(files: DataFrame, content_col: str = "content", window: int = WINDOW_BYTES) -> DataFrame:
    """``(file_id, size, fingerprint)`` from head, middle and tail windows, offsets clamped."""
    c = F.col(content_col)
    n = F.octet_length(c)
    at = lambda off: c.substr(F.greatest(off, F.lit(0)) + 1, F.lit(window))
    parts = F.concat(at(F.lit(0)), at(F.floor(n / 2).cast("int") - window // 2), at(n - window))
    return files.select("file_id", n.cast("long").alias("size"), F.sha2(parts, 256).alias("fingerprint"))


def duplicate_keys(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("size", "sha256").agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_members(hashes: DataFrame) -> DataFrame:
    """``(file_id, size, sha256, copies, representative)`` of every file with a copy: a row each, however large the group.

    The representative is the smallest id. Groups are counted before the shuffle; the join back
    has one row a group on its other side, so a hot group is split.
    """
    groups = hashes.groupBy("size", "sha256").agg(F.count("*").alias("copies"), F.min("file_id").alias("representative")).where("copies > 1")
    return hashes.join(groups, ["size", "sha256"]).select("file_id", "size", "sha256", "copies", "representative")


def duplicate_groups(hashes: DataFrame) -> DataFrame:
    """``(size, sha256, copies, members)`` with sorted members in one row: for groups that are shown, not for unbounded ones."""
    return duplicate_members(hashes).groupBy("size", "sha256", "copies").agg(F.array_sort(F.collect_list("file_id")).alias("members"))


def duplicate_members_staged(files: DataFrame, content_col: str = "content") -> DataFrame:
    """:func:`duplicate_members` by size and fingerprint first, then full digests of the candidates.

    Ids and fingerprints are all that the first stage shuffles. Contents are read again for the
    candidates, whose ids filter the scan where Spark can make a Bloom filter of them.
    """
    prints = cut(partial_fingerprint(files, content_col), "prints")
    twice = prints.groupBy("size", "fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("size", "fingerprint")
    candidates = cut(prints.join(twice, ["size", "fingerprint"], "left_semi").select("file_id").withColumn("one", F.lit(1)), "candidates")
    with bloom_joins(files.sparkSession):
        hashed = cut(exact_hashes(files.join(candidates.where("one = 1").select("file_id"), "file_id"), content_col), "digests")
    return duplicate_members(hashed)


def duplicate_ids(hashes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Files with a copy. The copy may be missing; the file itself may not."""
    ids = hashes.join(duplicate_keys(hashes), ["size", "sha256"], "left_semi").select("file_id")
    if files is not None:
        ids = ids.join(files.where(~F.col("status").isin("missing", "unscoped")).select("file_id"), "file_id", "left_semi")
    return ids
