"""Bounded, repeatable training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_by_class(rows: DataFrame, label: str, key: Column, per_class: int, max_rows: int) -> DataFrame:
    """About ``per_class`` rows of each class, those of the smallest hashes, plus column ``key``.

    Class sizes come from one aggregate; a hash threshold for each class then selects rows
    where they are, so nothing is ordered or gathered. The sample exceeds ``per_class`` by a
    tenth in expectation; callers trim what they collect.
    """
    sizes = rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_rows).collect()
    per = min(per_class, max(1, max_rows // max(1, len(sizes))))
    top = 1 << 40
    if not sizes:
        return rows.withColumn("key", key).limit(0)
    share = rows.sparkSession.createDataFrame([(r[label], int(min(1.0, 1.1 * (per + 20) / r["count"]) * top)) for r in sizes], f"`{label}` {dict(rows.dtypes)[label]}, below long")
    keyed = rows.withColumn("key", key).join(F.broadcast(share), label)
    return keyed.where(F.pmod("key", F.lit(top)) < F.col("below")).drop("below")
