"""Rows that repeat, told apart and spread out: one hot row never becomes one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.session import cut

#: Copies that one task may write out for a row.
RUN = 4096


def spread_out(counted: DataFrame, count: str, start: Column | None = None) -> DataFrame:
    """``counted`` with a row for each of its ``count`` copies, numbered by a new column ``copy`` from ``start`` (0).

    Rows of more than ``RUN`` copies are dealt to other tasks in runs first.
    """
    first = F.lit(0).cast("long") if start is None else start
    few = counted.where(F.col(count) <= RUN).withColumn("copy", F.explode(F.sequence(first, first + F.col(count) - 1)))
    many = counted.where(F.col(count) > RUN).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / RUN))))
    many = many.repartition(F.xxhash64(*counted.columns, "__run"))
    at = F.col("__run") * RUN
    many = many.withColumn("copy", F.explode(F.sequence(first + at, first + F.least(at + RUN, F.col(count)) - 1))).drop("__run")
    return few.unionByName(many)


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with a column ``copy`` that tells equal rows apart, whatever the order they are read in."""
    counted = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")), label)
    return spread_out(counted, "__n").drop("__n")
