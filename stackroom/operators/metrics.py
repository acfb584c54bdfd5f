"""Quality metrics of classification, retrieval and clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_scores(truth: Column, predicted: Column) -> Column:
    """Struct ``(precision, recall, f1)`` of two sets; empty denominators give 1, 1 and 0."""
    t, p = F.array_distinct(truth), F.array_distinct(predicted)
    hit = F.size(F.array_intersect(t, p))
    precision = F.when(F.size(p) == 0, 1.0).otherwise(hit / F.size(p))
    recall = F.when(F.size(t) == 0, 1.0).otherwise(hit / F.size(t))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def macro_set_scores(rows: DataFrame) -> DataFrame:
    s = rows.select(set_scores(F.col("truth"), F.col("predicted")).alias("s"))
    return s.agg(*(F.avg(f"s.{k}").alias(k) for k in ("precision", "recall", "f1")))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """Mean F1 over all labels that occur as truth or prediction."""
    hit = F.col("truth") == F.col("predicted")
    long = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), hit.cast("int").alias("tp"), F.lit(0).alias("fp"), (~hit).cast("int").alias("fn")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("tp"), (~hit).cast("int").alias("fp"), F.lit(0).alias("fn")))).alias("x")).select("x.*")
    per = long.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return per.agg(F.avg(F.when(den == 0, 0.0).otherwise(2 * F.col("tp") / den)).alias("macro_f1"))


def recall_at_k(rows: DataFrame, k: int) -> DataFrame:
    """Mean share of relevant items among the first ``k`` ranked; no relevant items count as 1."""
    want = F.array_distinct("relevant")
    share = F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, F.slice("ranked", 1, k))) / F.size(want))
    return rows.agg(F.avg(share).alias("recall"))


def purity(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per.agg((F.sum("top") / F.sum("n")).alias("purity"))


def completeness(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("label", "cluster").agg(F.count("*").alias("n")).groupBy("label").agg((F.max("n") / F.sum("n")).alias("share"))
    return per.agg(F.avg("share").alias("completeness"))


def mean_flag(rows: DataFrame, col: str) -> DataFrame:
    return rows.agg(F.avg(F.col(col).cast("double")).alias("mean"))


def mean_number(rows: DataFrame, col: str) -> DataFrame:
    x = F.col(col).cast("double")
    return rows.agg(F.avg(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)).alias("mean"))


def correction_reduction(runs: DataFrame) -> DataFrame:
    """``(first - last) / first`` of manual corrections, not below 0; 0 where the first is 0."""
    ends = runs.agg(F.min_by("manual_corrections", "run").alias("first"), F.max_by("manual_corrections", "run").alias("last"))
    return ends.select(F.when(F.col("first") > 0, F.greatest(F.lit(0.0), (F.col("first") - F.col("last")) / F.col("first"))).otherwise(0.0).alias("reduction"))


def percentile(rows: DataFrame, col: str, fraction: float) -> DataFrame:
    """Nearest rank."""
    return rows.agg(F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {col})").alias("value"))


def best_provider(runs: DataFrame) -> DataFrame:
    """The provider of best recall, then lowest p95, when at least two are comparable."""
    sound = runs.where("recall_at_1 is not null and p95 is not null and comparable")
    return sound.agg(F.count_distinct("provider").alias("n"), F.max_by("provider", F.struct("recall_at_1", -F.col("p95"))).alias("provider")).where("n >= 2").select("provider")
