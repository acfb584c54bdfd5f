"""Raw documents to packed training sequences: five stages, each one operator.

quality rules -> line dedup -> MinHash near-dedup -> source mixing -> best-fit packing.
Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``; all but the last keep the columns of
``documents``. Empty tables pass through; null ids and null texts are treated as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm import linededup, minhash, mixing, packing, quality
from stackroom.session import cut, ship, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier, which is trained on the labelled ones among them.

    Null, empty and blank texts have too few words and go. Texts are judged whole, however long.
    Repeated rows stay or go together; a null id is judged by its text like any other.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier; one that loses its last word goes.

    Null, empty and very long texts, ties, null and repeated ids: as :func:`linededup.dedup_lines`
    says. ``n_chars`` follows the text where lines went.
    """
    ship(spark)
    out = linededup.dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0)
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Texts without words and rows of a null id stay. Rows that repeat a kept id all stay.
    """
    ship(spark)
    gone = cut(minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "near")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice.

    Texts without words go. Rows that repeat an id (null ones too) are taken as often as the
    first of them by rank.
    """
    ship(spark)
    taken = mixing.mix_single(docs).where("taken > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    rows = docs.select(F.col("doc_id").alias("own"), mixing.word_count("text").alias("words"), F.struct(*docs.columns).alias("row")).where("words > 0")
    met = rows.join(cut(taken, "taken"), F.col("own").eqNullSafe(F.col("id")))
    return met.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' words, each piece with its text; odd rows as :func:`packing.pack` says."""
    ship(spark)
    return packing.pack(docs, texts=True)


STAGES = [("quality", keep_quality), ("line dedup", drop_lines), ("near-dedup", one_of_each), ("mixing", mix_sources), ("packing", pack_bins)]

#: The classifier, the edit join and the packing are not expressible in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
