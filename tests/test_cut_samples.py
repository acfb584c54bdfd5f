"""A sample's limit in bytes may fall into a character."""

import pytest
from pyspark.sql import functions as F

from stackroom.plans import queries as Q
from stackroom.plans import write_queries as WQ
from stackroom.sources import files as SF


@pytest.mark.parametrize("char", ["é", "€", "😀"])
def test_limit_within_a_character(spark, char):
    texts = ["a" * k + char * 40_000 for k in range(4)]
    rows = spark.createDataFrame([(t.encode(),) for t in texts] + [(b"\xe9" * 70_000,)], "content binary")
    got = [r["t"] for r in rows.select(SF.text_sample(F.col("content")).alias("t")).collect()]
    assert got == [t[:8000] for t in texts] + ["é" * 8000]


def test_queries_over_long_texts(spark, tmp_path):
    import hashlib

    texts = {10: "a" + "é" * 40_000, 20: "b" * 65_535 + "ü" + "b" * 9}
    spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["sample"] for r in Q.text_samples(spark, str(tmp_path)).collect()) == sorted(t[:8000] for t in texts.values())
    assert {r["body"] for r in WQ.indexed_texts(spark, str(tmp_path)).collect()} == {hashlib.md5(t[:8000].encode()).hexdigest() for t in texts.values()}
