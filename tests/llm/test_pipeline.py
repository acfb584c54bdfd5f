"""The pipeline against the plain versions of its stages."""

import brute
from pyspark.sql import functions as F
from test_models import _check_bins

import corpus_pipeline as CP
from stackroom.llm import packing
from stackroom.session import table

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    kept = CP.keep_quality(spark, docs, SMALL).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept.columns == columns and all(not brute.base_measures(texts[d])[5] for d in ids)
    good = {r["doc_id"] for r in table(spark, SMALL, "labels").where("quality = 1").collect() if not brute.base_measures(texts[r["doc_id"]])[5]}
    assert len(good & ids) >= 0.97 * len(good)

    lines = CP.drop_lines(spark, kept, SMALL).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    plain = brute.dedup_lines(rows)
    want = {}
    for d, t in rows:
        text = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in plain[d][0])
        if brute.words(text) or not plain[d][0]:
            want[d] = text
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    assert lines.columns == columns and {d: x[0] for d, x in got.items()} == want
    assert all(n == len(t) for t, n in got.values())

    near = CP.one_of_each(spark, lines, SMALL).cache()
    components = brute.near_duplicates(list(want.items()))
    assert near.columns == columns and {r["doc_id"] for r in near.collect()} == {d for d, (_, c) in components.items() if c == d}

    mixed = CP.mix_sources(spark, near, SMALL).cache()
    words = sum(len(brute.words(r["text"])) for r in near.collect())
    out = sum(len(brute.words(r["text"])) for r in mixed.collect())
    assert mixed.columns == columns and abs(out - 1.5 * words) <= 0.03 * words

    bins = CP.pack_bins(spark, mixed, SMALL).collect()
    seen = _check_bins(bins, {r["doc_id"]: (r["text"], r["source"]) for r in mixed.collect()}, packing.CAPACITY, packing.PER_SOURCE)
    assert len(seen) == mixed.count()


def test_run_and_registration(spark):
    import __spark_entry__ as e

    assert "pipeline" in e.queries() and [n for n, _ in CP.STAGES] == ["quality", "line dedup", "near-dedup", "mixing", "packing"]
    assert CP.run(spark, SMALL).count() > 0


def test_empty_documents(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in CP.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0


def test_stages_take_odd_rows(spark):
    """Null, empty, blank, repeated and very long rows, null ids, ties: every stage gives a result with the documents' columns."""
    long_text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (4, long_text, "en", "a", len(long_text)), (5, long_text, "en", "b", len(long_text))]
    rows += [(6, "twice the same line here, long enough\n" * 2 + " ".join(f"x{i}" for i in range(80)), "en", "b", 500)] * 2
    rows += [(None, " ".join(f"y{i}" for i in range(90)), "fr", "a", 400), (None, " ".join(f"z{i}" for i in range(90)), "fr", None, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in CP.STAGES:
        out = stage(spark, docs, SMALL)
        n = out.count()
        assert n > 0, name
        if name != "packing":
            assert out.columns == docs.columns
    near = {r["doc_id"] for r in CP.one_of_each(spark, docs, SMALL).collect()}
    assert near == {1, 2, 3, 4, 6, None}
    mixed = CP.mix_sources(spark, docs.withColumn("__times", F.lit(9)).withColumn("own", F.lit("mine")), SMALL)
    assert {r["own"] for r in mixed.collect()} == {"mine"} and not {1, 2, 3} & {r["doc_id"] for r in mixed.collect()}
