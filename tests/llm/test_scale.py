"""Hot lists, many lengths, pairs at the threshold: work stays in proportion, nothing is lost."""

import random
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from stackroom.llm import minhash, pqsearch, warc

DOC = "doc_id long, text string"


def test_more_vector_lengths_than_an_index_holds(spark):
    rng = np.random.default_rng(1)
    rows = []
    for dim in range(1, 301):
        v = rng.normal(size=dim)
        rows += [(len(rows) + k, (v * (1 + k)).tolist(), "x") for k in range(2)]
    got = pqsearch.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), sample=64)
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {r[0]: 1 for r in rows}


@pytest.mark.parametrize("flat", [False, True])
def test_recall_of_pairs_at_the_threshold(spark, flat):
    """Every pair is planted at a cosine just above the threshold, in all or in a few directions."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 64))
    across = rng.normal(size=(4000, 64))
    if flat:  # data that fill eight of the dimensions
        x[:, 8:], across[:, 8:] = x[:, 8:] * 0.02, across[:, 8:] * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    across -= (across * x).sum(axis=1, keepdims=True) * x
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * across
    both = np.concatenate((x, y))
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    links = int((unit @ unit.T >= 0.93).sum()) - len(both)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    found = pqsearch.near_duplicates(df, list_rows=64).agg(F.sum("n_links")).first()[0]
    assert 0.995 * links <= found <= links


def unlike(n, shared, own, seed=2):
    """Documents that share a passage and nothing else."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(shared))
    return [(k, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(own))) for k in range(n)]


def test_a_list_of_unlike_documents(spark):
    """Thousands of documents with a passage in common: the list is hot, no pair is near."""
    took = {}
    for n in (2_500, 10_000, 20_000):  # the first compiles
        rows = unlike(n, 60, 60)
        rows += [(n + k, rows[k][1] + " tail") for k in range(50)]
        df = spark.createDataFrame(rows, DOC).repartition(8)
        t = time.time()
        kept = minhash.near_duplicates(df).where("kept").count()
        took[n] = time.time() - t
        assert kept == n
    assert took[20_000] < 3 * took[10_000], took


@pytest.mark.parametrize("options", [{"exact": True}, {"long": 3, "block": 4}])
def test_full_set_lists_match_brute_force(spark, options):
    rng = random.Random(6)
    rows = unlike(60, 40, 40)
    base = [f"b{i}" for i in range(90)]
    for k in range(60):
        w = list(base)
        for _ in range(k // 6):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "one two")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC), **options).collect()}
    assert got == brute.near_duplicates(rows)


def test_two_texts_under_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, a), (3, b), (2, a), (4, a + " z")]
    runs = [sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC).repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_pages_with_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 100, "mine", 5), (2, "v", "x" * 100, "mine", 6), (3, None, None, None, None)], "page_id long, url string, html string, bundle string, first long")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert got == {1: ("response", None, 100), 2: ("revisit", 1, 100), 3: ("response", None, 0)}
