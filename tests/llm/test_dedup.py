"""Line dedup, MinHash near-dedup, substring dedup, embedding near-dedup: against plain versions, and edge cases."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from stackroom.llm import kernels as K
from stackroom.llm import linededup, minhash, pqsearch, substring
from stackroom.session import table

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    """The smallest documents with planted copies, near copies, long passages and odd rows."""
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    base = [f"w{rng.randrange(10_000)}x" for _ in range(160)]
    at = 10_000
    for k in range(40):  # a family whose members are near the base, but not all near each other
        w = list(base)
        for _ in range(k // 4):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((at, " ".join(w)))
        at += 1
    passage = " ".join(f"p{i}" for i in range(70))
    rows += [(at + k, f"own{k} " * 30 + "\n" + passage + f"\ntail{k}") for k in range(12)]
    at += 12
    rows += [(at, None), (at + 1, ""), (at + 2, " \n\t "), (at + 3, "one two"), (at + 4, "One  two"), (at + 5, "word " * 5000), (at + 6, "word " * 5000 + "x"), (at + 7, "é" * 30 + "\n" + "é" * 29 + "e"), (at + 8, "a b c d e　f g")]
    return rows


def test_minhash_matches_brute_force(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(corpus, DOC)).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute.near_duplicates(corpus).items()}


def test_minhash_small_blocks(spark, corpus):
    """Tiny blocks and sketches that list little still give every link."""
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(corpus, DOC), block=4).collect()}
    assert got == {d: c for d, (_, c) in brute.near_duplicates(corpus).items()}


def test_substring_matches_brute_force(spark, corpus):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(spark.createDataFrame(corpus, DOC)).collect()}
    assert got == brute.remove_repeats(corpus)


def test_substring_texts_and_intervals(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, p), (2, "a b " + p + " c"), (3, p[: p.rindex(" ")] + " x")]
    got = {r["doc_id"]: r for r in substring.remove_repeats(spark.createDataFrame(rows, DOC), texts=True).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["kept_text"] == "a b c" and got[2]["intervals"] == [2, 62]
    assert got[3]["kept_text"] == "x"


def test_rolling_hash():
    h = K.word_hashes([b"a", b"b", b"c", b"a", b"b", b"c"])
    w = K.rolling(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 3 and len(K.rolling(h, 7)) == 0
    x = np.array([5, 1, 4, 2, 8, 3], np.uint64)
    assert K.sliding_min(x, 4).tolist() == [1, 1, 2] and K.sliding_min(x, 1).tolist() == x.tolist()
    assert substring.merge(np.array([0, 3, 20]), 10) == [(0, 13), (20, 30)]


def test_lines_match_brute_force(spark, corpus):
    rng = random.Random(3)
    line = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(d, t[:3000] if t else t) for d, t in corpus][:120]
    for k in range(60):
        x = list(line)
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(x))
            x[p : p + rng.randrange(2)] = rng.choice(["", "q", "zz"])
        rows.append((50_000 + k, "short\n" + "".join(x) + "\n" + line))
    rows.append((60_000, None))
    got = {r["doc_id"]: ([*r["dropped"]], r["n_exact"], r["n_links"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute.dedup_lines(rows)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(threshold)
    rows = []
    for _ in range(800):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        b = "".join(c for c in a if rng.random() > 0.15)
        b = "".join(c + (rng.choice("ab") if rng.random() < 0.15 else "") for c in b) or "a"
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup.banded_distance(F.col("a"), F.col("b"), threshold).alias("d"), linededup.common_prefix(F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        d = brute.levenshtein(r["a"], r["b"])
        assert r["d"] == d if d <= threshold else r["d"] > threshold
        assert r["a"][: r["p"]] == r["b"][: r["p"]] and r["a"][r["p"] : r["p"] + 1] != r["b"][r["p"] : r["p"] + 1] or r["p"] == min(len(r["a"]), len(r["b"]))


def test_lines_keep_other_columns(spark):
    line = "a line that is long enough to count here"
    rows = [(1, f"{line}\nx", "a", 7), (2, f"{line}!\ny", "b", 8), (None, line, "c", 9)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, n_links long"))
    got = {r["source"]: r for r in out.collect()}
    assert got["a"]["text"] == f"{line}\nx" and got["b"]["text"] == "y" and got["c"]["text"] == line
    assert out.columns.count("n_links") == 1 and got["b"]["n_links"] == 1


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            v = rng.normal(size=16)
            for k in range(rng.integers(1, 5)):
                rows.append((at, (v + rng.normal(size=16) * 0.12 * k).astype(np.float32).tolist(), label))
                at += 1
    rows += [(at, rows[0][1], 0), (at + 1, rows[0][1], 1), (at + 2, [0.0] * 16, 0), (at + 3, None, 0), (at + 4, [], 0), (at + 5, [float("nan")] * 16, 0), (at + 6, [None] * 16, 0), (at + 7, [1.0, 2.0], 0), (at + 8, [2.0, 4.0], 0), (at + 9, [float("inf")] + [0.0] * 15, 0)]
    return rows


@pytest.mark.parametrize("block", [8, 512])
def test_embeddings_match_brute_force(spark, vectors, block):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pqsearch.near_duplicates(df, block=block, sample=64).collect()}
    assert got == brute.cosine_links(vectors)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n long, key string, v long, fp string, line string")
    assert minhash.near_duplicates(docs).count() == 0
    assert substring.remove_repeats(docs).count() == 0
    assert linededup.dedup_lines(docs).count() == 0
    assert pqsearch.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, code string, list int")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(1, text, 0), (1, text, 1), (None, text, 2), (2, text, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    near = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert [x for x in near if x[0]] == [(1, 1, True), (1, 1, True), (2, 1, False)] and len(near) == 4
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.remove_repeats(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, 60)]
    assert linededup.dedup_lines(df).count() == 4
