"""Packing with texts: the pieces' texts make up the documents' texts."""

from collections import defaultdict

import brute

import corpus_pipeline as CP
from stackroom.llm import packing

LONG = " \n lead " + "\n".join(f"w{i}\t x" for i in range(700)) + " \n"
ROWS = [(1, LONG, "a"), (1, "another text of the same id", "a"), (2, "two  words\n", "a"), (2, "two  words\n", "a"), (3, None, "b"), (4, "", "b"), (5, " \n ", None), (None, "no id", "b"), (None, LONG + "tail", "b"), (0, "zero", "b")]


def test_pieces_make_up_the_texts(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    plain = packing.pack(df, capacity=100)
    out = packing.pack(df, capacity=100, texts=True)
    rows = out.collect()
    assert out.columns == [*plain.columns, "text"] and len(rows) == plain.count()
    assert all(len(brute.words(r["text"])) == r["n_words"] for r in rows)
    long_pieces = [r for r in rows if r["doc_id"] == 1 and (r["piece"] > 0 or r["n_words"] == 100)]
    assert "".join(r["text"] for r in sorted(long_pieces, key=lambda r: r["piece"])) == LONG
    tail = [r for r in rows if r["doc_id"] is None and (r["piece"] > 0 or r["n_words"] == 100)]
    assert "".join(r["text"] for r in sorted(tail, key=lambda r: r["piece"])) == LONG + "tail"
    short = sorted((str(r["doc_id"]), r["text"]) for r in rows if r["piece"] == 0 and r["n_words"] < 100 and r["text"] is not None)
    assert short == [("0", "zero"), ("1", "another text of the same id"), ("2", "two  words\n"), ("2", "two  words\n"), ("4", ""), ("5", " \n "), ("None", "no id")]
    assert [r["text"] for r in rows if r["doc_id"] == 3] == [None]


def test_pipeline_packs_texts(spark):
    df = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in ROWS[2:4]] + [(9, LONG, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    made = defaultdict(list)
    for r in CP.pack_bins(spark, df, "").collect():
        made[r["doc_id"], r["copy"]].append(r)
    assert {k: "".join(r["text"] for r in sorted(v, key=lambda r: r["piece"])) for k, v in made.items()} == {(2, 0): "two  words\n", (2, 1): "two  words\n", (9, 0): LONG}
