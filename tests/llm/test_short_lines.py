"""Lines under the edit join's least length: exact repeats go, and only those."""

import corpus_pipeline as CP
from stackroom.llm import linededup

LONG = "a line that is long enough to count here"
ROWS = [
    (1, f"Les.\n\n{LONG}\nAll rights reserved."),
    (2, f"own\n\n  \nLes.\n{LONG}!\nAll rights reserved!"),
    (3, "Les.\n  \nLes\nAll rights reserved.\nx\nx"),
    (4, "Les."),
]


def test_short_repeats_go(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r["doc_id"]: ([*r["dropped"]], r["n_exact"], r["n_links"], r["text"]) for r in linededup.dedup_lines(df).collect()}
    assert got == {
        1: ([], 0, 1, ROWS[0][1]),
        2: ([3, 4], 1, 1, "own\n\n  \nAll rights reserved!"),  # blank lines stay; a short line one edit away does too
        3: ([0, 3, 5], 3, 0, "  \nLes\nx"),
        4: ([0], 1, 0, ""),
    }


def test_pipeline_drops_short_repeats(spark):
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(CP.STAGES)["line dedup"](spark, df, "")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert out.columns == df.columns and set(got) == {1, 2, 3}
    assert got[3] == ("  \nLes\nx", 8)
