"""Context words count wherever they stand in a text."""

from stackroom.plans import queries as Q
from stackroom.plans import views as W


def test_lms_words_far_into_the_text(spark, tmp_path):
    far = "word " * 4000
    rows = [(2, far), (10, far + "Blackboard"), (13, far + "HOMEWORK"), (14, far + "canvas course")]
    spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {r["file_id"]: r["doc_id"] for r in W.files(spark, str(tmp_path)).collect()}
    got = {ids[r["file_id"]]: (r["lms"], r["assignment"]) for r in Q.lms_assignment(spark, str(tmp_path)).collect()}
    assert got == {2: (False, False), 10: (True, False), 13: (False, True), 14: (True, False)}
