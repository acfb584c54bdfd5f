"""The write path end to end, token ids, and the stateful rate limit."""

import os

import pytest
from pyspark.sql import functions as F

from stackroom.functions.tokenize import joint_token_ids
from stackroom.plans import indexing
from stackroom.schemas import DDL, conform
from stackroom.streaming import live as Y

TABLES = ("files", "text_content", "classifications", "exact_hashes", "review_inbox", "learned_rules", "category_overrides")
TREE = [("/r/School/csc151-ch4.txt", "notes for CSC-151, Blackboard assignment", 10.0), ("/r/a.py", "import os", 10.0), ("/r/b.bin", "same", 10.0), ("/r/c.bin", "same", 10.0)]


def scan(spark, rows):
    return spark.createDataFrame(rows, "path string, text string, mtime double").select("path", F.length("text").cast("long").alias("size"), "mtime", F.col("text").cast("binary").alias("content"))


def test_index_then_nothing_then_changes(spark):
    catalog = {t: spark.createDataFrame([], DDL[t]) for t in TABLES}
    rule = spark.createDataFrame([(1, "extension", "py", "Topics/Python", 0.55, True, "test", 0.0)], DDL["learned_rules"])
    catalog["learned_rules"] = rule
    first = indexing.index_root(scan(spark, TREE), catalog, "/r", now=1.0)
    files = {r["path"]: r for r in first["files"].collect()}
    assert {r["status"] for r in files.values()} == {"indexed"} and len(files) == 4
    cats = {r["file_id"]: r["categories"] for r in first["classifications"].collect()}
    assert cats[files["/r/School/csc151-ch4.txt"]["file_id"]] == ["Documents/Text", "School/CSC-151", "School", "Assignment"]
    assert cats[files["/r/a.py"]["file_id"]] == ["Documents/Text", "Projects/Code", "Topics/Python"]
    assert first["text_content"].count() == 2 and first["review_inbox"].count() == 3
    assert first["exact_hashes"].groupBy("sha256").count().where("count = 2").count() == 1
    assert indexing.searchable_chunks(first).count() == 2

    catalog |= {t: spark.createDataFrame(df.collect(), df.schema) for t, df in first.items()}
    assert indexing.index_root(scan(spark, TREE), catalog, "/r", now=2.0) == {}

    changed = [(p, t + "!" if p == "/r/a.py" else t, m) for p, t, m in TREE if p != "/r/b.bin"]
    third = {r["path"]: r for r in indexing.index_root(scan(spark, changed), catalog, "/r", now=3.0)["files"].collect()}
    assert third["/r/b.bin"]["status"] == "missing" and third["/r/a.py"]["last_indexed"] == 3.0 and third["/r/a.py"]["first_seen"] == 1.0
    partial = indexing.index_root(scan(spark, changed), catalog, "/r", complete=False)["files"]
    assert partial.where("status = 'missing'").count() == 0


def test_conform_adds_and_drops_columns(spark):
    out = conform(spark.createDataFrame([("a", 1)], "k string, extra int"), "meta")
    assert out.columns == ["k", "v"] and out.first()["v"] is None


VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_token_ids(spark):
    rows = spark.createDataFrame([("a", "A photo of a cat"), ("b", None), ("c", "word " * 200)], "file_id string, text string")
    got = {r["file_id"]: r["ids"] for r in joint_token_ids(rows, VOCABULARY).collect()}
    assert all(len(x) == 77 and x[0] == 49406 for x in got.values())
    assert got["a"][6] == 49407 and set(got["a"][7:]) == {0}
    assert got["b"][1] == 49407 and got["c"][76] == 49407


TIMES = [[100.0, 102.0, 106.0, 107.0], [100.0, 101.0, 102.0, 130.0], [1.0, 6.0, 6.0, 11.0, 30.0], [7.0]]


@pytest.mark.parametrize("times", TIMES)
def test_rate_limit_forms_agree(spark, tmp_path, times):
    requests = spark.createDataFrame([("all", t) for t in times], "key string, ts double")
    batch = sorted(r["scan_at"] for r in Y.reconcile_plan(requests, cooldown=5.0).collect())
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = str(tmp_path / "in")
        late = spark.createDataFrame([("end", times[-1] + 100)], "key string, ts double")  # lets the watermark pass
        for rows in (requests, late):
            rows.select("key", F.timestamp_seconds("ts").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = Y.reconcile_stream(spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src), 5000)
        name = f"scans{abs(hash(tuple(times)))}"
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.awaitTermination(180)
        got = sorted(r["scan_at"] for r in spark.table(name).where("key = 'all'").collect())
    finally:
        spark.conf.unset(key)
    assert got == batch
    if times == TIMES[0]:
        assert batch == [100.0, 105.0, 110.0]


def test_wake_leads_to_a_scan(spark):
    work = Y.coalesce(Y.wake(spark, 50.0, 3)).collect()
    assert [(r["kind"], r["event_id"]) for r in work] == [(Y.RESCAN, 3)]


def test_sessions_resume(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = scan(spark, TREE)
    asked = []

    def control(done):
        asked.append(done)
        return indexing.PAUSE if done == 2 else indexing.RUN

    first = indexing.scan_session(rows, store, "/r", batches=4, control=control, now=1.0).first()
    assert first["completion"] == "paused" and first["batches"] == 2 and asked == [0, 1, 2]
    second = indexing.scan_session(rows, store, "/r", batches=4, now=2.0).first()
    assert second["completion"] == "completed" and first["processed"] + second["processed"] == 4 and second["generation"] == 2
    third = indexing.scan_session(rows.where("path <> '/r/b.bin'"), store, "/r", now=3.0).first()
    assert (third["missing"], third["processed"]) == (1, 0)


def test_rules_in_parts(spark, monkeypatch):
    from stackroom.operators import learning as R

    rules = spark.createDataFrame([(k, "pathKeyword", f"dir{k}/", f"T/{k}", True) for k in range(40)], "id long, pattern_type string, pattern string, target_category string, enabled boolean")
    files = spark.createDataFrame([(f"f{k}", f"/dir{k}/dir{k + 1}/x.txt") for k in range(30)], "file_id string, path string").withColumn("evidence", F.lit("")).withColumn("categories", F.array().cast("array<string>"))
    whole = sorted(map(tuple, R.enrich(files, rules).collect()))
    monkeypatch.setattr(R, "RULES_AT_ONCE", 7)
    assert sorted(map(tuple, R.enrich(files, rules).collect())) == whole and whole[0][1] == ["T/0", "T/1"]


def test_category_paths_of_any_depth(spark):
    from stackroom.operators import groups as G

    rows = [(f"n{k}", f"c{k}", f"n{k - 1}" if k else None) for k in range(300)] + [("x", "lost", "nowhere")]
    got = {r["id"]: r["path"] for r in G.category_paths(spark.createDataFrame(rows, "id string, name string, parent_id string")).collect()}
    assert got["n299"] == "/".join(f"c{k}" for k in range(300)) and len(got) == 300
    with pytest.raises(RuntimeError):
        G.category_paths(spark.createDataFrame([("a", "a", "b"), ("b", "b", "a")], "id string, name string, parent_id string"), max_rounds=3)


def test_lsh_recall(spark):
    import numpy as np

    from stackroom.operators import similarity as C

    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 32))
    x = np.repeat(base, 5, axis=0) + 0.25 * rng.normal(size=(200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"v{k:03d}", "m", v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, model string, vector array<double>")
    exact = {(r["a"], r["b"]) for r in C.embedding_edges(df, threshold=0.85).select("a", "b").collect()}
    found = {(r["a"], r["b"]) for r in C.lsh_embedding_edges(df, threshold=0.85, dim=32).select("a", "b").collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) > 100
