"""Small literal inputs with known results: one test for each behaviour that the surveyed suite pins."""

import math
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from stackroom.functions import labels as L
from stackroom.functions import paths as P
from stackroom.functions import taxonomy as X
from stackroom.functions import text as T
from stackroom.functions import vectors as V
from stackroom.operators import duplicates as D
from stackroom.operators import groups as G
from stackroom.operators import incremental as I
from stackroom.operators import learning as R
from stackroom.operators import metrics as M
from stackroom.operators import rollups as U
from stackroom.operators import search as S
from stackroom.operators import similarity as C
from stackroom.operators.components import connected_components
from stackroom.sources import files as SF
from stackroom.sources import providers as PR
from stackroom.sources import tables as ST
from stackroom.streaming import live as Y


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_file_tree(spark, tmp_path):
    names = {"School/csc151-ch4.txt": b"notes for CSC-151", "Images/a.bin": b"x" * 100, "Images/b.bin": b"x" * 100, "Images/c.bin": b"y" + b"x" * 99, "node_modules/m.js": b"1", "Images/x.part": b"2"}
    big = bytearray(12 << 20)
    names["Huge/a.bin"] = bytes(big)
    big[(12 << 20) - (4 << 20)] = 1
    names["Huge/b.bin"] = bytes(big)
    for n, data in names.items():
        p = tmp_path / n
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    scanned = SF.scan_tree(spark, str(tmp_path))
    ids = SF.identities(scanned)
    assert ids.count() == 6
    rows, cut = SF.listing(scanned, 2)
    assert cut and rows.count() == 2
    contents = scanned.withColumn("file_id", P.opaque_id(F.col("path")))
    groups = D.duplicate_members_staged(contents.select("file_id", "content")).collect()
    assert len(groups) == 2 and {r["copies"] for r in groups} == {2} and len({r["representative"] for r in groups}) == 1
    assert SF.complete(scanned, 1000).count() == 4
    assert scanned.where(F.col("path").endswith(".txt")).select(SF.text_sample(F.col("content")).alias("t")).first()["t"] == "notes for CSC-151"


def test_zip_and_wav(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "x")
        z.writestr("b.txt", "y")
    (tmp_path / "corrupt.zip").write_bytes(b"PK nothing")
    pcm = struct.pack("<8h", *range(0, 8000, 1000)) * 4000
    wav = b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 32000, 128000, 4, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm
    (tmp_path / "a.wav").write_bytes(wav)
    (tmp_path / "t.wav").write_bytes(wav[:-5])
    files = SF.scan_tree(spark, str(tmp_path))
    members = {r["path"].rsplit("/", 1)[-1]: r["members"] for r in SF.zip_members(files).collect()}
    assert members["a.docx"] == ["word/document.xml", "b.txt"] and members["corrupt.zip"] == []
    verdicts = {r["path"].rsplit("/", 1)[-1]: r["verdict"] for r in SF.wav_headers(files).collect()}
    assert verdicts["a.wav"] == "ok" and verdicts["t.wav"] == "truncated" and verdicts["a.docx"] == "not-riff"
    chunks = SF.pcm_chunks(files, seconds=0.25).collect()
    assert len(chunks) == 2 and len(chunks[0]["samples"]) == 4000
    states = PR.transcribe_rows(SF.pcm_chunks(files, seconds=0.25), PR.SilenceProvider()).collect()
    assert [s["state"] for s in states] == ["success"]
    assert files.where(F.col("path").endswith("a.wav")).select(L.looks_like_audio(F.col("content")).alias("x")).first()["x"]


def test_search_filters(spark):
    files = spark.createDataFrame([("old", "/a/old", 1700000000.0, "indexed"), ("new", "/a/new", 1800000000.0, "indexed"), ("plain", "/a/plain", 1800000000.0, "indexed")], "file_id string, path string, mtime double, status string")
    texts = files.select("file_id", F.lit("shared needle").alias("body"))
    none = spark.createDataFrame([], "file_id string, start double, text string")
    hashes = spark.createDataFrame([("old", 5, "01"), ("new", 5, "01"), ("plain", 5, "02")], "file_id string, size long, sha256 string")
    conf = spark.createDataFrame([("old", 0.3), ("new", 0.9), ("plain", 0.9)], "file_id string, confidence double")
    member = spark.createDataFrame([("School/CSC-151", "old"), ("Projects", "new"), ("Documents", "plain")], "category_path string, file_id string")
    run = lambda *f: {r["file_id"] for r in S.filtered_search(files, texts, none, "needle", list(f)).collect()}
    assert run(S.Filter.category(member, "School")) == {"old"}
    assert run(S.Filter.after(files, 1700000000)) == {"new", "plain"}
    assert run(S.Filter.before(files, 1800000000)) == {"old"}
    assert run(S.Filter.duplicates(hashes)) == {"old", "new"}
    assert run(S.Filter.low_confidence(conf)) == {"old"}
    assert S.exact_search(files, texts, none, "  ").count() == 0


def test_filters_run_after_the_limit(spark):
    files = spark.range(80).select(F.format_string("f%03d", "id").alias("file_id"), F.format_string("/p/%03d", "id").alias("path"), F.lit("indexed").alias("status"), F.col("id").cast("double").alias("mtime"))
    texts = files.select("file_id", F.lit("needle").alias("body"))
    none = spark.createDataFrame([], "file_id string, start double, text string")
    late = S.Filter.after(files, 60)
    assert S.filtered_search(files, texts, none, "needle", [late]).count() == 0
    assert S.filtered_search(files, texts, none, "needle", [late], prefilter=True).count() == 19


def test_phrase_counts_overlap(spark):
    r = one(spark, F.size(T.phrase_positions(T.tokens(F.lit("the the the")), "the the")).alias("n"), T.contains_phrase(T.tokens(F.lit("a b")), "").alias("blank"))
    assert r["n"] == 2 and r["blank"] is False


def test_vector_scan(spark):
    rows = spark.range(1300).select(F.format_string("scale-%04d", "id").alias("file_id"), F.lit("m").alias("model"), F.when(F.col("id") == 1299, F.array(F.lit(1.0), F.lit(0.0))).when(F.col("id") == 1298, F.array(F.lit(0.95), F.lit(0.3122499))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    files = rows.select("file_id", F.col("file_id").alias("path"), F.lit("indexed").alias("status"))
    hits = [r["file_id"] for r in S.semantic_search(files, rows, None, [1.0, 0.0], model="m", threshold=0.5, k=5).collect()]
    assert hits == ["scale-1299", "scale-1298"]
    nan = one(spark, V.cosine_unit(F.array(F.lit(float("nan"))), F.array(F.lit(1.0))).alias("x"), V.l2_normalize(F.array(F.lit(0.0))).alias("z"), V.byte_distance(F.array(F.lit(0)), F.array(F.lit(1))).alias("d"))
    assert nan["x"] is None and nan["z"] is None and nan["d"] is None


def test_similarity_clusters(spark):
    nodes = spark.createDataFrame([("crop", [10, 10, 10, 11]), ("resize", [10, 10, 11, 11]), ("screenshot", [10, 11, 11, 11]), ("lookalike", [10, 30, 10, 30])], "id string, feature array<int>")
    got = C.clusters(C.feature_edges(nodes, threshold=0.70)).collect()
    assert len(got) == 1 and got[0]["members"] == ["crop", "resize", "screenshot"] and got[0]["representative"] == "resize"
    both = spark.createDataFrame([("a", "b", 0.9, "nearDuplicate", "x"), ("b", "a", 0.8, "semantic", "y")], "a string, b string, score double, relation string, signal string")
    assert {r["relation"] for r in C.clusters(both).collect()} == {"nearDuplicate", "semantic"}
    edges = spark.createDataFrame([("a", "b", 0.9, "semantic", "y"), ("b", "c", 0.9, "semantic", "y")], both.schema)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string") if x else spark.createDataFrame([], "id string")
    after = C.updated_edges(edges, ids("c"), ids(), spark.createDataFrame([("a", "c", 0.7, "semantic", "y")], both.schema))
    assert {(r["a"], r["b"]) for r in after.collect()} == {("a", "b"), ("a", "c")}
    assert C.updated_edges(edges, ids(), ids("b"), edges).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = connected_components(path, contract=False)
    assert out.count() == 201 and out.select("component").distinct().collect()[0][0] == 0
    assert connected_components(path.limit(0)).count() == 0


def _member(spark, rows):
    return spark.createDataFrame(rows, "category_path string, file_id string")


_NO_CLUSTERS = "id string, relation string, confidence double, members array<string>"


def test_smart_groups_under_noise(spark):
    rows = [(f"Odd/Label-{i}", f"o{i}") for i in range(5000)]
    rows += [(f"School/MAT-{100 + k}", f"s{k}-{i}") for k in range(10) for i in range(8)]
    rows += [(f"Screenshots/{k}", f"h{k}-{i}") for k in ("code", "school", "lms", "receipt", "error", "social", "map", "meme") for i in range(6)]
    rows += [("Projects/Code", f"c{i}") for i in range(120)] + [("Documents/PDF", f"p{i}") for i in range(80)] + [("Image/Animals", f"a{i}") for i in range(60)]
    families = [(f"d{i:03d}", "nearDuplicate", 1.0, [f"d{i}a", f"d{i}b"]) for i in range(100)] + [(f"e{i:03d}", "semantic", 0.9, [f"e{i}-{j}" for j in range(4)]) for i in range(50)]
    got = G.smart_groups(_member(spark, rows), spark.createDataFrame(families, _NO_CLUSTERS)).collect()
    lanes = {}
    for r in got:
        lanes.setdefault(r["group_id"].split(":")[0] + ":" + (r["group_id"].split(":")[1].split("/")[0] if r["kind"] == "category" else ""), []).append(r)
    assert len(got) <= 18 and len(lanes) >= 5
    assert len(lanes["duplicate:"]) == 3 and len(lanes.get("semantic:", [])) <= 5
    assert len(lanes["category:Screenshots"]) == 4 and len(lanes["category:School"]) == 4
    assert all(r["items"] == len(r["members"]) for r in got)


def test_smart_groups_reject_malformed_labels(spark):
    bad = ["School/csc-151", "School/CSC-15", "School/XYZ-123", "School", "School/CSC-151/x", "Screenshots/Code", "Screenshots/other", "Projects", "Projects/x", "Stuff/1", "Image", "Documents", "Assignment/x", "Image/junk"]
    rows = [(b, f"b{i}-{j}") for i, b in enumerate(bad) for j in range(12)]
    rows += [("School/MAT-171", "m1"), (" School // MAT-171 ", "m2"), ("Screenshots/code", "n1"), (" Screenshots // code ", "n2")]
    got = G.smart_groups(_member(spark, rows), spark.createDataFrame([], _NO_CLUSTERS)).collect()
    assert sorted((r["group_id"], r["items"]) for r in got) == [("category:School/MAT-171", 2), ("category:Screenshots/code", 2)]


def test_composites(spark):
    rows = [("DiskImages", f"i{i}") for i in range(40)] + [("Archives", f"z{i}") for i in range(24)] + [("Audio", f"a{i}") for i in range(12)] + [("Video", f"v{i}") for i in range(10)]
    got = {r["group_id"]: r["items"] for r in G.smart_groups(_member(spark, rows), spark.createDataFrame([], _NO_CLUSTERS)).collect()}
    assert got == {"composite:installers-archives": 64, "composite:media": 22}


def test_paged_views(spark):
    n = F.col("id")
    files = spark.range(5000).select(F.format_string("f%05d", "id").alias("file_id"), F.format_string("/repo/src/%05d.dat", "id").alias("path"), F.when(n < 4990, "other").when(n % 2 == 0, "audio").otherwise("video").alias("kind"), F.lit(1).alias("size"), F.lit("indexed").alias("status"))
    member = files.where("file_id >= 'f04980'").select(F.lit("School/MAT-171").alias("category_path"), "file_id")
    hashes = files.select("file_id", "size", F.when(F.col("file_id") >= "f04994", "same").otherwise(F.col("file_id")).alias("sha256"))
    assert U.files_page(files, kinds=("audio", "video"), limit=5).count() == 5
    assert U.files_page(files, duplicates_of=hashes, limit=4).count() == 4
    assert U.files_page(files, category="School", memberships=member, limit=7).count() == 7
    first = U.files_page(files, limit=200).collect()
    second = U.files_page(files, cursor=first[-1]["path"], limit=200).collect()
    assert len(first) == len(second) == 200 and first[-1]["path"] < second[0]["path"]
    assert U.files_page(files, limit=9999).count() == 1000 and U.files_page(files, limit=-1).count() == 0


def test_learning_loop(spark):
    kind = "file_id string, category string, action string, pattern_type string, pattern string, generation string"
    plus = [(f"f{i}", "Taxes", "addCategory", "pathKeyword", " Taxes  2024", "g") for i in range(3)]
    rule = R.promote_rules(spark.createDataFrame(plus, kind)).collect()
    assert [(r["pattern"], r["confidence"], r["enabled"]) for r in rule] == [("taxes 2024", 0.55, False)]
    assert R.promote_rules(spark.createDataFrame(plus[:2], kind)).count() == 0
    minus = [("f9", "taxes", "wrongCategory", "pathKeyword", "taxes 2024", "g")]
    old = spark.createDataFrame([("pathKeyword", "taxes 2024", "Taxes", 0.55, True)], "pattern_type string, pattern string, target_category string, confidence double, enabled boolean")
    after = R.promote_rules(spark.createDataFrame(plus + minus, kind), existing=old).first()
    assert after["confidence"] == pytest.approx(0.35) and after["enabled"] is False
    assert R.promote_rules(spark.createDataFrame(minus * 3, kind)).count() == 0
    spread = [(f"f{i}", f"C{i}", "addCategory", "pathKeyword", "x", "g") for i in range(3)]
    assert R.promote_rules(spark.createDataFrame(spread, kind)).count() == 0


def test_access_backoff(spark):
    fails = spark.createDataFrame([("/a", "EACCES", 100.0), ("/a", "EACCES", 101.0)], "prefix string, reason string, now double")
    r = I.access_backoff(fails).first()
    assert r["attempts"] == 2 and r["retry_after"] > 100 + 31
    many = spark.range(80).select(F.concat(F.lit("/p"), "id").alias("prefix"), F.lit("x").alias("reason"), F.col("id").cast("double").alias("now"))
    kept = I.access_backoff(many, keep=32).collect()
    assert len(kept) == 32 and max(k["last_attempt"] for k in kept) == 79


def test_wildcards_in_roots_mean_nothing(spark):
    files = spark.createDataFrame([("/a%b/x", "indexed"), ("/aXb/x", "indexed"), ("/a_c/x", "indexed"), ("/aYc/x", "indexed")], "path string, status string")
    assert [r["path"] for r in I.subtree_missing(files, "/a%b").where("status = 'missing'").collect()] == ["/a%b/x"]
    assert [r["path"] for r in I.set_scope(files, "/a_c/", False).where("status = 'unscoped'").collect()] == ["/a_c/x"]


def test_event_storm(spark):
    storm = spark.range(100_000).select(F.concat(F.lit("/s/"), "id").alias("path"), F.lit(256).alias("flags"), F.col("id").alias("event_id"))
    got = Y.coalesce(storm, max_pending=128).collect()
    assert [(r["kind"], r["path"]) for r in got] == [("rescan", None)]
    m = Y.batch_metrics(storm, max_pending=128).first()
    assert m["peak"] == 128 and m["collapsed"]
    calm = Y.coalesce(storm.limit(5), max_pending=128).collect()
    assert {r["kind"] for r in calm} == {"path"} and len(calm) == 5
    three = spark.createDataFrame([("all", 0.0), ("all", 1.0), ("all", 2.0)], "key string, ts double")
    assert [r["scan_at"] for r in Y.reconcile_plan(three, 60.0).collect()] == [0.0, 60.0]


def test_stream_coalesces(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("/a", 256, 1), ("/a", 512, 2), ("/b", 256, 3), ("/x/node_modules/q", 256, 4)]
    spark.createDataFrame(rows, "path string, flags int, event_id long").write.parquet(src)
    seen = []
    q = Y.start(Y.read_events(spark, src, "path string, flags int, event_id long"), lambda df, n: seen.extend(df.collect()), checkpoint=str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    assert sorted((r["path"], r["flags"]) for r in seen) == [("/a", 512), ("/b", 256)]


def test_stream_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(6).select(F.concat(F.lit("/"), "id").alias("path"), F.lit(256).alias("flags"), F.col("id").alias("event_id"), F.timestamp_millis(F.when(F.col("id") < 3, F.col("id") * 100).otherwise(60_000 + F.col("id") * 100)).alias("ts"))
    rows.coalesce(1).write.parquet(src)
    stream = Y.debounced(Y.read_events(spark, src, "path string, flags int, event_id long, ts timestamp"), watermark="0 seconds")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert [r["events"] for r in spark.table("bursts").collect()] == [3]


def test_screenshots(spark):
    words = {"lms": "blackboard", "code": "traceback github", "receipt": "subtotal", "error": "permission denied", "conversation": "delivered reply", "social": "followers", "map": "directions", "meme": "top text", "school": "quiz chapter"}
    rows = [(k, "Screenshot 1.png", 1440, 900, ["display"], f"{t} settings", []) for k, t in words.items()]
    rows.append(("none", "Screenshot.png", None, None, None, None, None))
    df = spark.createDataFrame(rows, "k string, name string, w int, h int, p array<string>, t string, l array<string>")
    for r in df.select("k", L.assess_screenshot(*(F.col(x) for x in ("name", "w", "h", "p", "t", "l"))).alias("a")).collect():
        if r["k"] == "none":
            assert not r["a"]["is_screenshot"]
        else:
            assert r["a"]["is_screenshot"] and r["a"]["subtype"] == r["k"] and r["a"]["confidence"] > 0.8


def test_classifier(spark):
    def run(path, kind, text):
        return one(spark, L.classify(F.lit(path), F.lit(kind), F.lit(text)).alias("c"))["c"]

    c = run("/School/csc151-ch4.txt", "text", "CSC-151 inheritance. Blackboard assignment")
    assert c["categories"] == ["Documents/Text", "School/CSC-151", "School", "Assignment"] and c["confidence"] == pytest.approx(0.85)
    assert run("/a/main.py", "text", "canvas assignment course")["categories"] == ["Documents/Text", "Projects/Code"]
    assert run("/a/screenshot-notes.md", "text", "x")["categories"] == ["Documents/Text"]
    assert "Screenshot" in run("/a/screenshot-1.png", "image", None)["categories"]
    assert one(spark, L.courses(F.lit("material mat171_final bio 99 csc_1234")).alias("c"))["c"] == ["CSC-1234", "MAT-171"]


def test_contract(spark):
    ok = lambda i, c, d="", r=(), p=0.5: one(spark, L.contract_ok(F.lit(i), F.array(*map(F.lit, c)) if c else F.array().cast("array<string>"), F.lit(d), F.array(*map(F.lit, r)) if r else F.array().cast("array<string>"), F.lit(p)).alias("k"))["k"]
    assert ok("file_abc", ["Documents/PDF"])
    assert not ok("abc", ["A"]) and not ok("file_abc", ["rm -rf /; x"]) and not ok("file_abc", ["a/../b"])
    assert not ok("file_abc", ["A"], p=1.5) and not ok("file_abc", ["A"] * 13) and not ok("file_abc", ["A"], d="x" * 2001) and not ok("file_abc", ["A"], r=["y" * 65])
    assert not ok("file_" + "a" * 40, ["A"])


def test_compaction(spark):
    source = "import x\n" + "\n".join(f"func f{i}() {{ }}" for i in range(2000))
    prose = " ".join(f"Sentence number {i} says a little." for i in range(500))
    df = spark.createDataFrame([("/a/Big.swift", source), ("/a/notes.md", prose), ("/a/yarn.lock", "x"), ("/a/app.min.js", "x"), ("/a/q.map", "x"), ("/a/b.txt", "  ")], "path string, text string")
    got = {r["path"]: r["k"] for r in df.select("path", T.compacted(F.col("path"), F.col("text")).alias("k")).collect()}
    assert got["/a/Big.swift"]["strategy"] == "source" and len(got["/a/Big.swift"]["primary"]) <= 4000 and "declarations:" in got["/a/Big.swift"]["primary"]
    assert 2 <= len(got["/a/notes.md"]["chunks"]) <= 6 and len(got["/a/notes.md"]["primary"]) == 4000
    assert all(got[p]["strategy"] == "skip" for p in ("/a/yarn.lock", "/a/app.min.js", "/a/q.map", "/a/b.txt"))


def test_metrics(spark):
    s = one(spark, M.set_scores(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("s"))["s"]
    assert (s["precision"], s["recall"], s["f1"]) == (1.0, 1.0, 1.0)
    runs = spark.createDataFrame([(1, 10), (2, 7), (3, 4)], "run int, manual_corrections int")
    assert M.correction_reduction(runs).first()[0] == pytest.approx(0.6)
    p = spark.createDataFrame([("a", 0.9, 5.0, True), ("b", 0.9, 3.0, True)], "provider string, recall_at_1 double, p95 double, comparable boolean")
    assert M.best_provider(p).first()[0] == "b" and M.best_provider(p.limit(1)).count() == 0


def test_small_expressions(spark):
    r = one(
        spark,
        T.clock_seconds(F.lit("01:02:03,500")).alias("t"),
        T.clock_seconds(F.lit("nonsense")).alias("u"),
        X.humanize(F.lit("lms_shots-of ui")).alias("h"),
        T.model_json(F.lit('Sure: {"categories": ["A", "B", "Z"], "confidence": 1.7} ok'), ["A", "B"]).alias("j"),
        V.resample_mono(F.array(*(F.lit(float(x)) for x in (0, 1, 2, 3))), F.lit(2.0)).alias("s"),
        V.frame_times(F.lit(10.0)).alias("f"),
        L.route_models(F.lit("image"), F.lit(0.3), F.lit(False), F.lit(True), "quality", ["siglip2", "dinov3", "paddle-ocr", "minicpm", "lfm"]).alias("m"),
        L.speech_gate(F.lit("mp3"), F.lit(False), F.lit("Song"), F.lit(60.0), F.lit(10)).alias("g"),
        P.kind(F.lit("/a/X.app")).alias("app"),
        P.extension(F.lit("/a/.DS_Store")).alias("dot"),
        T.tokens(F.lit("Café Éa"), True).alias("fold"),
    )
    assert r["t"] == 3723.5 and r["u"] is None and r["h"] == "LMS Shots Of UI"
    assert r["j"]["categories"] == ["A", "B"] and r["j"]["confidence"] == 1.0
    assert r["s"] == [0.0, 2.0] and r["f"] == [0.0, 5.0, 9.5]
    assert r["m"] == ["siglip2", "dinov3", "paddle-ocr", "minicpm", "lfm"] and r["g"]["reason"] == "probe:music-tag"
    assert r["app"] == "application" and r["dot"] == "" and r["fold"] == ["cafe", "ea"]


def test_image_junk(spark):
    none = F.lit(None).cast("array<struct<label:string,confidence:double>>")
    flat, busy = F.array_repeat(F.lit(3), 64), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: x * 4)
    score = lambda px, ocr=None, vision=none, w=64: one(spark, L.assess_junk(F.lit(w), F.lit(w), F.lit(500), px, F.lit(ocr), vision, F.lit(False)).alias("j"))["j"]
    assert score(flat)["is_junk"] and not score(busy, w=2000)["is_junk"]
    assert score(flat, "this text has many more letters than needed")["score"] == 0.0
    face = F.array(F.struct(F.lit("Face").alias("label"), F.lit(0.5).alias("confidence")))
    assert score(flat, vision=face)["score"] == 0.0


def test_publish_swaps_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    ST.publish(spark.createDataFrame([("a", 1)], "k string, v int"), path)
    ST.publish(ST.upsert(ST.published(spark, path), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), ["k"]), path)
    assert {(r["k"], r["v"]) for r in ST.published(spark, path).collect()} == {("a", 2), ("b", 3)}
    ST.publish(spark.createDataFrame([("root_scan_counter", "3")], "k string, v string"), str(tmp_path / "meta"), table="meta")
    assert I.next_generation(ST.published(spark, str(tmp_path / "meta"))).first()["generation"] == 4


def test_commits_are_all_or_nothing(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    assert ST.manifest(spark, store) == (0, {}) and ST.load(spark, store, "meta").count() == 0
    assert ST.commit(spark, store, {"a": one(1), "b": one(1)}) == 1
    value = lambda name: ST.load(spark, store, name).first()["n"]

    class Broken:
        columns = ()

        class write:  # noqa: N801
            @staticmethod
            def parquet(path):
                raise OSError("disk full")

    with pytest.raises(OSError):
        ST.commit(spark, store, {"a": one(2), "b": Broken})
    assert value("a") == 1 and value("b") == 1
    assert ST.commit(spark, store, {"b": one(3)}) == 2 and value("a") == 1 and value("b") == 3
    # A writer that started before another's commit fails and changes nothing.
    with monkeypatch.context() as m:
        m.setattr(ST, "manifest", lambda *_: (1, {}))
        with pytest.raises(OSError):
            ST.commit(spark, store, {"a": one(9)})
    assert value("a") == 1
    for n in range(4, 8):
        ST.commit(spark, store, {"a": one(n)})
    assert value("a") == 7 and value("b") == 3 and len(os.listdir(tmp_path / "store" / "a")) <= 2



def test_changes_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "MAX_CHANGES", 3)
    store = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(list(x), "file_id string, n int")
    want: dict = {}
    steps = [({"a": 1, "b": 1}, ()), ({"b": 2, "c": 2}, ()), ({"d": 3}, ("a",)), ({"a": 4}, ("d",)), ({"c": 5}, ()), ({"e": 6}, ("b",)), ({"b": 7, "e": 7}, ())]
    for new, gone in steps:
        touched = spark.createDataFrame([(k,) for k in [*new, *gone]], "file_id string") if gone else None
        ST.commit(spark, store, {"t": ST.Change(rows(*new.items()), touched=touched)})
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert {r["file_id"]: r["n"] for r in ST.load(spark, store, "t").collect()} == want
        assert len(ST.manifest(spark, store)[1]["t"]) <= 5


def test_providers(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", ""), ("c", None)], "file_id string, text string")
    got = PR.embed_rows(rows, PR.make_provider("hashing")).collect()
    assert [r["file_id"] for r in got] == ["a"] and math.isclose(sum(x * x for x in got[0]["vector"]), 1, rel_tol=1e-5)
    with pytest.raises(RuntimeError):
        PR.embed_rows(rows, PR.make_provider("no such thing"))
    a = spark.createDataFrame([("x", "p", 0.9)], "file_id string, path string, score double")
    b = spark.createDataFrame([("y", "q", 0.2)], "file_id string, path string, distance double")
    assert [r["source"] for r in S.best_visual_search(a, b).collect()] == ["embedding"]
    assert [r["source"] for r in S.best_visual_search(a.limit(0), b).collect()] == ["feature-print"]
    assert S.first_non_empty(a.limit(0), a).count() == 1
