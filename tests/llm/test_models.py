"""Language ID, quality rules, secret scans, WARC, mixing and packing: round trips, accuracy, invariants, edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from stackroom.llm import langid, mixing, packing, quality, secrets, warc
from stackroom.llm.queries import QUERIES
from stackroom.session import table

DOC = "doc_id long, text string"
ODD = [(90_001, None), (90_002, ""), (90_003, " \n \n"), (90_004, "12 34"), (90_005, "x" * 200_000), (90_006, "lang n key source")]


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    got = QUERIES["op3_language_id"](spark, sf_dir)
    truth = documents(spark, sf_dir).select("doc_id", "lang", F.length("text").alias("n"))
    rows = got.join(truth, "doc_id").where("held_out and n > 40").collect()
    assert len(rows) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark, sf_dir):
    model = langid.fit(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    odd = spark.createDataFrame([(*r, "xx", 1) for r in ODD], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (90_001, 90_002, 90_003, 90_004))
    assert got[90_005]["lang_pred"] in model.names
    none = langid.fit(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert none is None and {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 97, 256])
def test_features_do_not_depend_on_pieces(monkeypatch, piece):
    for text in ("Abc déf  ghij 12 " * 50, "", "a", "ab", "   ", "x" * 97):
        text = text.encode()
        lang, (base, at, w) = langid.counts_of(text), quality.features(text)
        with monkeypatch.context() as m:
            m.setattr(langid, "PIECE", piece)
            m.setattr(quality, "PIECE", piece)
            assert (langid.counts_of(text) == lang).all()
            base2, at2, w2 = quality.features(text)
            assert base2 == base and (at2 == at).all() and (w2 == w).all()


def test_language_counts_match_brute_force():
    text = "Abc,  déf! 9"
    folded = b"abc d\xc3\xa9f "
    grams = [folded[i : i + n] for n in range(1, 5) for i in range(len(folded) - n + 1)]
    assert langid.counts_of(text.encode()).sum() == len(grams)
    assert (langid.counts_of(text.encode()) == langid.counts_of(folded)).all()
    assert sorted(x for x in langid.counts_of(folded).tolist() if x)[-1] == max(Counter(grams).values())


def test_quality_base_matches_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()] + ODD
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality.score(spark.createDataFrame(rows, DOC), None).collect()}
    assert got == {d: brute.base_measures(t) for d, t in rows}


def test_quality_separates_labelled_rows(spark):
    data = "/root/testdata/sf0.01"
    out = QUERIES["op6_quality_rules"](spark, data)
    rows = out.join(table(spark, data, "labels"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.1
    assert all(0 <= r["probability"] <= 1 for r in rows)


def test_quality_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "good text " * 40), (2, "short")], DOC)
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model is None
    wide = docs.withColumn("probability", F.lit("mine"))
    assert quality.keep_good(wide, None).columns == wide.columns


def test_secrets_match_brute_force(spark, sf_dir):
    rng = random.Random(1)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()] + ODD
    rows += [(1000 + i, t) for i, t in enumerate((f"é Token = '{key}'", "token=a.token:abcdefgh12", "AKIA" + "A1" * 6 + " AKIAX", "deadbeef" * 4 + " " + "deadbeef" * 3, "secret: short password=longenough.1", f"before {key} after the_quick_brown_fox_jumps_over", "😀 api_key=12345678 \U0001f600"))]
    df = spark.createDataFrame(rows, DOC)
    docs = documents(spark, sf_dir)
    model = secrets.train(docs)
    got = {r["doc_id"]: r for r in secrets.report(secrets.scan(df, model)).collect()}
    for d, t in rows:
        want = brute.secrets(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[d]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), d
        kinds = Counter(k for k, _, _ in want)
        assert (got[d]["n_assign"], got[d]["n_access"], got[d]["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(said.split(",")) - {""} <= set(got[d]["spans"].split(","))
    assert got[1005]["spans"] == f"markov:7:{7 + len(key)}"
    assert secrets.scan(df.limit(0), model).count() == 0


def test_markov_models_tell_random_from_ordinary(spark, sf_dir):
    model = secrets.train(documents(spark, sf_dir))
    rng = random.Random(9)
    random_ = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rng.randint(20, 44))) for _ in range(200)]
    words = [r["w"] for r in documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).limit(3000).collect()]
    plain = ["_".join(rng.choice(words) for _ in range(5))[:44] for _ in range(200)]
    df = spark.createDataFrame([(t, True) for t in random_] + [(t, False) for t in plain], "t string, secret boolean")
    rows = df.select("secret", (secrets.ratio(F.col("t"), model) >= secrets.RATIO).alias("hit")).collect()
    assert sum(r["hit"] for r in rows if r["secret"]) >= 190
    assert sum(r["hit"] for r in rows if not r["secret"]) <= 4


def test_warc_round_trip(spark, sf_dir, tmp_path):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    first = pages.orderBy("page_id").first()
    odd = spark.createDataFrame([(5001, "http://x/a\r\nb c", None), (5002, None, ""), (5003, "http://é/", first["html"]), (5004, "u", "é\r\n\r\nWARC/1.1"), (5003, "http://é/", first["html"]), (None, "n", "null id"), (5005, "z", "x" * 3_000_000)], "page_id long, url string, html string")
    everything = pages.unionByName(odd)
    bundles = warc.write_archives(everything, frame_bytes=20_000, bundle_bytes=200_000)
    assert bundles.count() > 1
    got = warc.read_archives(bundles, payloads=True).collect()
    assert len(got) == everything.count()
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r)
    for p in everything.collect():
        body = (p["html"] or "").encode()
        r = by[p["page_id"]][0]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == warc.digest(body)
        assert bytes(r["payload"]) == (body if r["record_type"] == "response" else b"")
    assert all(r["record_type"] == "revisit" and r["refers_to"] == first["page_id"] for r in by[5003]) and len(by[5003]) == 2
    assert by[5001][0]["record_type"] == "response" and by[5002][0]["refers_to"] == 5001 and by[None][0]["refers_to"] is None
    wanted = everything.where("page_id in (0, 1, 5002, 5003, 5004)").select("page_id")
    want = sorted((p["page_id"], p["html"]) for p in everything.where("page_id in (0, 1, 5002, 5003, 5004)").collect())
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in warc.fetch(bundles, wanted).collect()) == want
    folder = f"file://{tmp_path}/archives"
    assert warc.export(bundles, folder).count() == bundles.count()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in warc.fetch_files(warc.index_of(bundles), folder, wanted).collect()) == want
    assert warc.fetch(bundles, wanted.limit(0)).count() == 0
    assert warc.write_archives(pages.limit(0)).count() == 0


def test_warc_minimum_size_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "same"), (2, "b", "same")], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.read_archives(warc.write_archives(pages, min_bytes=5)).collect()} == {"response"}
    paths = [r["path"] for r in warc.export(warc.write_archives(pages), str(tmp_path)).collect()]
    data = open(paths[0], "rb").read()
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") >= 1 and warc.seek_table(data)
    with pytest.raises(ValueError):
        warc.seek_table(data[:-1] + b"x")


def test_water_fill_and_flow():
    assert mixing.water_fill([100, 10, 0], [3, 1, 2], 165, 2) == [145.0, 20.0, 0.0]
    flows = mixing.min_cost_flow([((0,), 10), ((0, 1), 10), ((1,), 2)], [12, 12], 2)
    sent = [sum(f.get(s, 0) for f in flows) for s in (0, 1)]
    assert sent == [12, 12] and all(sum(f.values()) <= 2 * t for f, t in zip(flows, (10, 10, 2)))
    assert [sum(f.values()) for f in flows][0] <= 11  # nothing repeats before the rest is used once


def test_mix_meets_targets(spark):
    got = [r.asDict() for r in QUERIES["op2_mix_sources"](spark, "/root/testdata/sf0.01").collect()]
    again = [r.asDict() for r in QUERIES["op2_mix_sources"](spark, "/root/testdata/sf0.01").collect()]
    order = lambda rows: sorted(map(lambda r: tuple(r.values()), rows))
    assert order(got) == order(again)
    source = {r["doc_id"]: r["source"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= max(100, 0.01 * target[s]) for s in target)


def test_mix_of_overlapping_sources_and_odd_rows(spark):
    rows = [(i, ["a"] if i % 3 else ["a", "b"], 10 + i % 7) for i in range(3000)] + [(9001, [None], 5), (9002, ["b"], None), (None, ["a"], 4), (5, ["a"], 15)]
    chosen, sources = mixing.mix(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long"))
    out = chosen.collect()
    assert len(out) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert {r["source"] for r in sources.collect()} == {"a", "b", None}
    empty = spark.createDataFrame([], "doc_id long, text string, source string, size long")
    assert mixing.mix_single(empty).count() == 0


def _check_bins(rows, docs, capacity, per_source):
    fill, clusters, sources, seen = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(list)
    for r in rows:
        fill[r["bin_id"]] += r["n_words"]
        seen[(r["doc_id"], r["copy"])].append((r["start_word"], r["n_words"]))
        if r["n_words"] < capacity:
            text, source = docs[r["doc_id"]]
            if text:
                clusters[r["bin_id"]][text] += 1
            sources[r["bin_id"]][source] += 1
    assert max(fill.values()) <= capacity
    assert all(max(c.values()) == 1 for c in clusters.values())
    assert all(n <= per_source for c in sources.values() for s, n in c.items() if s is not None)
    return seen


def test_packing(spark, sf_dir):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents(spark, sf_dir).collect()] + [(d, t, "odd") for d, t in ODD] + [(80_000 + i, "same text here", "s") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("group", F.lit("clash")).withColumn("cluster", F.lit(1))
    got = packing.pack(df, capacity=500).collect()
    seen = _check_bins(got, {d: (t, s) for d, t, s in rows}, 500, packing.PER_SOURCE)
    for d, t, _ in rows:
        pieces = sorted(seen[(d, 0)])
        assert sum(n for _, n in pieces) == len(brute.words(t)) and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    twice = packing.pack(df.where("doc_id < 5").unionByName(df.where("doc_id < 5"))).collect()
    assert {r["copy"] for r in twice} == {0, 1}
    assert packing.pack(df.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    # Bins left with 4, 3 and 1: an item of 3 of a new cluster goes to the second, of cluster 0 past it.
    items = [(6, 0, -1), (7, 1, 0), (9, 2, -1), (3, 3, 0), (3, 4, 1)]
    assert packing.best_fit(items, 10, 1) == [0, 1, 2, 0, 1]
    assert packing.best_fit([(1, 0, -1)] * 3, 10, 2) == [0, 0, 1]


def test_queries_return_what_their_contracts_say(spark, sf_dir):
    want = {
        "op2_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
        "op3_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op6_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op7_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
        "op8_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, sf_dir)
        assert columns <= set(df.columns)
        assert df.count() == table(spark, sf_dir, "pages" if name == "op7_warc" else "documents").count()


def test_training_is_repeatable(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    a, b = quality.fit(docs, labels), quality.fit(docs.repartition(3), labels)
    assert np.allclose(a.weights, b.weights) and a.slope == pytest.approx(b.slope)
