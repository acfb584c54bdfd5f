"""Mixing and packing, row by row against plain versions; ids beside null ones; repeated rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stackroom.llm import copies, mixing, packing

BIG = [(1 << 60) + 1, (1 << 60) + 3]


def plain_fill(sizes, weights, total, cap):
    """Targets by raising the level of the sources that are not full, one at a time."""
    out, full = [0.0] * len(sizes), set(i for i, s in enumerate(sizes) if not s)
    while len(full) < len(sizes):
        left = total - sum(out[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        share = {i: left * weights[i] / w for i in range(len(sizes)) if i not in full}
        over = [i for i in share if share[i] > cap * sizes[i]]
        for i in over or share:
            out[i] = cap * sizes[i] if over else share[i]
        if not over:
            break
        full |= set(over)
    return out


def plain_mix(rows, ranks, slice_rows):
    """{(id, source): sorted takes} of rows (id, source, size), each of one source."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [(d, n) for d, t, n in rows if t == s] for s in names}
    sizes = [sum(n for _, n in own[s]) for s in names]
    targets = plain_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    out = defaultdict(list)
    for s, size, target in zip(names, sizes, targets):
        used = min(round(target), 2 * size)
        whole, rest = divmod(used, size) if size else (0, 0)
        slices = defaultdict(list)
        for d, n in own[s]:
            slices[(ranks[d] % (1 << 64) >> 1) % max(1, len(own[s]) // slice_rows)].append((ranks[d], n, d))
        for k in sorted(slices):
            docs = slices[k]
            room, rest = rest, rest - sum(n for _, n, _ in docs)
            if room >= 0 and rest >= 0:
                took = [1] * len(docs)
            elif room < 0:
                took = [0] * len(docs)
            else:
                docs.sort(key=lambda x: (x[0], x[1], str(x[2])))
                took = []
                for _, n, _ in docs:
                    took.append(int(0 < n <= room))
                    room -= n * took[-1]
                left = [i for i, t in enumerate(took) if not t and docs[i][1]]
                best = min(left, key=lambda i: docs[i][1], default=None)
                if best is not None and docs[best][1] - room < room:
                    took[best] = 1
            for (_, n, d), t in zip(docs, took):
                out[d, s].append(n * min(whole + t, 2))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("slice_rows", [2000, 3])
def test_mix_row_by_row(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(mixing, "RUN_SLICES", 4)
    rng = random.Random(4)
    rows = [(k, rng.choice("aaabbc"), rng.randrange(0, 60)) for k in range(400)] + [(k, None, 7) for k in range(400, 420)]
    rows += [(None, "a", 11)] * 5 + [(b, "c", 9) for b in BIG] + [(7, rows[7][1], rows[7][2])] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("pattern", F.lit("x"))
    ranks = {r["doc_id"]: r["rank"] for r in df.select("doc_id", F.xxhash64(F.lit(17), F.col("doc_id").cast("string")).alias("rank")).collect()}
    chosen, sources = mixing.mix(df.withColumn("sources", F.array("source")))
    got = defaultdict(list)
    for r in chosen.select("id", F.from_json("pattern", "s array<string>").s[0].alias("s"), "taken").collect():
        got[r["id"], r["s"]].append(r["taken"])
    assert {k: sorted(v) for k, v in got.items()} == plain_mix(rows, ranks, slice_rows)
    assert dict(chosen.dtypes)["id"] == "bigint"


def test_mix_of_no_source_and_many_sources(spark):
    rows = [(BIG[0], None, 5), (BIG[1], [], 5), (None, ["a"], 5), (None, None, 5), (3, ["a", None], 4), (4, [None], None)]
    chosen, _ = mixing.mix(spark.createDataFrame(rows, "doc_id long, sources array<string>, size long"))
    got = Counter((r["id"], r["taken"] > 0) for r in chosen.collect())
    assert got[BIG[0], False] == 1 and got[BIG[1], False] == 1 and got[None, False] == 1 and got[None, True] == 1 and sum(got.values()) == 6
    flows = mixing.min_cost_flow([((k,), 10) for k in range(12_000)] + [((0, 1), 5)], [15] * 12_000, 2)
    assert flows[5] == {5: 15} and sum(flows[0].values()) + sum(flows[1].values()) + sum(flows[-1].values()) == 30


def plain_pack(items, capacity, per_source):
    """Bins of items (size, source, cluster): each in the tightest bin that takes it, the first of equals."""
    bins = []
    for size, source, cluster in items:
        fits = [b for b in bins if b["room"] >= size and b["room"] > 0 and not (cluster is not None and cluster in b["clusters"]) and not (source is not None and b["sources"][source] >= per_source)]
        b = min(fits, key=lambda b: (b["room"], b["no"]), default=None)
        if b is None:
            b = {"room": capacity, "clusters": set(), "sources": Counter(), "no": len(bins), "held": []}
            bins.append(b)
        b["room"] -= size
        b["clusters"] |= {cluster} - {None}
        b["sources"][source] += source is not None
        b["held"].append((size, source, cluster))
    return Counter(tuple(sorted(b["held"], key=str)) for b in bins)


def test_best_fit_row_by_row():
    rng = random.Random(8)
    for _ in range(30):
        items = sorted(((rng.randrange(0, 90), rng.choice([-1, 0, 0, 1, 2]), rng.choice([-1] * 9 + list(range(4)))) for _ in range(200)), key=lambda x: -x[0])
        bins = defaultdict(list)
        for (size, source, cluster), b in zip(items, packing.best_fit(items, 100, 3)):
            bins[b].append((size, source if source >= 0 else None, cluster if cluster >= 0 else None))
        plain = plain_pack([(a, b if b >= 0 else None, c if c >= 0 else None) for a, b, c in items], 100, 3)
        assert Counter(tuple(sorted(b, key=str)) for b in bins.values()) == plain


def test_packing_by_groups_row_by_row(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randint(0, 50)), rng.choice(["a", "b", None])) for k in range(300)]
    rows += [(k + 500, rows[k][1], "a") for k in range(40)] + [(b, "one two", "b") for b in BIG] + [(None, "same text", "a")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("group", F.lit("mine")).withColumn("copy", F.lit(-1))
    out = packing.pack(df, capacity=60, group_rows=50).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, _, _ in rows)
    assert {r["copy"] for r in out if r["doc_id"] is None} == set(range(30))
    text = {d: (t, s) for d, t, s in rows}
    bins = defaultdict(lambda: defaultdict(list))
    for r in out:
        bins[r["bin_id"] >> 24][r["bin_id"]].append(r)
    assert len(bins) > 4 and max(sum(map(len, b.values())) for b in bins.values()) < 120
    for own in bins.values():
        shown = Counter(text[r["doc_id"]][0] for b in own.values() for r in b)
        item = lambda r: (r["n_words"], text[r["doc_id"]][1], text[r["doc_id"]][0] if text[r["doc_id"]][0] and shown[text[r["doc_id"]][0]] > 1 else None)
        members = sorted((r for b in own.values() for r in b), key=lambda r: (-r["n_words"], r["doc_id"] is None, len(str(r["doc_id"])), str(r["doc_id"]), r["copy"]))
        # Ties may be ordered otherwise here; the numbers of bins and of words must agree.
        plain = plain_pack([item(r) for r in members], 60, packing.PER_SOURCE)
        assert abs(sum(plain.values()) - len(own)) <= 1
        for b in own.values():
            assert sum(r["n_words"] for r in b) <= 60
            assert all(n <= packing.PER_SOURCE for s, n in Counter(text[r["doc_id"]][1] for r in b).items() if s is not None)


def test_copies_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(copies, "RUN", 7)
    df = spark.range(100).selectExpr("id % 3 as k", "if(id % 2 = 0, null, 'x') as v")
    got = Counter((r["k"], r["v"], r["copy"]) for r in copies.numbered(df, "t").collect())
    want = Counter((k % 3, None if k % 2 == 0 else "x") for k in range(100))
    assert set(got.values()) == {1} and Counter(x[:2] for x in got) == want
    assert {c for k, v, c in got if (k, v) == (0, None)} == set(range(want[0, None]))
