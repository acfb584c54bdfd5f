"""Lines that share a segment with very many others: the same links, without comparing all of them."""

import random
import time

import brute
import pytest

from stackroom.llm import linededup

HEAD = "Licensed to the Acme Foundation "


def crowd(n, seed=1):
    rng = random.Random(seed)
    return [HEAD + "".join(rng.choice("abcdefgh ") for _ in range(30)) for _ in range(n)]


def changed(line, rng):
    x = list(line)
    for _ in range(rng.randrange(4)):
        p = rng.randrange(len(x))
        x[p : p + rng.randrange(2)] = rng.choice(["", "q", "zz"])
    return "".join(x)


@pytest.mark.parametrize("crowd_size,parts", [(8, 12), (8, 4), (30, 7)])
def test_refined_keys_lose_no_link(spark, monkeypatch, crowd_size, parts):
    monkeypatch.setattr(linededup, "CROWD", crowd_size)
    monkeypatch.setattr(linededup, "PARTS", parts)
    rng = random.Random(3)
    lines = crowd(50)
    lines += [changed(x, rng) for x in lines for _ in range(3)] + [HEAD + "version " + str(k) for k in range(40)]
    lines += ["é" + x[:-6] + " tail" + str(rng.randrange(50)) for x in lines[:40]]
    rows = [(k, x + "\nshort" + str(k % 7)) for k, x in enumerate(lines)]
    got = {r["doc_id"]: ([*r["dropped"]], r["n_exact"], r["n_links"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.dedup_lines(rows)


def test_a_crowd_grows_with_its_lines(spark):
    took = {}
    for n in (2_000, 10_000, 20_000):  # the first compiles
        lines = crowd(n)
        df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)] + [(n + k, x[:-1] + "!") for k, x in enumerate(lines[:100])], "doc_id long, text string")
        t = time.time()
        rows = linededup.dedup_lines(df).where("n_links > 0").count()
        took[n] = time.time() - t
        assert rows == 200
    assert took[20_000] < 3 * took[10_000], took
