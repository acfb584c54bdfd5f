"""Feature prints met in blocks give what the scorer gives pair by pair."""

import random

from stackroom.functions import vectors as V
from stackroom.operators import similarity as C


def test_blocks_as_pairs(spark):
    rng = random.Random(3)
    rows = [(f"n{i:03}", [rng.randint(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [("short", [0, 1]), ("short2", [0, 1]), ("hole", [0, None, 0, 0, 0, 0]), ("none", None)]
    nodes = spark.createDataFrame(rows, "id string, feature array<int>")
    changed = nodes.where("id like 'n00%'").select("id")
    plain = lambda a, b: V.position_agreement(a, b)
    for some in (None, changed):
        edges = [sorted({tuple(r) for r in C.feature_edges(nodes, threshold=0.5, changed=some, block=40, **how).collect()}) for how in ({}, {"scorer": plain})]
        assert edges[0] == edges[1]
        assert some is not None or ("short", "short2", 1.0, "nearDuplicate", "featurePrint") in edges[0]


def test_empty_prints_and_no_pair_by_pair_scores(spark):
    nodes = spark.createDataFrame([("a", []), ("b", []), ("c", [1, 2]), ("d", [1, 2])], "id string, feature array<int>")
    edges = C.feature_edges(nodes, threshold=0.7)
    assert [(r["a"], r["b"], r["score"]) for r in edges.collect()] == [("c", "d", 1.0)]
    assert "zip_with" not in edges._jdf.queryExecution().toString()
