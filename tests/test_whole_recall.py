"""Recall over the whole table of vectors."""

import numpy as np

from stackroom.plans import queries as Q


def test_recall_reads_every_vector(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), int(i % 6) if i % 10 else None) for i in range(120)]
    rows.append((500, rows[1][1], 1))  # the nearest of label 1 stands far beyond the first 25
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    first = {}
    for i, v, x in rows:
        if x is not None:
            first.setdefault(x, (i, np.array(v)))
    used = {i for i, _ in first.values()}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    nearest = {x: max((r for r in rows if r[0] not in used), key=lambda r: cosine(v, np.array(r[1]))) for x, (_, v) in first.items()}
    assert nearest[1][0] == 500
    got = Q.cosine_matrix_recall(spark, str(tmp_path)).first()["recall_at_1"]
    assert got == round(sum(nearest[x][2] == x for x in first) / len(first), 6)
