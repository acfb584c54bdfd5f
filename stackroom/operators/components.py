"""Connected components by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond", 2014. Each round
is two aggregates and two joins over edges; the label of a component is its
smallest member. Nothing is collected but whether a round was the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.session import cut, drop_scratch


#: Edges that one task may hold.
SMALL = 100_000


def _contract(batches):
    """Replace the edges a task holds by a spanning forest of stars."""
    import pandas as pd

    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush():
        rows = [(x, find(x)) for x in list(parent) if find(x) != x]
        parent.clear()
        return pd.DataFrame(rows, columns=["u", "v"])

    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 500_000:
            yield flush()
    yield flush()


def _neighbour_minimum(pairs: DataFrame) -> DataFrame:
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m")), "star")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, contract: bool = True, max_rounds: int = 64) -> DataFrame:
    """Rows ``(node, component)`` for every node that has an edge.

    ``component`` is the smallest node reachable. Self-loops, repeated edges and
    edges with a null end are ignored; an edge list without edges gives no rows.
    ``contract`` first shrinks each task's edges with a union-find (memory bounded
    by flushing), which is only worth its Python worker where Python runs anyway.
    Once no more than ``SMALL`` edges are left, one task's union-find ends the rounds.
    """
    spark = edges.sparkSession
    cur = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        if {a, b}.isdisjoint({"u", "v"})
        else edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    )
    if contract and dict(cur.dtypes)["u"] == "bigint":
        cur = cur.mapInPandas(_contract, cur.schema)
    cur = cut(cur.distinct(), "edges")
    for _ in range(max_rounds):
        if cur.count() <= SMALL:
            nxt = cut(cur.coalesce(1).mapInPandas(_contract, cur.schema), "stars")
            drop_scratch(spark, cur)
            cur = nxt
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _neighbour_minimum(both)
        large = cut(
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct(),
            "large",
        )
        low2 = _neighbour_minimum(large)
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = cut(small, "small")
        # Done when every edge is a spoke: no node has two parents, and no parent has one.
        roles = nxt.select(F.col("u").alias("x"), F.lit(1).alias("child")).unionByName(nxt.select(F.col("v").alias("x"), F.lit(0).alias("child")))
        loose = roles.groupBy("x").agg(F.sum("child").alias("n"), F.min("child").alias("least")).where("n > 1 or (n = 1 and least = 0)")
        done = loose.limit(1).count() == 0
        for old in (cur, low, large, low2):
            drop_scratch(spark, old)
        cur = nxt
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
