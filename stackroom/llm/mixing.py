"""Mixing overlapping sources to target weights by min-cost flow.

Documents aggregate by membership pattern (the set of sources that hold them). Token
capacity flows from patterns to source quotas; using a pattern's tokens a second time
costs more than the first time, and so on (convex repetition costs), so a flow of least
cost meets the quotas with as little repetition as there can be. Seeded documents then
realise each pattern's flow.

Only patterns and sources reach the driver: their number is checked against ``max_patterns``
and does not grow with the documents. Patterns without a source in common are routed apart,
so a table whose documents have one source each needs no search. Documents are ranked in
three levels, runs of hash slices, slices of the run that the quota cuts and then the one
slice that it cuts, so no source is ever ordered in one task.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackroom.llm.copies import spread_out
from stackroom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS = 2000
#: Slices of a run.
RUN_SLICES = 1024


def word_count(text: Column | str) -> Column:
    """Words of a text (null: 0), JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; excess goes to the rest by weight."""
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], uses: int) -> list[dict[int, int]]:
    """Tokens that each pattern sends to each source, each set of connected sources on its own.

    ``patterns`` are (sources, tokens). Use k of a pattern's tokens costs k*k-(k-1)*(k-1),
    so every token is used once before any is used twice where the quotas allow. Successive
    shortest paths with potentials.
    """
    top = list(range(len(quotas)))

    def find(s):
        while top[s] != s:
            top[s] = top[top[s]]
            s = top[s]
        return s

    for sources, _ in patterns:
        for s in sources[1:]:
            top[find(s)] = find(sources[0])
    parts: dict[int, list[int]] = {}
    for p, (sources, _) in enumerate(patterns):
        if sources:
            parts.setdefault(find(sources[0]), []).append(p)
    flows: list[dict[int, int]] = [{} for _ in patterns]
    for own in parts.values():
        used = sorted({s for p in own for s in patterns[p][0]})
        at = {s: i for i, s in enumerate(used)}
        if len(own) == 1 and len(used) == 1:
            sent = min(quotas[used[0]], patterns[own[0]][1] * uses)
            flows[own[0]] = {used[0]: sent} if sent > 0 else {}
            continue
        for p, flow in zip(own, _route([(tuple(at[s] for s in patterns[p][0]), patterns[p][1]) for p in own], [quotas[s] for s in used], uses)):
            flows[p] = {used[s]: x for s, x in flow.items()}
    return flows


def _route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], uses: int) -> list[dict[int, int]]:
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def arc(a, b, room, cost):
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (sources, tokens) in enumerate(patterns):
        for k in range(1, uses + 1):
            arc(start, p, tokens, 2 * k - 1)
        for s in sources:
            arc(p, n + s, tokens * uses, 0)
    for s, quota in enumerate(quotas):
        arc(n + s, end, quota, 0)
    potential = [0] * len(graph)
    while True:
        dist, via = [math.inf] * len(graph), [None] * len(graph)
        dist[start] = 0
        queue = [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (nd := d + cost + potential[a] - potential[b]) < dist[b]:
                    dist[b], via[b] = nd, (a, k)
                    heapq.heappush(queue, (nd, b))
        if dist[end] == math.inf:
            break
        potential = [p + (d if d < math.inf else 0) for p, d in zip(potential, dist)]
        step, b = math.inf, end
        while b != start:
            a, k = via[b]
            step, b = min(step, graph[a][k][1]), a
        b = end
        while b != start:
            a, k = via[b]
            graph[a][k][1] -= step
            graph[b][graph[a][k][3]][1] += step
            b = a
    flows = []
    for p in range(n):
        flow: dict[int, int] = {}
        for b, _, cost, back in graph[p]:
            if n <= b < n + m and cost == 0 and (sent := graph[b][back][1]):
                flow[b - n] = flow.get(b - n, 0) + sent
        flows.append(flow)
    return flows


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """In rank order, take every document of the cut slice that still fits, and one more if that comes nearer.

    A row stands for ``n`` equal documents; ``took`` says how many of them are taken once more.
    """
    pdf = pdf.sort_values(["rank", "size", "id"], na_position="last", kind="mergesort")
    room = int(pdf["room"].iloc[0])
    sizes, counts = pdf["size"].tolist(), pdf["n"].tolist()
    took = []
    for need, n in zip(sizes, counts):
        k = min(n, room // need) if need > 0 else 0
        took.append(k)
        room -= k * need
    left = [k for k in range(len(sizes)) if took[k] < counts[k] and sizes[k] > 0]
    best = min(left, key=lambda k: sizes[k], default=None)
    if best is not None and sizes[best] - room < room:
        took[best] += 1
    pdf["took"] = took
    return pdf[["id", "pattern", "size", "whole", "n", "took"]]


def mix(docs: DataFrame, *, id_col: str = "doc_id", sources_col: str = "sources", size_col: str = "size", seed: int = 17, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, max_patterns: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """``(documents, sources)`` of the mix.

    ``docs`` has an id, an array of the sources that hold the document (a null source is a
    source; sources sort by code point, null last) and a size. ``weights`` repeat over the
    sources; targets are ``share`` of all sizes, none above ``cap`` times its source's size.

    documents: ``(id, pattern, size, taken)`` for every row, ``taken`` a multiple of its size
    of at most ``cap``. sources: ``(source, source_size, target, routed)``. Empty and null
    sizes take nothing, nor do documents of no source (a null or empty array). An empty table
    gives no rows. Repeated rows are documents of their own: some may be taken and others not.
    Ids keep their type; rows of a null id are documents like others, whose ranks tie. Ties go
    by size. Reruns agree, because ranks follow a seeded hash of the id. Other columns are
    ignored, whatever their names. More than ``max_patterns`` membership patterns, which the
    driver would have to hold, are an error.
    """
    spark = docs.sparkSession
    kind = docs.select(id_col).dtypes[0][1]
    sized = cut(docs.select(F.col(id_col).cast("string").alias("id"), F.to_json(F.struct(F.array_sort(F.array_distinct(sources_col)).alias("s")), {"ignoreNullFields": "false"}).alias("pattern"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size")), "sized")
    found = sized.groupBy("pattern").agg(F.sum("size").alias("tokens"), F.count("*").alias("n")).select("pattern", F.from_json("pattern", "s array<string>").s.alias("s"), "tokens", "n").limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; group the sources first")
    found.sort(key=lambda r: r["pattern"])
    names = sorted({s for r in found for s in r["s"] or ()}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r["s"] or ():
            sizes[at[s]] += r["tokens"]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(r["tokens"] for r in found if r["s"]), cap)
    flows = min_cost_flow([(tuple(at[s] for s in r["s"] or ()), r["tokens"]) for r in found], [round(t) for t in targets], cap)
    reached = [0] * len(names)
    for flow in flows:
        for s, x in flow.items():
            reached[s] += x
    sources = spark.createDataFrame([(n, s, t, x) for n, s, t, x in zip(names, sizes, targets, reached)], "source string, source_size long, target double, routed long")

    plan = []
    for r, flow in zip(found, flows):
        used = sum(flow.values())
        whole, rest = divmod(used, r["tokens"]) if r["tokens"] else (0, 0)
        plan.append((r["pattern"], whole, rest, max(1, r["n"] // SLICE_ROWS)))
    plans = spark.createDataFrame(plan, "pattern string, whole long, rest long, slices long")
    rank = F.xxhash64(F.lit(seed), F.col("id"))
    ranked = sized.join(F.broadcast(plans), "pattern").withColumn("rank", rank).withColumn("slice", F.pmod(F.shiftrightunsigned("rank", 1), F.col("slices")))
    slices = cut(ranked.groupBy("pattern", "slice", "rest").agg(F.sum("size").alias("tokens")), "slices")
    runs = slices.groupBy("pattern", "rest", F.floor(F.col("slice") / RUN_SLICES).alias("run")).agg(F.sum("tokens").alias("tokens"))

    def at_cut_of(parts: DataFrame, by: list[str], order: str, before: Column) -> DataFrame:
        earlier = F.sum("tokens").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        placed = parts.withColumn("before", before + F.coalesce(earlier, F.lit(0)))
        return placed.where("before <= rest and before + tokens > rest")

    run = at_cut_of(runs, ["pattern"], "run", F.lit(0)).select("pattern", "run", F.col("before").alias("ahead"))
    inner = slices.withColumn("run", F.floor(F.col("slice") / RUN_SLICES)).join(F.broadcast(run), ["pattern", "run"])
    cutting = cut(at_cut_of(inner, ["pattern"], "slice", F.col("ahead")).select("pattern", F.col("slice").alias("at"), "before"), "cutting")
    # Only the slice that a quota cuts is ordered: about SLICE_ROWS different documents of each pattern.
    placed = ranked.join(F.broadcast(cutting), "pattern", "left")
    at_cut = F.coalesce(F.col("slice") == F.col("at"), F.lit(False))
    once = F.coalesce(F.col("slice") < F.col("at"), F.lit(False)).cast("long")
    times = lambda n: (F.col("size") * F.least(F.col("whole") + n, F.lit(cap))).cast("long").alias("taken")
    own_id = F.col("id").cast(kind).alias("id")
    clear = placed.where(~at_cut).select(own_id, "pattern", "size", times(once))
    edge = placed.where(at_cut).groupBy("id", "pattern", "size", "whole", "rank", (F.col("rest") - F.col("before")).alias("room")).agg(F.count("*").alias("n"))
    edge = cut(edge.groupBy("pattern").applyInPandas(_fill, "id string, pattern string, size long, whole long, n long, took long"), "edge")
    taken = edge.where("took > 0").withColumn("m", F.col("took")).withColumn("more", F.lit(1)).unionByName(edge.where("took < n").withColumn("m", F.col("n") - F.col("took")).withColumn("more", F.lit(0)))
    chosen = clear.unionByName(spread_out(taken, "m").select(own_id, "pattern", "size", times(F.col("more"))))
    return chosen, sources


def mix_single(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for documents that each have one source, a row for each.

    A null text has no words and is never taken; a null source is one like any other. Texts
    are read whole. Ties, repeated rows, null ids, other columns and empty tables: see :func:`mix`.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.array(F.col(source_col).cast("string")).alias("sources"), word_count(text_col).alias("size"))
    chosen, sources = mix(sized, **options)
    own = chosen.withColumn("source", F.from_json("pattern", "s array<string>").s[0])
    return own.join(F.broadcast(sources), own["source"].eqNullSafe(sources["source"])).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
