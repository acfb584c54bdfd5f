"""Embedding near-dedup by product quantisation.

Vectors go to coarse inverted lists, whose number grows with the rows of the largest label;
residuals are coded in subspaces. With unit vectors, cosine >= t means a distance of at most
r = sqrt(2 - 2t). A partner in another list lies across the bisector of the two centroids, so
a vector probes every list whose bisector is nearer than a margin. A margin of r is exact, but
in many dimensions hardly anything lies that way: the margin is a quarter more than what 999 in
1,000 simulated partners at the threshold need when the index is fitted. A pair is found if either side probes the other's list, and is counted in one of them. Inside a list,
asymmetric distances (query against codes, by table look-up) drop what is farther than r plus
the member's own coding error, which is stored with its code; this bound is exact. Survivors
are reranked by cosine in double precision.

Equal vectors of a label collapse into one class first. A list that is long is cut into blocks
of members and chunks of queries; each meeting returns counts of links and a spanning forest,
never pairs, so a hot label or a tight cluster costs no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm import kernels as K
from stackroom.operators.components import connected_components
from stackroom.session import cut, drop_scratch

SUBSPACES = 8
CODES = 64
#: The index is fitted on about so many vectors (smallest hashes); it holds every vector.
SAMPLE = 16_384
#: Members of a list that a label should have on average.
LIST_ROWS = 128
#: Members of a block, and queries of a chunk.
BLOCK = 1024
CHUNK = 4096
SLICE = 512


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        order = np.argsort(own, kind="stable")
        count = np.bincount(own, minlength=len(c))
        filled = count > 0
        c[filled] = np.add.reduceat(x[order], (np.cumsum(count) - count)[filled], axis=0) / count[filled, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


class Index:
    """Coarse centroids and subspace codebooks for one dimension, and the margin for a cosine."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int, cosine: float, seed: int = 3):
        self.coarse = kmeans(sample, lists, seed)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        m = min(subspaces, sample.shape[1])
        self.cuts = np.linspace(0, sample.shape[1], m + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], codes, seed + 1 + j) for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:]))]
        self.apart = np.sqrt(np.maximum(0, ((self.coarse * self.coarse).sum(axis=1)[:, None] + (self.coarse * self.coarse).sum(axis=1)[None] - 2 * self.coarse @ self.coarse.T)))
        self.margin = self._calibrate(sample, cosine, seed)

    def _gaps(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Distance of each vector from the bisector between its own list and every list."""
        d = (self.coarse**2).sum(axis=1)[None, :] - 2 * x @ self.coarse.T
        return (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * self.apart[own], 1e-12)

    def _calibrate(self, sample: np.ndarray, cosine: float, seed: int, pairs: int = 4096) -> float:
        """A quarter more than the margin that finds 999 in 1,000 simulated partners at the threshold.

        Partners lie at random and, so that they follow the shape of the data, towards other vectors.
        """
        radius = float(np.sqrt(2 - 2 * cosine))
        if len(self.coarse) < 2:
            return radius
        rng = np.random.default_rng(seed)
        x = sample[rng.integers(0, len(sample), 2 * pairs)]
        towards = np.concatenate((rng.normal(size=(pairs, sample.shape[1])), sample[rng.integers(0, len(sample), pairs)]))
        across = towards - (towards * x).sum(axis=1)[:, None] * x
        norm = np.linalg.norm(across, axis=1)
        x, across, norm = x[norm > 1e-9], across[norm > 1e-9], norm[norm > 1e-9]
        if not len(x):
            return radius
        y = cosine * x + np.sqrt(1 - cosine * cosine) * across / norm[:, None]
        own, other = nearest(x, self.coarse), nearest(y, self.coarse)
        at = np.arange(len(x))
        need = np.minimum(self._gaps(x, own)[at, other], self._gaps(y, other)[at, own])
        return min(radius, 1.25 * float(np.quantile(need, 0.999)) + 1e-6)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List numbers, codes, and the distance of each vector from what its code stands for."""
        own = nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        error = np.sqrt(sum(((rest[:, a:b] - book[codes[:, j]]) ** 2).sum(axis=1) for j, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books))))
        return own, codes, error

    def probes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each vector, which lists it probes (its own among them)."""
        return self._gaps(x, own) <= self.margin

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the members of list ``at``, from look-up tables."""
        rest = queries - self.coarse[at]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for j, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books)):
            part = rest[:, a:b]
            table = (part * part).sum(axis=1)[:, None] - 2 * part @ book.T + (book * book).sum(axis=1)[None, :]
            total += np.take(table.astype(np.float32), codes[:, j], axis=1)
        return total


class Indexes(dict):
    """An index for each dimension. One that the sample missed gets a single list, so its search is exhaustive."""

    def __init__(self, cosine: float, codes: int):
        super().__init__()
        self.cosine, self.codes = cosine, codes

    def __missing__(self, dim: int) -> Index:
        rng = np.random.default_rng(dim)
        x, _ = unit_vectors(rng.normal(size=(self.codes, dim)))
        self[dim] = Index(x, 1, SUBSPACES, self.codes, self.cosine)
        return self[dim]


def unit_vectors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and norms."""
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def pack(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    exact = (small == x).all(axis=1)
    return [small[i].tobytes() if ok else x[i].tobytes() for i, ok in enumerate(exact.tolist())]


def unpack(cells: list[bytes], dim: int) -> np.ndarray:
    if all(len(b) == 4 * dim for b in cells):
        return np.frombuffer(b"".join(cells), np.float32).reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64) for b in cells])


def fit(classes: DataFrame, *, cosine: float, subspaces: int, codes: int, sample: int, list_rows: int, seed: int = 5) -> Indexes:
    """An index for each dimension that a sample of about ``sample`` vectors holds.

    The number of lists is that of the largest label's rows over ``list_rows``, at most one for
    every eight vectors of the sample.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("largest"), F.sum("n").alias("n"))
    sizes = {r["dim"]: r for r in sizes.orderBy(F.desc("n"), "dim").limit(256).collect()}
    rows = sum(r["n"] for r in sizes.values())
    share = min(1.0, sample / max(1, rows))
    picked = classes.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    picked = picked.where(F.col("dim").isin(list(sizes))).select("rep", "dim", "label", F.col("vec").cast("array<float>").alias("vec")).mapInArrow(_packed, "rep long, dim int, label string, vec binary").collect()
    out = Indexes(cosine, codes)
    for dim in sorted({r["dim"] for r in picked}):
        own = sorted((r for r in picked if r["dim"] == dim), key=lambda r: (r["rep"], r["label"]))[: 2 * sample]
        x, norm = unit_vectors(unpack([bytes(r["vec"]) for r in own], dim))
        x = x[(norm > 0) & np.isfinite(norm)]
        lists = min(-(-sizes[dim]["largest"] // list_rows), len(x) // 8)
        if len(x):
            out[dim] = Index(x, max(1, lists), subspaces, codes, cosine)
    return out


def _packed(batches):
    for batch in batches:
        cells = [v.astype(np.float32).tobytes() for v in K.list_rows(batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cells, pa.binary())], names=["rep", "dim", "label", "vec"])


_PLACED = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()), ("list", pa.int32()), ("code", pa.binary()), ("error", pa.float64()), ("vec", pa.binary()), ("probes", pa.list_(pa.int32()))])


def _place(index):
    def run(batches):
        for batch in batches:
            dims, cells = batch.column(1).to_numpy(), K.list_rows(batch.column(4))
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                for part in np.array_split(at, -(-len(at) // 1000)):
                    raw = np.array([cells[i] for i in part.tolist()], np.float64)
                    x, _ = unit_vectors(raw)
                    own, codes, error = index[dim].encode(x)
                    asked = index[dim].probes(x, own)
                    asked[np.arange(len(x)), own] = True
                    rows = batch.take(pa.array(part))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(1), rows.column(2), rows.column(3), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(pack(raw), pa.binary()), pa.array([np.nonzero(p)[0].astype(np.int32) for p in asked], pa.list_(pa.int32()))],
                        schema=_PLACED,
                    )

    return run


def _forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the smallest one reachable over the edges."""
    low = np.arange(nodes)
    while len(a):
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


_FOUND = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])


def meeting(table: pa.Table, index: Indexes, cosine: float) -> pa.Table:
    """Link counts and a spanning forest of a chunk of queries and a block of members of one list."""
    none = pa.Table.from_pylist([], schema=_FOUND)
    asks = table.column("query").to_numpy(zero_copy_only=False)
    q, m = table.filter(pa.array(asks)).combine_chunks(), table.filter(pa.array(~asks)).combine_chunks()
    if not q.num_rows or not m.num_rows:
        return none
    dim, at = m.column("dim")[0].as_py(), m.column("list")[0].as_py()
    one = index[dim]
    radius = np.sqrt(2 - 2 * cosine)
    vq, vm = unpack(q.column("vec").to_pylist(), dim), unpack(m.column("vec").to_pylist(), dim)
    xq, nq = unit_vectors(vq)
    nm = np.linalg.norm(vm, axis=1)
    rq, rm = q.column("rep").to_numpy(), m.column("rep").to_numpy()
    cq, cm = q.column("copies").to_numpy(), m.column("copies").to_numpy()
    own = q.column("own").to_numpy()
    codes = np.frombuffer(b"".join(m.column("code").to_pylist()), np.uint8).reshape(len(rm), -1)
    bound = ((radius + m.column("error").to_numpy() + 1e-4) ** 2).astype(np.float32)
    # Which member probes which list: a pair that probes both ways counts in the list of smaller number.
    probed = np.zeros((len(rm), max(int(own.max()), at, len(one.coarse)) + 1), bool)
    lists = m.column("probes").to_pylist()
    probed[np.repeat(np.arange(len(rm)), [len(p) for p in lists]), np.concatenate([np.asarray(p, np.int64) for p in lists])] = True
    nodes, place = np.unique(np.concatenate((rq, rm)), return_inverse=True)
    pq, pm = place[: len(rq)], place[len(rq) :]
    count = np.zeros(len(nodes), np.float64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(rq), SLICE):
        e = min(len(rq), s + SLICE)
        near = one.distances(xq[s:e], at, codes) <= bound[None, :]
        here = own[s:e] == at
        near &= np.where(here[:, None], rq[s:e, None] < rm[None, :], (rq[s:e, None] != rm[None, :]) & ~(probed[:, own[s:e]].T & (own[s:e] < at)[:, None]))
        rows, cols = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
        if not len(rows):
            continue
        cos = (vq[s:e][rows] @ vm[cols].T) / (nq[s:e][rows][:, None] * nm[cols][None, :])
        iq, im = np.nonzero(near[np.ix_(rows, cols)] & (cos >= cosine))
        iq, im = rows[iq] + s, cols[im]
        if not len(iq):
            continue
        count += np.bincount(pq[iq], cm[im], len(nodes)) + np.bincount(pm[im], cq[iq], len(nodes))
        low = _forest(len(nodes), pq[iq], pm[im])
        tied = np.nonzero(low != np.arange(len(nodes)))[0]
        ends.append((tied, low[tied]))
    if not ends:
        return none
    low = _forest(len(nodes), np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends]))
    hit = np.nonzero(count)[0]
    return pa.Table.from_arrays([pa.array(nodes[hit]), pa.array(count[hit].astype(np.int64)), pa.array(nodes[low[hit]])], schema=_FOUND)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, subspaces: int = SUBSPACES, codes: int = CODES, sample: int = SAMPLE, list_rows: int = LIST_ROWS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id, kept)``, one for each row of ``vectors``.

    Vectors link when their labels are equal and not null, they have as many components and
    their cosine is at least ``cosine`` (above 0). A vector that is null, empty, zero or has
    a null or non-finite component links with nothing; so does a null id. Ids are whole
    numbers. Repeated rows (one id, equal vectors) count as vectors of their own; rows that
    share an id but not the vector share its links. Other columns are ignored, whatever their
    names. An empty table gives no rows. No pair below ``cosine`` links; a pair is missed only if
    both lie farther from their lists' bisector than the margin of the index, a quarter more
    than what 999 in 1,000 simulated pairs at the very threshold need.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    sane = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists("vec", lambda x: F.abs(x) > 1e-150)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sane, F.lit(False))
    plain = F.transform("vec", lambda x: x + 0.0)  # one zero, not two
    keyed = base.withColumn("usable", usable)
    hashed = keyed.where("usable").select("vec_id", "label", "vec", F.xxhash64(F.lit(1), "label", plain).alias("h"), F.xxhash64(F.lit(2), plain, "label").alias("g"))
    classes = cut(hashed.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")).withColumn("dim", F.size("vec")), "vectors")
    index = fit(classes, cosine=cosine, subspaces=subspaces, codes=codes, sample=sample, list_rows=list_rows)
    kinds = "label string, dim int, rep long, copies long, list int, code binary, error double, vec binary, probes array<int>"
    placed = cut(classes.select("label", "dim", "rep", "copies", "vec").mapInArrow(_place(index), kinds), "placed")
    slim = placed.select("label", "dim", F.col("list").alias("own"), F.explode("probes").alias("list"))
    sizes = slim.groupBy("label", "dim", "list").agg(F.count("*").alias("queries"), F.count_if(F.col("own") == F.col("list")).alias("members"))
    long_lists = cut(sizes.where((F.col("queries") > chunk) | (F.col("members") > block)).select("label", "dim", "list", F.ceil(F.col("members") / block).cast("int").alias("blocks"), F.ceil(F.col("queries") / chunk).cast("int").alias("chunks")).where("blocks > 0"), "longlists")

    def dealt(rows: DataFrame, own_count: str, other_count: str, own: str, other: str) -> DataFrame:
        wide = rows.join(long_lists, ["label", "dim", "list"], "left")
        mine, theirs = F.coalesce(own_count, F.lit(1)), F.coalesce(other_count, F.lit(1))
        return wide.withColumn(own, F.pmod(F.xxhash64("rep"), mine).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), theirs - 1)))

    held = ["rep", "copies", "own", "vec"]
    nothing = F.lit(None)
    asking = placed.select("label", "dim", "rep", "copies", F.col("list").alias("own"), "vec", F.explode("probes").alias("list"))
    asking = dealt(asking, "chunks", "blocks", "c", "b").select("label", "dim", "list", "b", "c", F.lit(True).alias("query"), *held, nothing.cast("binary").alias("code"), nothing.cast("double").alias("error"), nothing.cast("array<int>").alias("probes"))
    asked = dealt(placed.withColumn("own", F.col("list")), "blocks", "chunks", "b", "c").select("label", "dim", "list", "b", "c", F.lit(False).alias("query"), *held, "code", "error", "probes")

    def kernel(table: pa.Table) -> pa.Table:
        return meeting(table, index, cosine)

    found = cut(asking.unionByName(asked).groupBy("label", "dim", "list", "b", "c").applyInArrow(kernel, "rep long, n long, other long"), "found")
    drop_scratch(vectors.sparkSession, placed)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    info = classes.select("h", "g", "rep", "copies").join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    info = cut(info.select("h", "g", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component")), "info")
    drop_scratch(vectors.sparkSession, classes)
    linked = hashed.select("vec_id", "h", "g").join(info, ["h", "g"]).select("vec_id", (F.col("n") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = keyed.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
