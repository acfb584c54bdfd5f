"""MinHash near-dedup with bottom-k sketches from one hash function.

One pass over the texts hashes every document's set of five-word shingles and keeps its
``sketch`` smallest hashes. Documents with equal sets become one class at once. The
``listed`` smallest hashes make inverted lists; a document enters only the lists of its
rarest values, as many as a pair at the threshold needs to meet in one (prefix filter).
Lists propose pairs, the bottom-k sketch of the two sets' union estimates their Jaccard
similarity, and full sets confirm it.

Hot lists are never expanded into pairs. Round one compares every member with two hubs of
the list and contracts what matches. Round two takes lists that still hold several
components: members outside the list's main component meet all others, block against
block. Where a list has several blocks, only sketches travel to their meetings, and full sets
follow for the documents of likely pairs; a meeting returns a spanning forest of its links. Lists that are still long
by then (thousands of documents with a passage in common and else unlike) are not compared:
their documents are listed again, under the rarest quarter of their full sets, which such
passages do not reach, and go through both rounds once more. Both rounds confirm on full
sets, so components are those of all links.

Misses: a pair at exactly the threshold has to share at least ``floor`` of ``listed``
bottom values, which fails with a probability below 1e-7 (binomial tail at 0.75). With
``exact`` every document is listed under the rarest quarter of its full set, and no pair at
the threshold can be missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.llm import kernels as K
from stackroom.operators.components import connected_components
from stackroom.session import cut, drop_scratch

SHINGLE = 5
SKETCH = 64
LISTED = 32
BLOCK = 256
#: A list with so many documents outside its main component is listed again by full sets.
LONG = 2048


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles (A-Z lower-cased)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = K.word_hashes(words)
    return np.unique(K.rolling(h, min(width, len(h))))


def tail_floor(size: int, similarity: float) -> int:
    """Values that a union sketch of ``size`` shares at least, but for a tail of six deviations."""
    return max(1, math.floor(size * similarity - 6 * math.sqrt(size * similarity * (1 - similarity))))


def _features(width, sketch):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            n, fp, sk = [], [], []
            for text in K.raw(batch.column(1)):
                s = shingle_hashes(text, width)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                sk.append(K.signed(s[:sketch]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), K.long_lists(sk)], schema=schema)

    return run


def _sets(width):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_hashes(t, width) for t in K.raw(part.column(1))]
                own = [xxhash.xxh3_128_digest(s.tobytes()) == fp for s, fp in zip(sets, part.column(2).to_pylist())]
                ids = part.column(0).cast(pa.int64()).filter(pa.array(own, pa.bool_()))
                yield pa.RecordBatch.from_arrays([ids, K.long_lists([K.signed(s) for s, ok in zip(sets, own) if ok])], schema=schema)

    return run


def overlaps(left: list, right: list, columns: int = 20_000) -> np.ndarray:
    """Sizes of all intersections of the sets on both sides (arrays of distinct values)."""
    out = np.zeros((len(left), len(right)), np.float32)
    va, vb = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(va, vb)
    if not len(common):
        return out
    ra, rb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    ca, cb = np.searchsorted(common, va), np.searchsorted(common, vb)
    ca[ca == len(common)] = 0
    cb[cb == len(common)] = 0
    ina, inb = common[ca] == va, common[cb] == vb
    ra, ca, rb, cb = ra[ina], ca[ina], rb[inb], cb[inb]
    for at in range(0, len(common), columns):
        width = min(columns, len(common) - at)
        ma, mb = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        own = (ca >= at) & (ca < at + width)
        ma[ra[own], ca[own] - at] = 1
        own = (cb >= at) & (cb < at + width)
        mb[rb[own], cb[own] - at] = 1
        out += ma @ mb.T
    return out


class _Block:
    """One side of a meeting: documents with their sets (or sketches), each once."""

    def __init__(self, table: pa.Table, rows: np.ndarray, column: str):
        ids = table.column("doc_id").to_numpy()[rows]
        self.doc, first = np.unique(ids, return_index=True)
        self.rows = rows[first]
        self.n = table.column("n").to_numpy()[self.rows]
        self.comp = table.column("comp").to_numpy()[self.rows]
        cells = K.list_rows(table.column(column).combine_chunks())
        self.sets = [cells[i] for i in self.rows.tolist()]


def _sides(table: pa.Table, column: str) -> tuple[_Block, _Block]:
    """The two blocks that meet. ``side`` 0 holds one, 1 the other (2: a block against itself)."""
    side = table.column("side").to_numpy()
    if (side == 2).all():
        one = _Block(table, np.arange(len(side)), column)
        return one, one
    return _Block(table, np.nonzero(side == 0)[0], column), _Block(table, np.nonzero(side == 1)[0], column)


def _likely(left: _Block, right: _Block, percent: int, sketch: int) -> np.ndarray:
    """Which pairs of different components the union sketch doesn't rule out.

    A pair's shared sketch values bound what its union sketch shares.
    """
    na, nb = left.n[:, None], right.n[None, :]
    maybe = (left.comp[:, None] != right.comp[None, :]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
    if not maybe.any():
        return maybe
    shared = overlaps([x[:sketch] for x in left.sets], [x[:sketch] for x in right.sets])
    union = np.minimum(sketch, np.minimum(na, sketch) + np.minimum(nb, sketch) - shared)
    p = percent / 100
    return maybe & (shared >= np.maximum(1, np.floor(union * p - 6 * np.sqrt(union * p * (1 - p)))))


def block_candidates(table: pa.Table, percent: int, sketch: int) -> pa.Table:
    """The rows of a block pair whose documents are in a likely pair, without their sketches."""
    left, right = _sides(table, "sketch")
    slim = table.drop_columns(["sketch"])
    if not len(left.doc) or not len(right.doc):
        return slim.slice(0, 0)
    maybe = _likely(left, right, percent, sketch)
    if left is right:
        return slim.take(left.rows[maybe.any(axis=1) | maybe.any(axis=0)])
    return slim.take(np.concatenate((left.rows[maybe.any(axis=1)], right.rows[maybe.any(axis=0)])))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def block_links(table: pa.Table, percent: int, sketch: int) -> pa.Table:
    """A spanning forest of the links between the documents of one block pair.

    Pairs already in one component are skipped; links are confirmed on full sets.
    """
    left, right = _sides(table, "shingles")
    none = _LINKS.empty_table()
    if not len(left.doc) or not len(right.doc):
        return none
    maybe = _likely(left, right, percent, sketch)
    if left is right:
        maybe = np.triu(maybe, 1)
    rows, cols = np.nonzero(maybe.any(axis=1))[0], np.nonzero(maybe.any(axis=0))[0]
    if not len(rows):
        return none
    both = overlaps([left.sets[i] for i in rows.tolist()], [right.sets[j] for j in cols.tolist()]).astype(np.int64)
    linked = maybe[np.ix_(rows, cols)] & (100 * both >= percent * (left.n[rows][:, None] + right.n[cols][None, :] - both))
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out_a, out_b = [], []
    ida, idb = left.doc[rows].tolist(), right.doc[cols].tolist()
    ca, cb = left.comp[rows].tolist(), right.comp[cols].tolist()
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        ra, rb = find(ca[i]), find(cb[j])
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out_a.append(ida[i])
            out_b.append(idb[j])
    return pa.Table.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=_LINKS)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = SHINGLE, sketch: int = SKETCH, listed: int = LISTED, block: int = BLOCK, long: int = LONG, exact: bool = False) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id, kept)``, one for each row of ``docs``.

    Null, empty or blank texts have no shingles, link with nothing and are kept. Texts are read
    whole, however long. Ids are whole numbers. A null id is kept with a null component.
    Repeated rows share a component and stay as they are; of rows that share an id but not the
    text, the set of the smallest fingerprint stands for the id. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = cut(base.mapInArrow(_features(width, sketch), "doc_id long, n long, fp binary, sketch array<long>"), "sketches")
    known = feats.where("n > 0 and doc_id is not null")

    # Equal sets: one class, represented by its smallest id.
    classes = cut(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").select("fp", "rep"), "classes")
    member = feats.join(classes, "fp", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    alone = feats.join(classes, "fp", "left").where("n > 0 and doc_id is not null and (rep is null or rep = doc_id)")
    reps = cut(alone.groupBy("doc_id").agg(F.min_by(F.struct("n", "sketch", "fp"), "fp").alias("own")).select("doc_id", "own.n", "own.sketch", "own.fp"), "reps")

    def sets_of(ids: DataFrame) -> DataFrame:
        # (Rows that repeat an id and a text are one.)
        wanted = base.join(ids, "doc_id").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "fp")
        return cut(wanted.mapInArrow(_sets(width), "doc_id long, shingles array<long>"), "sets")

    if exact:
        sets = sets_of(reps.select("doc_id", "fp"))
        prefix = cut(_full_lists(sets, percent), "prefix")
    else:
        prefix = cut(_prefix_lists(reps, percent, listed), "prefix")
        sets = sets_of(reps.join(prefix.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "fp"))
    first = cut(_hub_links(prefix, reps, sets, percent, sketch), "hublinks")
    stars = cut(connected_components(first), "stars")
    second, hot = _block_links(prefix, stars, reps, sets, percent, sketch, block, None if exact else long)
    edges = stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)
    if hot is not None:
        again = cut(_full_lists(sets.join(hot, "doc_id", "left_semi"), percent), "prefix")
        edges = edges.unionByName(_hub_links(again, reps, sets, percent, sketch))
        stars = cut(connected_components(edges), "stars")
        second, _ = _block_links(again, stars, reps, sets, percent, sketch, block, None)
        edges = stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)
    final = cut(connected_components(edges), "components")
    for table in (reps, prefix, sets, first):
        drop_scratch(docs.sparkSession, table)
    return (
        member.join(final, member["rep"] == final["node"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _rarest(entries: DataFrame, size: Column, needed: Column) -> DataFrame:
    """``(v, doc_id, n)`` of the ``needed`` rarest of each document's ``size`` values; those that it alone holds need no list."""
    counts = cut(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "frequency")
    return (
        entries.join(counts, "v")
        .groupBy("doc_id")
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("own"))
        .withColumn("slots", (needed - (size - F.size("own"))).cast("int"))
        .where("slots > 0")
        .select("doc_id", "n", F.explode(F.slice("own", F.lit(1), F.col("slots"))).alias("e"))
        .select(F.col("e.v").alias("v"), "doc_id", "n")
    )


def _full_lists(sets: DataFrame, percent: int) -> DataFrame:
    """``(v, doc_id, n)``: each document in the lists of so many of its rarest shingles that every partner is in one of them."""
    entries = sets.select("doc_id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("v"))
    return _rarest(entries, F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)


def _prefix_lists(reps: DataFrame, percent: int, listed: int) -> DataFrame:
    """``(v, doc_id, n)``: each document in the inverted lists of its rarest bottom values."""
    entries = reps.select("doc_id", "n", F.explode(F.slice("sketch", 1, listed)).alias("v"))
    floor = tail_floor(listed, percent / 100)
    whole = math.floor(listed * percent / 100)  # below it, both sets of a pair are wholly listed
    needed = F.when(F.col("n") < whole, F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).otherwise(listed - floor + 1)
    return _rarest(entries, F.least(F.col("n"), F.lit(listed)), needed)


def _hub_links(prefix: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, sketch: int) -> DataFrame:
    """Confirmed links of list members with two hubs of their list."""
    hubs = cut(
        prefix.groupBy("v")
        .agg(F.array_distinct(F.array(F.min(F.struct("doc_id", "n")), F.min_by(F.struct("doc_id", "n"), F.xxhash64("doc_id")))).alias("hubs"))
        .select("v", F.explode("hubs").alias("h"))
        .select("v", F.col("h.doc_id").alias("b"), F.col("h.n").alias("nb")),
        "hubs",
    )
    pairs = (
        prefix.join(hubs, "v")
        .where((F.col("doc_id") != F.col("b")) & (100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")))
        .select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"))
        .distinct()
    )
    sa = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ska"))
    sb = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("skb"))
    union = F.slice(F.array_sort(F.array_union("ska", "skb")), 1, sketch)
    shared = F.size(F.array_intersect(F.col("union"), F.array_intersect("ska", "skb")))
    p = percent / 100
    size = F.size("union")
    likely = pairs.join(sa, "a").join(sb, "b").withColumn("union", union).where(shared >= F.greatest(F.lit(1), F.floor(size * p - 6 * F.sqrt(size * (p * (1 - p)))))).select("a", "b", "na", "nb")
    full = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("fa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("fb")), "b")
    both = F.size(F.array_intersect("fa", "fb"))
    return full.withColumn("both", both).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _block_links(prefix: DataFrame, stars: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, sketch: int, block: int, long: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Links between different components of a list, block against block, and the ``doc_id`` of lists left out as too long.

    Lists with the same large component do their work together, once: its documents against
    all documents of other components that share a list with it, and those among themselves.
    """
    listed = prefix.join(stars.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("v", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))
    listed = cut(listed, "listed")
    per = listed.groupBy("v", "comp").agg(F.count("*").alias("c"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sig"))
    lists = per.groupBy("v").agg(F.sum("c").alias("size"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top"), F.sum("sig").alias("sig"))
    # A list of two was settled by its hub; of lists with the same members one is enough.
    lists = lists.where("comps > 1 and size > 2").groupBy("size", "sig").agg(F.min_by(F.struct("v", "top", "size"), "v").alias("l")).select("l.v", "l.top", (F.col("l.size") - F.col("l.top.c")).alias("rest"))
    lists = cut(lists.select("v", F.col("top.comp").alias("main"), (F.col("top.c") >= 3).alias("large"), "rest"), "lists")
    hot = None
    if long is not None:
        hot = cut(listed.join(lists.where(F.col("rest") >= long), "v").select("doc_id").distinct(), "hot")
        hot = None if hot.isEmpty() else hot
        lists = lists.where(F.col("rest") < long)
    placed = listed.join(lists, "v").select("large", F.when(F.col("large"), F.col("main")).otherwise(F.col("v")).alias("g"), "doc_id", "n", "comp", (F.col("comp") == F.col("main")).alias("is_main")).distinct()
    placed = cut(placed, "placed")
    mains, rests = F.count_if("is_main"), F.count_if(~F.col("is_main"))
    whole = mains + rests <= block  # one block, which meets itself
    blocks = placed.groupBy("large", "g").agg(whole.alias("whole"), F.when(whole, 0).otherwise(F.ceil(mains / block)).cast("int").alias("mb"), F.when(whole, 1).otherwise(F.ceil(rests / block)).cast("int").alias("rb"))
    blocks = cut(blocks, "blocks")
    at = F.when(F.col("whole"), 0).when(F.col("is_main"), F.pmod(F.xxhash64("doc_id"), F.col("mb"))).otherwise(F.col("mb") + F.pmod(F.xxhash64("doc_id"), F.col("rb"))).cast("int")
    others = F.sequence(F.when(F.col("is_main") & ~F.col("whole"), F.col("mb")).otherwise(0), F.col("mb") + F.col("rb") - 1)
    rows = (
        placed.join(blocks, ["large", "g"])
        .select("large", "g", "doc_id", "n", "comp", "whole", at.alias("at"), F.explode(others).alias("o"))
        .select("large", "g", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), "doc_id", "n", "comp", "whole", F.when(F.col("at") == F.col("o"), 2).when(F.col("at") < F.col("o"), 0).otherwise(1).alias("side"))
    )
    place = ["large", "g", "i", "j"]

    def near(table: pa.Table) -> pa.Table:
        return block_candidates(table, percent, sketch)

    def confirm(table: pa.Table) -> pa.Table:
        return block_links(table, percent, sketch)

    slim = rows.drop("whole")
    wide = rows.where(~F.col("whole")).drop("whole")
    likely = wide.join(reps.select("doc_id", "sketch"), "doc_id").select(*slim.columns, "sketch").groupBy(*place).applyInArrow(near, slim.schema)
    asked = cut(rows.where("whole").drop("whole").unionByName(likely), "likely")
    found = asked.join(sets, "doc_id").groupBy(*place).applyInArrow(confirm, "a long, b long").distinct()
    return cut(found, "blocklinks"), hot
