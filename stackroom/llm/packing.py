"""Best-fit packing with conflicts.

Documents go to bins of fixed capacity, largest first. A bin carries two bitmaps: sources
that have filled their places in it, and duplicate clusters it holds. Bins are ordered by
residual; from the tightest that fits, the search walks to its successors until it finds a
compatible one, and opens a new bin if there is none.

The table is dealt into groups of about ``group_rows`` documents by a hash of the id and, for
equal rows, of the copy's number, so no key decides the size of a group; each group is packed
on its own in bounded memory. Longer documents are cut at the capacity: full pieces fill bins
of their own, the rest is packed. Ids travel as text, since pandas would make a column of
numbers with a null one of floating point.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.llm.copies import numbered
from stackroom.llm.mixing import WORD, word_count
from stackroom.session import cut

CAPACITY = 2048
GROUP_ROWS = 2048
PER_SOURCE = 4
#: A word with the blanks behind it; a text's first one also has those before it. All of them make up the text.
WORD_AND_BLANKS = rf"(?:^[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[int]:
    """A bin for each item ``(size, source, cluster)``, in the given order (largest first is best).

    ``source`` and ``cluster`` are small numbers (bit positions) or -1 for none.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    full_sources: list[int] = []
    clusters: list[int] = []
    held: list[dict[int, int]] = []
    out = []
    for size, source, cluster in items:
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster if cluster >= 0 else 0
        at = bisect.bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not (full_sources[b] & source_bit or clusters[b] & cluster_bit):
                break
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(held)
            full_sources.append(0)
            clusters.append(0)
            held.append({})
        clusters[b] |= cluster_bit
        if source >= 0:
            n = held[b][source] = held[b].get(source, 0) + 1
            if n >= per_source:
                full_sources[b] |= source_bit
        out.append(b)
        if residual > size:
            bisect.insort(order, (residual - size, b))
    return out


def _pack_group(pdf: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    # Shorter ids first: whole numbers come in their order.
    pdf = pdf.assign(__long=pdf["doc_id"].str.len()).sort_values(["__long", "doc_id", "size", "cluster", "source", "copy"], na_position="last", kind="mergesort").reset_index(drop=True)
    group = int(pdf["group"].iloc[0])
    prints = pdf["print"].tolist() if "print" in pdf else [None] * len(pdf)
    rows, items = [], []
    sources = {s: i for i, s in enumerate(pdf["source"].dropna().unique())}
    counts = pdf["cluster"].value_counts()
    clusters = {c: i for i, c in enumerate(counts[counts > 1].index)}  # a cluster met once conflicts with nothing
    bins = 0
    for doc, size, source, cluster, copy, mark in zip(pdf["doc_id"], pdf["size"], pdf["source"], pdf["cluster"], pdf["copy"], prints):
        whole, rest = divmod(int(size), capacity)
        for p in range(whole):
            rows.append((doc, copy, p, p * capacity, capacity, mark, bins))
            bins += 1
        if rest or not whole:
            items.append((rest, sources.get(source, -1), clusters.get(cluster, -1), doc, copy, whole, mark))
    items.sort(key=lambda x: -x[0])
    for (rest, _, _, doc, copy, whole, mark), b in zip(items, best_fit([x[:3] for x in items], capacity, per_source)):
        rows.append((doc, copy, whole, whole * capacity, rest, mark, bins + b))
    out = pd.DataFrame(rows, columns=["doc_id", "copy", "piece", "start_word", "n_words", "print", "bin"])
    out["bin_id"] = group * (1 << 24) + out.pop("bin")
    out = out.sort_values(["bin_id"], kind="mergesort")
    out["place"] = out.groupby("bin_id")["n_words"].cumsum() - out["n_words"]
    return out[["bin_id", "place", "doc_id", "copy", "piece", "start_word", "n_words", *(["print"] if "print" in pdf else [])]]


def _piece_texts(docs: DataFrame, capacity: int) -> DataFrame:
    """``(id, no_id, print, piece, text)``: each piece of each different text of an id, once."""
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_AND_BLANKS), F.lit(0))
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(capacity).cast("long"))
    long_text = F.transform(F.array(words), lambda w: F.transform(starts, lambda at: F.array_join(F.slice(w, (at + 1).cast("int"), F.lit(capacity)), "")))[0]
    pieces = docs.where("text is not null").select("id", "no_id", "print", F.posexplode(F.when(F.col("size") > capacity, long_text).otherwise(F.array("text"))).alias("piece", "text"))
    return pieces.groupBy("id", "no_id", "print", F.col("piece").cast("long").alias("piece")).agg(F.first("text").alias("text"))


def pack(docs: DataFrame, *, id_col: str = "doc_id", size_col: str | None = None, text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, per_source: int = PER_SOURCE, seed: int = 29, texts: bool = False) -> DataFrame:
    """Rows ``(bin_id, place, doc_id, copy, piece, start_word, n_words)``, one for each piece.

    ``place`` is the piece's first word within its bin. No bin exceeds ``capacity``, holds two
    documents of one cluster, or more than ``per_source`` of one source (pieces that fill a bin
    are alone in it). Without ``cluster_col`` the cluster is the exact text; without
    ``size_col`` the size is the number of words. Null texts, sizes and empty texts are one
    piece of no words, so every row appears. A null source or cluster conflicts with nothing.
    Equal rows are told apart by ``copy``. Ids keep their type; a null id is one like any
    other. Texts are read whole, however long. Other columns are ignored, whatever their
    names. Reruns agree: ties go by size, then id. An empty table gives no rows.

    With ``texts`` each row also has its piece's ``text``, blanks included: the pieces of a
    document make up its text, those of a bin in order of ``place`` the training sequence. Only
    ids travel through the packing; texts are joined to its result.
    """
    if texts and size_col:
        raise ValueError("texts are cut by words, so they need sizes in words")
    kind = docs.select(id_col).dtypes[0][1]
    size = F.coalesce(F.col(size_col), F.lit(0)).cast("long") if size_col else word_count(text_col)
    cluster = F.xxhash64(cluster_col) if cluster_col else F.when(F.length(text_col) > 0, F.xxhash64(text_col))
    if cluster_col:
        cluster = F.when(F.col(cluster_col).isNotNull(), cluster)
    groups = max(1, round(docs.count() / group_rows))
    mark = [F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).cast("string").alias("print")] if texts else []  # rows that repeat an id may differ in text
    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), size.alias("size"), F.col(source_col).cast("string").alias("source"), cluster.cast("string").alias("cluster"), *mark)
    dealt = numbered(slim, "sizes").withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "cluster", "copy"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(pdf, capacity, per_source)

    columns = "bin_id long, place long, doc_id string, copy long, piece long, start_word long, n_words long"
    own_id = lambda rows: rows.withColumn("doc_id", F.col("doc_id").cast(kind))
    if not texts:
        return own_id(dealt.groupBy("group").applyInPandas(run, columns))
    packed = cut(dealt.groupBy("group").applyInPandas(run, columns + ", print string"), "packed")
    number = lambda x: (F.coalesce(x, F.lit("")).alias("id"), x.isNull().alias("no_id"))
    wide = docs.select(*number(F.col(id_col).cast("string")), size.alias("size"), *mark, F.col(text_col).alias("text"))
    keyed = packed.select("*", *number(F.col("doc_id")))
    # Merged at any size: a hash join would hold texts in memory.
    joined = keyed.join(_piece_texts(wide, capacity).hint("merge"), ["id", "no_id", "print", "piece"], "left")
    return own_id(joined.select(*packed.drop("print").columns, "text"))
