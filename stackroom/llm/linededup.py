"""Near-duplicate lines by a segment-partition edit join, JVM-side only.

Equal lines become one class first. Two lines within ``threshold`` edits share at least one
of the shorter one's ``threshold + 1`` segments, at nearly the same place. Every class
enters an index of its segments, keyed by length, segment number and content; it probes the
index for each length up to ``threshold`` shorter with the few substrings whose place agrees
with the edits that may lie left and right of the segment (multi-match-aware windows of the
pass-join method). Segments are cut from the UTF-32 form, where a place is an offset.

Keys that many lines share would give as many candidates as there are pairs of those lines.
Two remedies, neither of which loses a pair:

* A crowded key (a licence header, a form's first words) is refined. Its lines' common start
  and end are left aside, and what lies between is cut into ``PARTS`` finer segments, of which
  two lines within ``threshold`` edits share all but ``threshold``. A line is indexed under its
  ``threshold + 1`` rarest ones, so any partner holds one of them, and is probed with the
  windows of all of them. Lines of a crowd that differ in a few characters only are left
  under their key.
* Rows of hot keys carry their line, and the join itself drops pairs that Spark's own
  thresholded distance puts too far apart; the bit-parallel distance below sees the others.

Candidates lose their common prefix and suffix; what is left must agree on one of
``threshold - 1`` inner pieces, and is verified by a banded bit-parallel edit distance: each
column of the dynamic programme is a word of 2 * threshold + 1 bits that slides along the
diagonal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.llm.mixing import WORD
from stackroom.session import bloom_joins, cut, drop_scratch, release

THRESHOLD = 2
MIN_CHARS = 24
#: A key of so many lines or more is hot.
HOT = 16
#: A key of so many lines or more is refined into segments by at most ``PARTS`` parts.
CROWD = 4096
PARTS = 6


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _segment(n: Column, i: Column | int, parts: Column | int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of ``parts`` of a line of ``n`` characters."""
    i = F.lit(i) if isinstance(i, int) else i
    start = F.floor(n * i / parts).cast("int")
    return start, F.floor(n * (i + 1) / parts).cast("int") - start


def _key(n: Column, i: Column, content: Column) -> Column:
    return F.xxhash64(n.cast("int"), i, content)


def _content(wide: Column, start: Column, size: Column) -> Column:
    return F.substring(wide, start * 4 + 1, size * 4)


# One exploded row for each segment or window, with one key expression: a wide array of key
# expressions would be a method too long for the JIT compiler.


def index_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """``lines`` (n, wide = UTF-32 form, ...) with a column ``key`` for each of the line's segments."""
    rows = lines.withColumn("i", F.explode(F.array(*(F.lit(i) for i in range(threshold + 1)))))
    start, size = _segment(F.col("n"), F.col("i"), threshold + 1)
    return rows.withColumn("key", _key(F.col("n"), F.col("i"), _content(F.col("wide"), start, size))).drop("i", "wide", "n")


def windows(threshold: int) -> list[tuple[int, int, int]]:
    """``(shorter, segment, shift)``: where a line may hold a segment of one that is ``shorter`` characters less."""
    out = []
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            low, high = max(-i, less - (threshold - i)), min(i, less + (threshold - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def probe_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """``lines`` with ``key`` and ``shorter`` for each window that a segment of an indexed line may fill."""
    places = F.array(*(F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in windows(threshold)))
    rows = lines.withColumn("w", F.explode(places))
    n, target, i = F.col("n"), F.col("n") - F.col("w.less"), F.col("w.i")
    start, size = _segment(target, i, threshold + 1)
    at = start + F.col("w.shift")
    fits = (target >= threshold + 1) & (at >= 0) & (at + size <= n)
    return rows.where(fits).withColumn("key", _key(target, i, _content(F.col("wide"), at, size))).withColumn("shorter", F.col("w.less")).drop("w", "wide", "n")


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that ``a`` and ``b`` share at the start, by descending powers of two."""
    steps = F.array(*(F.lit(1 << k) for k in range(24, -1, -1)))
    least = F.least(F.length(a), F.length(b))
    return F.aggregate(steps, F.lit(0), lambda at, x: F.when((at + x <= least) & (a.substr(at + 1, x) == b.substr(at + 1, x)), at + x).otherwise(at))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of ``a`` and ``b`` if at most ``threshold``, else a larger number.

    Bit-parallel over the diagonal band (Hyyro's banded form of Myers' algorithm): bit d of a
    word stands for row j + d - threshold of column j. VP and VN hold the vertical steps of
    the column, and D0 the diagonals without cost. The score follows the band's last diagonal
    down to the last row and then moves along that row.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    m, n = F.length(a), F.length(b)
    top = F.lit(1 << (width - 1)).cast("long")

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    inside = F.lit(mask).cast("long")

    def at(j, c):
        # Matches of b's j-th character with a's characters in the band.
        row = lambda d: j + (d - threshold)
        bits = (F.when((row(d) >= 1) & (row(d) <= m) & (a.substr(F.greatest(row(d), F.lit(1)), F.lit(1)) == c), F.lit(1 << d).cast("long")).otherwise(zero) for d in range(width))
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    def bit(word, place):
        return F.call_function("shiftrightunsigned", word, F.greatest(place, F.lit(0))).bitwiseAND(one).cast("int")

    def step(s, j):
        def column(eq):
            return _let(((eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(eq).bitwiseOR(s["vn"]).bitwiseAND(inside), horizontal)

        def horizontal(d0):
            hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"]))).bitwiseAND(inside)
            return _let(F.struct(d0.alias("d0"), hp.alias("hp"), s["vp"].bitwiseAND(d0).alias("hn"), F.shiftrightunsigned(d0, 1).alias("x")), moved)

        def moved(w):
            # While the band's last row is above the last row of a, follow the diagonal; then along the row.
            diagonal = s["score"] + F.when(w["d0"].bitwiseAND(top) == 0, 1).otherwise(0)
            along = s["score"] + bit(w["hp"], m - j + threshold) - bit(w["hn"], m - j + threshold)
            vp = w["hn"].bitwiseOR(F.bitwise_not(w["x"].bitwiseOR(w["hp"])).bitwiseAND(inside))
            return F.struct(vp.alias("vp"), w["hp"].bitwiseAND(w["x"]).alias("vn"), F.when(j + threshold <= m, diagonal).otherwise(along).alias("score"))

        return _let(_let(b.substr(j, F.lit(1)), lambda c: at(j, c)), column)

    raise_ = F.lit(threshold + 1)
    first = F.struct(F.lit(mask ^ ((1 << threshold) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(threshold), m).alias("score"))
    walked = F.aggregate(F.sequence(F.lit(1), n), first, step, lambda s: s["score"])
    return F.when(F.abs(m - n) > threshold, raise_).when(F.least(m, n) == 0, F.greatest(m, n)).otherwise(walked)


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two cores (no common first or last character) are within ``threshold`` edits."""
    if threshold >= 2:
        # Both ends cost an edit each, so threshold - 1 inner pieces of a hold an intact one.
        inner = F.greatest(F.length(a) - 2, F.lit(0))
        parts = threshold - 1
        whole = []
        for i in range(parts):
            start, size = _segment(inner, i, parts)
            whole.append(F.contains(b, a.substr(start + 2, size)))
        likely = (inner == 0) | reduce(lambda x, y: x | y, whole)
    else:
        likely = F.greatest(F.length(a), F.length(b)) <= threshold
    return F.when((F.abs(F.length(a) - F.length(b)) <= threshold) & likely, banded_distance(a, b, threshold) <= threshold).otherwise(False)


def line_classes(docs: DataFrame, threshold: int, min_chars: int, short: bool = True) -> tuple[DataFrame, DataFrame]:
    """Occurrences ``(doc_id, no, h, g)`` and classes ``(h, g, n, line, doc, no, occurrences)``.

    The identity of a line is two hashes of 96 bits in all; ``doc`` and ``no`` are its first
    occurrence. Lines under ``min_chars`` have a class if ``short`` and if they hold a word.
    """
    wanted = F.length("line") >= max(min_chars, threshold + 1)
    if short:
        wanted = wanted | F.rlike("line", F.lit(WORD))
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("no", "line")).where(wanted)
    keyed = lines.select("doc_id", "no", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), "line")
    classes = keyed.groupBy("h", "g").agg(F.first("line").alias("line"), F.min(F.struct("doc_id", "no")).alias("first"), F.count("*").alias("occurrences"))
    return keyed.drop("line"), cut(classes.select("h", "g", F.length("line").alias("n"), "line", F.col("first.doc_id").alias("doc"), F.col("first.no").alias("no"), "occurrences"), "lines")


def _hot(index: DataFrame) -> DataFrame:
    return index.groupBy("key").agg(F.count("*").alias("lines")).where(F.col("lines") >= HOT)


def _crowds(index: DataFrame, hot: DataFrame, threshold: int) -> DataFrame:
    """``(key, size, first, width, parts)`` of crowded keys: the length of their lines and the part in which those differ."""
    rows = index.join(hot.where(F.col("lines") >= CROWD).select("key"), "key").withColumn("back", F.reverse("line"))
    ends = rows.groupBy("key").agg(F.min(F.length("line")).alias("size"), F.max(F.length("line")).alias("most"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("line", "back") for f in (F.min, F.max)))
    ends = ends.where("size = most").withColumn("first", common_prefix(F.col("min_line"), F.col("max_line")))
    ends = ends.withColumn("width", F.greatest(F.col("size") - F.col("first") - common_prefix(F.col("min_back"), F.col("max_back")), F.lit(0)))
    ends = ends.withColumn("parts", F.least(F.lit(PARTS), F.floor(F.col("width") / 2)).cast("int"))
    return ends.where(F.col("parts") >= threshold + 2).select("key", "size", "first", "width", "parts")


def _finer(rows: DataFrame, threshold: int, probing: bool) -> DataFrame:
    """Rows of crowded keys with the key of a finer segment (``probing``: of a window that one may fill)."""
    low = F.floor((threshold - F.col("shorter")) / 2).cast("int") if probing else F.lit(0)
    parts = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = parts.withColumn("shift", F.explode(F.sequence(-low, F.col("shorter") + low))) if probing else parts.withColumn("shift", F.lit(0))
    start, size = _segment(F.col("width"), F.col("j"), F.col("parts"))
    at = F.col("first") + start + F.col("shift")
    inside = parts.where((at >= 0) & (at + size <= F.length("line")))
    return inside.withColumn("fine", F.xxhash64("key", "j", _content(F.encode("line", "UTF-32"), at, size)))


def _refine(index: DataFrame, probe: DataFrame, crowds: DataFrame, lines: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """``index`` and ``probe`` with the rows of crowded keys under finer ones."""
    fine = cut(_finer(index.join(crowds, "key"), threshold, False).select("h", "key", "fine"), "fine")
    rare = fine.join(fine.groupBy("fine").agg(F.count("*").alias("lines")), "fine").groupBy("h", "key").agg(F.slice(F.array_sort(F.collect_list(F.struct("lines", "fine"))), 1, threshold + 1).alias("own"))
    chosen = cut(rare.select("h", F.explode("own.fine").alias("key"), F.lit(1).alias("one")), "chosen")
    fits = F.col("size") == F.length("line") - F.col("shorter")
    wide = probe.join(crowds, "key", "left")
    asked = _finer(wide.where(fits), threshold, True).select("h2", F.col("fine").alias("key"), "shorter")
    # Most windows meet no segment: a Bloom filter drops them before the shuffle.
    with bloom_joins(index.sparkSession):
        asked = cut(asked.join(chosen.where("one = 1").select("key").distinct(), "key").distinct(), "asked")
    chosen = chosen.drop("one")
    index_rows = index.join(crowds.select("key"), "key", "left_anti").select("h", "line", "key").unionByName(chosen.join(lines, "h").select("h", "line", "key"))
    probe_rows = wide.where(F.coalesce(~fits, F.lit(True))).select("h2", "line", "key", "shorter").unionByName(asked.join(lines.withColumnRenamed("h", "h2"), "h2").select("h2", "line", "key", "shorter"))
    return index_rows, probe_rows


def edit_links(classes: DataFrame, threshold: int) -> DataFrame:
    """Links ``(h, g, h2, g2, doc2, no2)`` between different classes within ``threshold`` edits, both ways."""
    base = classes.select("h", "n", "line", F.encode("line", "UTF-32").alias("wide"))
    index = index_keys(base, threshold)
    probe = probe_keys(base.withColumnRenamed("h", "h2"), threshold)
    hot = cut(_hot(index), "hot")
    crowds = cut(_crowds(index, hot, threshold), "crowds")
    if not crowds.isEmpty():
        index, probe = _refine(index, probe, crowds, classes.select("h", "line"), threshold)
        hot = cut(_hot(index), "hot")
    hot = hot.select("key", F.lit(True).alias("hot"))
    marked = lambda rows, name: rows.join(hot, "key", "left").withColumn(name, F.when(F.col("hot"), F.col("line"))).drop("hot", "line")
    different = (F.col("h") < F.col("h2")) | ((F.col("h") != F.col("h2")) & (F.col("shorter") > 0))
    near = F.col("ta").isNull() | (F.levenshtein("ta", "tb", threshold) >= 0)
    met = marked(index, "ta").join(marked(probe, "tb"), "key").where(different & near)
    pairs = cut(met.select(F.least("h", "h2").alias("ha"), F.greatest("h", "h2").alias("hb")).distinct(), "pairs")
    release(classes.sparkSession)
    # Few lines are candidates: only their texts are shuffled. ("one" gives the planner a filter to see.)
    ids = cut(pairs.select(F.explode(F.array("ha", "hb")).alias("h")).distinct().withColumn("one", F.lit(1)), "candidates")
    with bloom_joins(classes.sparkSession):
        texts = cut(classes.join(ids.where("one = 1").select("h"), "h").select("h", "g", "n", "line", "doc", "no"), "texts")
    side = lambda s: texts.select(*(F.col(c).alias(c + s) for c in texts.columns))
    both = pairs.join(side("a"), "ha").join(side("b"), "hb")
    cores = both.withColumn("pre", common_prefix(F.col("linea"), F.col("lineb")))
    cores = cores.withColumn("ra", F.reverse(F.col("linea").substr(F.col("pre") + 1, F.col("na")))).withColumn("rb", F.reverse(F.col("lineb").substr(F.col("pre") + 1, F.col("nb"))))
    cores = cores.withColumn("suf", common_prefix(F.col("ra"), F.col("rb")))
    cores = cores.withColumn("ca", F.col("ra").substr(F.col("suf") + 1, F.col("na"))).withColumn("cb", F.col("rb").substr(F.col("suf") + 1, F.col("nb")))
    # Written out, so that the test below reads the cores instead of deriving them for each use.
    cores = cut(cores.select("ha", "ga", "doca", "noa", "hb", "gb", "docb", "nob", "ca", "cb"), "cores")
    true = cut(cores.where(within(F.col("ca"), F.col("cb"), threshold)).drop("ca", "cb"), "links")
    one = lambda a, b: true.select(F.col(f"h{a}").alias("h"), F.col(f"g{a}").alias("g"), F.col(f"h{b}").alias("h2"), F.col(f"g{b}").alias("g2"), F.col(f"doc{b}").alias("doc2"), F.col(f"no{b}").alias("no2"))
    return one("a", "b").unionByName(one("b", "a"))


def removals(docs: DataFrame, *, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short: bool = True) -> DataFrame:
    """``(doc_id, dropped, n_exact, n_links)`` for documents that lose a line or hold a linked one.

    ``dropped`` are numbers of lines to which an equal or near line occurs earlier, by (doc_id,
    line number); ``n_exact`` of them have an equal one, and ``n_links`` counts the links of the
    document's lines to other lines.
    """
    occurrences, classes = line_classes(docs, threshold, min_chars, short)
    release(docs.sparkSession)
    links = edit_links(classes.where(F.col("n") >= max(min_chars, threshold + 1)) if short else classes, threshold).groupBy("h", "g").agg(F.count("*").alias("links"), F.min(F.struct(F.col("doc2").alias("doc"), F.col("no2").alias("no"))).alias("other"))
    info = classes.select("h", "g", F.struct("doc", "no").alias("own"), "occurrences").join(links, ["h", "g"], "left").where("occurrences > 1 or links > 0")
    release(docs.sparkSession)
    info = cut(info.select("h", "g", "own", F.least("own", "other").alias("first"), F.coalesce("links", F.lit(0)).alias("links")), "repeats")
    found = occurrences.join(info, ["h", "g"]).withColumn("me", F.struct(F.col("doc_id").alias("doc"), "no"))
    out = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("me") > F.col("first"), F.col("no")))).alias("dropped"), F.count_if(F.col("me") > F.col("own")).alias("n_exact"), F.sum("links").alias("n_links"))
    out = cut(out, "dropped")
    drop_scratch(docs.sparkSession, classes)
    return out


def _kept_lines(dropped: str) -> Column:
    return F.filter(split_lines(F.col("text")), lambda line, i: ~F.array_contains(dropped, i))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, short: bool = True) -> DataFrame:
    """``docs`` without their near-duplicate lines, plus ``(n_lines, n_dropped, n_exact, n_links, dropped)``.

    A line, a piece between newlines of at least ``min_chars`` characters, goes if a line of at
    most ``threshold`` edits away, itself gone or not, occurs in a smaller (doc_id, line number).
    Shorter lines go if they hold a word and the very same line occurs earlier (without
    ``short`` they stay); they have no links, as so few characters are near by chance. Blank
    lines stay. Texts are read whole, however long. Null texts stay null (no lines), empty
    ones empty. A null id neither removes nor loses lines. Rows that repeat an id count
    as one document and do not remove each other's lines. Other columns pass through, but a
    column named like one of the five new ones is replaced. An empty table stays empty.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone = removals(base, threshold=threshold, min_chars=min_chars, short=short).withColumnRenamed("doc_id", "__id")
    new = ["n_lines", "n_dropped", "n_exact", "n_links", "dropped"]
    kept = docs.drop(*new)
    names = [c for c in kept.columns]
    wide = kept.withColumnRenamed(text_col, "text") if text_col != "text" else kept
    # Merged at any size: whether the ids would fit a broadcast depends on the input, what is shuffled should not.
    joined = wide.join(gone.hint("merge"), wide[id_col] == gone["__id"], "left").drop("__id")
    none = F.array().cast("array<int>")
    out = joined.withColumn("dropped", F.coalesce("dropped", none))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(split_lines(F.col("text")))).cast("long"))
    out = out.withColumn("text", F.when(F.size("dropped") > 0, F.array_join(_kept_lines("dropped"), "\n")).otherwise(F.col("text")))
    out = out.withColumn("n_dropped", F.size("dropped").cast("long")).withColumn("n_exact", F.coalesce("n_exact", F.lit(0)).cast("long")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    out = out.withColumnRenamed("text", text_col) if text_col != "text" else out
    return out.select(*names, *new)
