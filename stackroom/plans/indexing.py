"""The write path: scan, gate, extract, classify, sweep and summarise as one set of table changes.

The gate sees paths, sizes and times; contents are read only for rows that pass it, and only
what is derived from them (digest, text sample) is kept or shuffled. The result is a dictionary
of changes; :func:`stackroom.sources.tables.commit` writes their rows at once, not whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions import labels as L
from stackroom.functions import paths as P
from stackroom.functions import text as T
from stackroom.operators import incremental as I
from stackroom.operators import learning as R
from stackroom.operators import rollups as U
from stackroom.schemas import conform
from stackroom.session import bloom_joins, cut
from stackroom.sources import tables as ST
from stackroom.sources.files import text_sample

EXTRACTED = 200_000


def index_changes(scanned: DataFrame, catalog: dict[str, DataFrame], root: str, *, version: str = "v1", now: float = 0.0, complete: bool = True, excluded: list[str] = (), unreadable: list[str] = (), sweep: bool = True) -> dict[str, ST.Change]:
    """What a scan ``(path, size, mtime, content)`` of ``root`` changes in a catalogue's tables.

    ``catalog`` holds ``files``, ``text_content``, ``classifications``, ``exact_hashes``,
    ``review_inbox``, ``learned_rules`` and ``category_overrides`` (empty ones will do). An
    incomplete scan sweeps nothing, and a scan without news changes no table.
    """
    slim = scanned.select("path", "size", "mtime")
    todo = cut(I.needs_processing(slim, catalog["files"], version).withColumn("one", F.lit(1)), "todo")
    out = {} if todo.isEmpty() else _indexed(scanned, todo, catalog, version, now)
    if sweep and complete:
        gone = _gone(catalog["files"], slim, root, excluded, unreadable)
        if not gone.isEmpty():
            rows = gone if "files" not in out else out["files"].rows.unionByName(gone, allowMissingColumns=True)
            out["files"] = ST.Change(rows)
    return out


def _gone(files: DataFrame, scanned: DataFrame, root: str, excluded: list[str], unreadable: list[str]) -> DataFrame:
    """Rows of files that a complete scan did not find, as missing ones."""
    paths = I.swept(files, scanned.select("path"), root, excluded=list(excluded), unreadable=list(unreadable))
    return cut(files.join(paths, "path", "left_semi").withColumn("status", F.lit("missing")), "gone")


def index_root(scanned: DataFrame, catalog: dict[str, DataFrame], root: str, **options) -> dict[str, DataFrame]:
    """The tables that :func:`index_changes` changes, as they are afterwards."""
    return {name: change.over(catalog[name]) for name, change in index_changes(scanned, catalog, root, **options).items()}


def _indexed(scanned: DataFrame, todo: DataFrame, catalog: dict[str, DataFrame], version: str, now: float) -> dict[str, ST.Change]:
    """The changes of the rows that passed the gate, extracted and classified."""
    with bloom_joins(scanned.sparkSession):
        body = F.when(F.col("kind") == "text", text_sample(F.col("content")))
        read = scanned.select("path", "content").join(todo.where("one = 1").drop("one"), "path").withColumn("kind", P.kind(F.col("path")))
        read = cut(read.select(P.opaque_id(F.col("path")).alias("file_id"), "path", "size", "mtime", "kind", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.substring(body, 1, EXTRACTED).alias("body")), "read")

    seen_before = catalog["files"].select("file_id", "first_seen")
    entry = read.join(seen_before, "file_id", "left").select("file_id", "path", "size", "mtime", "kind", F.lit(False).alias("is_symlink"), F.lit("indexed").alias("status"), F.coalesce("first_seen", F.lit(now)).alias("first_seen"), F.lit(now).alias("last_indexed"), F.lit(version).alias("last_extractor"))

    texts = read.select("file_id", "body", F.lit("text").alias("extractor"), F.lit(now).alias("created")).where("trim(body) <> ''")
    hashes = read.select("file_id", F.col("bytes").alias("size"), "sha256")
    k = L.classify(F.col("path"), F.col("kind"), F.col("body"), size_class=P.size_class(F.col("size")))
    first = read.select("file_id", "path", k.alias("k"), F.concat_ws(" ", "kind", P.size_class(F.col("size"))).alias("evidence")).select("file_id", "path", "evidence", F.col("k.categories").alias("base_categories"), F.col("k.confidence").alias("confidence"), F.col("k.reasons").alias("base_reasons"))
    learned = R.enrich(first.withColumn("categories", F.col("base_categories")), catalog["learned_rules"])
    final = R.apply_overrides(learned, catalog["category_overrides"])
    rows = first.drop("path", "evidence").join(final, "file_id").select("file_id", "categories", "base_categories", F.lit("").alias("description"), "confidence", F.slice(F.concat("base_reasons", "reasons"), 1, L.MAX_REASONS).alias("reason_codes"), F.lit("rules").alias("classifier"), F.lit(now).alias("created"))
    sound = rows.where(L.contract_ok(F.col("file_id"), F.col("categories"), F.col("description"), F.col("reason_codes"), F.col("confidence")))
    sound = cut(conform(sound, "classifications"), "classified")
    fresh = U.review_inbox(sound, now).withColumn("created", F.lit(now))
    return {
        "files": ST.Change(conform(entry, "files")),
        "text_content": ST.Change(conform(texts, "text_content"), touched=read),
        "exact_hashes": ST.Change(conform(hashes, "exact_hashes")),
        "classifications": ST.Change(sound),
        "review_inbox": ST.Change(conform(fresh, "review_inbox")),
    }


CATALOG = ("files", "text_content", "classifications", "exact_hashes", "review_inbox", "learned_rules", "category_overrides")
RUN, PAUSE, CANCEL = "run", "pause", "cancel"


def catalog_of(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The tables of a store that indexing reads."""
    return {name: ST.load(spark, store, name) for name in CATALOG}


def scan_session(scanned: DataFrame, store: str, root: str, *, batches: int = 1, control: Callable[[int], str] | None = None, version: str = "v1", now: float = 0.0, available: bool = True, complete: bool = True, excluded: list[str] = (), unreadable: list[str] = ()) -> DataFrame:
    """Index a scan of ``root`` into a store, batch by batch; returns one row about the session.

    ``(generation, root, completion, scanned, processed, missing, batches)``. Paths are dealt to
    ``batches`` by hash and each batch is one commit, so a crash, a pause or a cancellation loses
    at most the batch at hand; the next session's gate passes over what is done.
    ``control(batches done)`` says before each batch whether to ``run``, ``pause`` or ``cancel``.
    Only a session that ran through a complete scan looks for missing files. The completion is
    ``completed``, ``limited`` (an incomplete scan), ``paused``, ``cancelled`` or
    ``rootUnavailable``. Generations count up; each session's row is kept in the store's ``scan_sessions``.
    """
    spark = scanned.sparkSession
    meta = ST.load(spark, store, "meta")
    generation = I.next_generation(meta).first()["generation"]
    done, state = 0, RUN
    for b in range(batches if available else 0):
        state = control(b) if control else RUN
        if state != RUN:
            break
        part = scanned if batches == 1 else scanned.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == b)
        changed = index_changes(part, catalog_of(spark, store), root, version=version, now=now, sweep=False)
        if changed:
            ST.commit(spark, store, changed)
        done += 1
    files = ST.load(spark, store, "files")
    completion = "rootUnavailable" if not available else "paused" if state == PAUSE else "cancelled" if state != RUN else "completed" if complete else "limited"
    missing, tables = 0, {}
    if completion == "completed":
        gone = _gone(files, scanned, root, excluded, unreadable)
        missing = gone.count()
        if missing:
            tables["files"] = ST.Change(gone)
    own = files.where(P.under(F.col("path"), root) & (F.col("last_indexed") == now)).select("path").join(scanned.select("path"), "path", "left_semi")
    counts = scanned.agg(F.count("*").alias("scanned")).crossJoin(own.agg(F.count("*").alias("processed")))  # one row each
    row = cut(counts.select(F.lit(generation).alias("generation"), F.lit(root).alias("root"), F.lit(completion).alias("completion"), "scanned", "processed", F.lit(missing).cast("long").alias("missing"), F.lit(done).alias("batches")), "session")
    known = ST.manifest(spark, store)[1]
    tables["scan_sessions"] = ST.load(spark, store, "scan_sessions").unionByName(row) if "scan_sessions" in known else row
    tables["meta"] = ST.upsert(meta, spark.createDataFrame([("root_scan_counter", str(generation))], "k string, v string"), ["k"])
    ST.commit(spark, store, tables)
    return row


def searchable_chunks(tables: dict[str, DataFrame]) -> DataFrame:
    """``(file_id, chunk_index, text)`` to embed: the compacted text of every indexed file, chunks only where there are several."""
    rows = tables["text_content"].join(tables["files"].where("status = 'indexed'").select("file_id", "path"), "file_id")
    k = rows.select("file_id", T.compacted(F.col("path"), F.col("body")).alias("k")).where("k.strategy <> 'skip'")
    parts = F.when(F.size("k.chunks") > 1, F.concat(F.array("k.primary"), "k.chunks")).otherwise(F.array("k.primary"))
    return k.select("file_id", F.posexplode(parts).alias("chunk_index", "text"))
