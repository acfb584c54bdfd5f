"""Change detection, sweeps, backoff, and maintenance of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackroom.functions import paths as P

TOLERANCE = 0.001


def processing_version(*parts: str, rules: DataFrame | None = None) -> Column | str:
    """One key of everything that shapes a result: component ids, and a hash of the enabled rules."""
    key = "|".join(parts)
    if rules is None:
        return key
    rows = rules.where("enabled").select(F.concat_ws(":", "pattern_type", "pattern", "target_category").alias("r")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), ";"), 256).alias("h")).first()
    return f"{key}|rules:{rows['h'][:16]}"


def changed_expr(version: str) -> Column:
    """Whether a current row (size, mtime) must be processed again, given the stored one (s_*)."""
    return (
        F.col("s_status").isNull()
        | ~F.col("s_status").isin("indexed", "cloud-placeholder")
        | (F.coalesce("s_version", F.lit("")) != version)
        | (F.col("s_size") != F.col("size"))
        | (F.abs(F.col("s_mtime") - F.col("mtime")) > TOLERANCE)
    )


def needs_processing(current: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """Rows of ``current`` (path, size, mtime) that are new or changed."""
    old = stored.select("path", F.col("status").alias("s_status"), F.col("last_extractor").alias("s_version"), F.col("size").alias("s_size"), F.col("mtime").alias("s_mtime"))
    return current.join(old, "path", "left").where(changed_expr(version)).drop("s_status", "s_version", "s_size", "s_mtime")


def unseen(files: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """Catalogue rows under the root that a scan did not see."""
    return files.where(P.under(F.col("path"), root) & ~F.col("status").isin("missing", "unscoped")).join(seen.select("path"), "path", "left_anti")


def swept(files: DataFrame, seen: DataFrame, root: str, *, excluded: list[str] = (), unreadable: list[str] = ()) -> DataFrame:
    """Paths that a complete scan proves absent: not under excluded or unreadable prefixes or excluded directories."""
    path = F.col("path")
    gone = unseen(files, seen, root).where(~P.excluded_directory(path))
    for prefix in [*excluded, *unreadable]:
        gone = gone.where(~P.under(path, prefix))
    return gone.select("path")


def mark_missing(files: DataFrame, gone: DataFrame) -> DataFrame:
    marked = files.join(gone.select("path", F.lit(True).alias("gone")), "path", "left")
    return marked.withColumn("status", F.when(F.coalesce("gone", F.lit(False)), "missing").otherwise(F.col("status"))).drop("gone").select(*files.columns)


def missing_sweep(files: DataFrame, seen: DataFrame, root: str, *, excluded: list[str] = (), unreadable: list[str] = (), complete: bool = True) -> DataFrame:
    """``files`` with status ``missing`` where a complete scan proves absence; an incomplete scan changes nothing."""
    return mark_missing(files, swept(files, seen, root, excluded=excluded, unreadable=unreadable)) if complete else files


def set_scope(files: DataFrame, root: str, in_scope: bool) -> DataFrame:
    """Unscope a removed root's rows, or send them back to ``pending``."""
    hit = P.under(F.col("path"), root)
    status = F.when(hit & (F.col("status") == "unscoped"), "pending") if in_scope else F.when(hit, "unscoped")
    return files.withColumn("status", status.otherwise(F.col("status")))


def subtree_missing(files: DataFrame, root: str) -> DataFrame:
    return files.withColumn("status", F.when(P.under(F.col("path"), root) & (F.col("status") != "unscoped"), "missing").otherwise(F.col("status")))


def next_generation(meta: DataFrame, limit: int = 2**53) -> DataFrame:
    """The next scan generation; wraps to 1."""
    last = F.coalesce(F.max(F.when(F.col("k") == "root_scan_counter", F.col("v").cast("long"))), F.lit(0).cast("long"))
    return meta.agg(F.when(last >= limit, F.lit(1).cast("long")).otherwise(last + 1).alias("generation"))


def access_backoff(failures: DataFrame, *, keep: int | None = None) -> DataFrame:
    """``(prefix, reason, attempts, last_attempt, retry_after)`` from failures ``(prefix, reason, now)``.

    Attempts stop counting at 30; the delay doubles from 30 s to at most 30 min. ``keep`` is the
    number of newest rows that stay.
    """
    rows = failures.groupBy("prefix").agg(F.max_by("reason", "now").alias("reason"), F.least(F.count("*"), F.lit(30)).cast("int").alias("attempts"), F.max("now").alias("last_attempt"))
    delay = F.least(F.lit(1800.0), 30.0 * F.pow(F.lit(2.0), F.least(F.col("attempts") - 1, F.lit(10))))
    out = rows.withColumn("retry_after", F.col("last_attempt") + delay)
    return out if keep is None else keep_newest(out, keep, ["last_attempt", "prefix"])


def keep_newest(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest ``n`` rows by the first column descending: a top-k, never a full sort."""
    return rows.orderBy(F.desc(order[0]), *order[1:]).limit(n)


def active_backoff(backoff: DataFrame, now: float) -> DataFrame:
    return backoff.where(F.col("retry_after") > now).orderBy("retry_after", "prefix")


def clear_backoff(backoff: DataFrame, root: str) -> DataFrame:
    return backoff.where(~P.under(F.col("prefix"), root))


def resolve_review(inbox: DataFrame, file_ids: DataFrame, now: float) -> DataFrame:
    marked = inbox.join(file_ids.select("file_id", F.lit(True).alias("done")).distinct(), "file_id", "left")
    done = F.coalesce("done", F.lit(False))
    return marked.withColumn("state", F.when(done, "resolved").otherwise(F.col("state"))).withColumn("updated", F.when(done, F.lit(now)).otherwise(F.col("updated"))).drop("done")


def dequeue(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("file_id"), "file_id", "left_anti")


def log_errors(log: DataFrame, failures: DataFrame, now: float) -> DataFrame:
    return log.unionByName(failures.select("opaque_ref", "stage", F.substring("message", 1, 200).alias("message"), F.lit(now).alias("created")))


def classify_deltas(outcomes: DataFrame) -> DataFrame:
    """What to do with a path after looking at it: ``missing``, ``backoff``, ``scan`` or ``index``."""
    action = F.when(F.col("error") == "ENOENT", "missing").when(F.col("error").isin("EACCES", "EPERM"), "backoff").when(F.col("is_directory"), "scan").otherwise("index")
    return outcomes.withColumn("action", action)


def reclassify(stored: DataFrame, overrides: DataFrame, rules: DataFrame) -> DataFrame:
    """Classification-only run: base categories, then rules, then manual overrides, which have the last word.

    A result that breaks the contract is left out, so that what is stored stays.
    """
    from stackroom.functions.labels import contract_ok
    from stackroom.operators.learning import apply_overrides, enrich

    enriched = enrich(stored.withColumn("categories", F.col("base_categories")), rules)
    out = apply_overrides(enriched, overrides)
    confidence = stored.select("file_id", (F.col("confidence") if "confidence" in stored.columns else F.lit(0.55)).alias("__confidence"))
    checked = out.join(confidence, "file_id")
    return checked.where(contract_ok(F.col("file_id"), F.col("categories"), F.lit(""), F.col("reasons"), F.col("__confidence"))).drop("__confidence")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
