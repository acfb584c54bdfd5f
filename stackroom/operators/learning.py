"""The learning loop: corrections, rule promotion, overrides, enrichment, re-index queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.functions import paths as P

# Folder names that say nothing.
GENERIC_PARENTS = ("", "tmp", "private", "var", "users", "documents", "desktop", "downloads")
POSITIVE, NEGATIVE = ("addCategory",), ("removeCategory", "wrongCategory")
UNKNOWN = "Review/Unknown"


def normalize_pattern(pattern: Column, kind: Column) -> Column:
    """Lower case, single blanks; extensions lose outer dots."""
    compact = F.trim(F.regexp_replace(F.lower(pattern), r"\s+", " "))
    return F.when(kind == "extension", F.regexp_replace(compact, r"^\.+|\.+$", "")).otherwise(compact)


def derive_pattern(path: Column) -> Column:
    """Struct ``(pattern_type, pattern)``: the parent folder unless generic, else the extension, else null."""
    keyword = normalize_pattern(P.parent(path), F.lit("pathKeyword"))
    ext = normalize_pattern(P.extension(path), F.lit("extension"))
    ok = F.coalesce((F.length(keyword) >= 2) & ~keyword.isin(*GENERIC_PARENTS), F.lit(False))
    make = lambda k, p: F.struct(F.lit(k).alias("pattern_type"), p.alias("pattern"))
    return F.when(ok, make("pathKeyword", keyword)).when(ext != "", make("extension", ext))


def generation_key(*fields: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))


def pattern_matches(kind: Column, pattern: Column, path: Column, evidence: Column) -> Column:
    """Whether a rule's pattern fits a file; ``evidence`` is joined metadata text."""
    needle = F.regexp_replace(F.lower(pattern), r"^\.+|\.+$", "")
    ext = F.lower(P.extension(path))
    low = F.lower(pattern)
    by_name = F.contains(F.array_join(P.filename_tokens(path), " "), low)
    return F.coalesce((pattern != "") & F.when(kind == "extension", (needle != "") & F.endswith(ext, needle)).when(kind == "pathKeyword", F.contains(F.lower(path), low) | by_name).otherwise(F.contains(F.lower(evidence), low)), F.lit(False))


def promote_rules(corrections: DataFrame, *, threshold: int = 3, existing: DataFrame | None = None) -> DataFrame:
    """Rules ``(pattern_type, pattern, target_category, confidence, enabled, positives, negatives)``.

    A pattern with ``threshold`` distinct files and no negative evidence becomes a disabled rule
    of confidence 0.55. Negative evidence blocks promotion and takes 0.20 off an existing rule,
    which it also disables. Evidence without a generation does not count.
    """
    sound = corrections.where("generation is not null and pattern is not null").withColumn("pattern", normalize_pattern(F.col("pattern"), F.col("pattern_type"))).where("pattern <> '' and trim(category) <> ''")
    key = ["pattern_type", "pattern", "k"]
    votes = sound.withColumn("k", F.lower(F.trim("category"))).groupBy(*key).agg(
        F.count_distinct(F.when(F.col("action").isin(*POSITIVE), F.col("file_id"))).alias("positives"),
        F.count_if(F.col("action").isin(*NEGATIVE)).alias("negatives"),
        F.min(F.when(F.col("action").isin(*POSITIVE), F.trim("category"))).alias("named"),
    )
    if existing is None:
        fresh = votes.where((F.col("positives") >= threshold) & (F.col("negatives") == 0))
        return fresh.select("pattern_type", "pattern", F.col("named").alias("target_category"), F.lit(0.55).alias("confidence"), F.lit(False).alias("enabled"), "positives", "negatives")
    old = existing.withColumn("k", F.lower(F.trim("target_category"))).withColumn("pattern", F.lower("pattern")).select(*key, F.col("target_category").alias("old_name"), F.col("confidence").alias("old"), F.col("enabled").alias("was"))
    both = votes.join(old, key, "full")
    blocked = F.coalesce(F.col("negatives"), F.lit(0)) > 0
    kept = F.col("old").isNotNull() | (~blocked & (F.col("positives") >= threshold))
    confidence = F.when(F.col("old").isNull(), F.lit(0.55)).when(blocked, F.greatest(F.lit(0.0), F.col("old") - 0.20)).otherwise(F.col("old"))
    return both.where(kept).select("pattern_type", "pattern", F.coalesce("old_name", "named").alias("target_category"), F.round(confidence, 9).alias("confidence"), (~blocked & F.coalesce("was", F.lit(False))).alias("enabled"), F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("negatives", F.lit(0)).alias("negatives"))


def apply_overrides(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    """``classified`` (file_id, categories) after manual decisions in the order they were made.

    A removal takes a category away, an addition puts it at the end unless it is there; adding
    ``Review/Unknown`` is the end of it.
    """
    step = F.struct("updated", "category", "action")
    rows = overrides.where(F.col("action").isin("addCategory", "removeCategory")).groupBy("file_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    joined = classified.join(rows, "file_id", "left")

    def walk(own, r):
        unknown = F.array_contains(own, UNKNOWN) & (F.size(own) == 1)
        fresh = F.when(r["category"] == UNKNOWN, F.array(F.lit(UNKNOWN))).otherwise(F.array_distinct(F.array_append(own, r["category"])))
        without = F.filter(own, lambda x: x != r["category"])
        return F.when(unknown, own).when(r["action"] == "addCategory", fresh).otherwise(without)

    final = F.aggregate("steps", F.array_distinct("categories"), walk)
    return joined.withColumn("categories", F.when(F.col("steps").isNull(), F.array_distinct("categories")).otherwise(final)).drop("steps")


#: Rules that one broadcast may hold.
RULES_AT_ONCE = 10_000


def enrich(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``(file_id, categories, reasons)``: enabled rules add their categories and a reason each, in rule order.

    A pattern may lie anywhere in a path, so there is no key to join by: rules are broadcast, in
    parts of about ``RULES_AT_ONCE``, however many there are.
    """
    active = rules.where("enabled").select("id", "pattern_type", "pattern", "target_category")
    parts = max(1, -(-active.count() // RULES_AT_ONCE))
    slim = files.select("file_id", "path", F.coalesce("evidence", F.lit("")).alias("evidence"))
    test = pattern_matches(F.col("pattern_type"), F.col("pattern"), F.col("path"), F.col("evidence"))
    met = (slim.join(F.broadcast(active.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)), test) for k in range(parts))
    found = reduce(DataFrame.unionByName, met).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", "target_category"))).alias("hits"))
    joined = files.join(found, "file_id", "left")
    none = F.array().cast("array<struct<id:bigint,target_category:string>>")
    hits = F.coalesce("hits", none)
    return joined.select("file_id", F.array_distinct(F.concat("categories", F.transform(hits, lambda h: h["target_category"]))).alias("categories"), F.transform(hits, lambda h: F.concat(F.lit("learned:"), h["id"], F.lit(":"), h["target_category"])).alias("reasons"))


def all_rules(rules: DataFrame, enabled_only: bool = False) -> DataFrame:
    """Every rule, or the enabled ones, by id."""
    return (rules.where("enabled") if enabled_only else rules).orderBy("id")


def queued_files(queue: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, path, enqueued)`` of the re-index queue; entries of files that are gone drop out."""
    return queue.join(files.select("file_id", "path"), "file_id").select("file_id", "path", "enqueued")


def reindex_queue(files: DataFrame, rule: dict, now: float) -> DataFrame:
    """``(file_id, enqueued)`` of the files that a toggled rule could touch; metadata rules touch all."""
    live = files.where(F.col("status") != "unscoped")
    kind, pattern = F.lit(rule["pattern_type"]), F.lit(rule["pattern"].lower())
    needle = rule["pattern"].lower().strip(".")
    test = F.when(kind == "extension", F.endswith(F.lower(P.extension(F.col("path"))), F.lit(needle))).when(kind == "pathKeyword", F.contains(F.lower("path"), pattern)).otherwise(True)
    return live.where(test).select("file_id", F.lit(now).alias("enqueued"))


def toggle_rule(rules: DataFrame, files: DataFrame, rule: dict, enabled: bool, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, files with cleared processing versions, and the queue, of one toggle."""
    queue = reindex_queue(files, rule, now)
    flipped = rules.withColumn("enabled", F.when(F.col("id") == rule["id"], F.lit(enabled)).otherwise(F.col("enabled")))
    marked = files.join(queue.select("file_id", F.lit(True).alias("hit")), "file_id", "left")
    cleared = marked.withColumn("last_extractor", F.when(F.coalesce("hit", F.lit(False)), "").otherwise(F.col("last_extractor"))).drop("hit")
    return flipped, cleared, queue


def delete_rule(rules: DataFrame, files: DataFrame, rule: dict, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    flipped, cleared, queue = toggle_rule(rules, files, rule, False, now)
    return flipped.where(F.col("id") != rule["id"]), cleared, queue


def evidence_rows(files: DataFrame, decisions: DataFrame, provenance: str) -> DataFrame:
    """Rows of the evidence log for decisions ``(file_id, category, action, created)``: patterns come from paths."""
    known = decisions.join(files.select("file_id", "path", "size", "mtime"), "file_id").withColumn("p", derive_pattern(F.col("path")))
    rows = known.select("file_id", F.when(F.col("action") == "markUnknown", UNKNOWN).otherwise(F.trim("category")).alias("category"), "action", F.col("p.pattern_type").alias("pattern_type"), F.col("p.pattern").alias("pattern"), generation_key("file_id", "size", "mtime").alias("generation"), "created", F.lit(provenance).alias("provenance"))
    return rows.where("category <> ''")


def review_correction(catalog: dict[str, DataFrame], decisions: DataFrame, *, provenance: str = "review", threshold: int = 3) -> dict[str, DataFrame]:
    """The tables that a review's decisions change, as one set.

    ``catalog`` holds ``files``, ``corrections`` (the evidence log), ``category_overrides``,
    ``classifications``, ``learned_rules`` and ``audit``. Each decision becomes evidence, an
    override (the last one of a file and category counts; "unknown" adds the unknown category)
    and an audit row; the categories of its file follow, and evidence that suffices promotes rules.
    """
    rows = evidence_rows(catalog["files"], decisions, provenance)
    corrections = catalog["corrections"].unionByName(rows, allowMissingColumns=True)
    action = F.when(F.col("action") == "markUnknown", "addCategory").when(F.col("action") == "wrongCategory", "removeCategory").otherwise(F.col("action"))
    fresh = rows.groupBy("file_id", "category").agg(F.max_by(action, "created").alias("action"), F.max("created").alias("updated"))
    old = catalog["category_overrides"]
    overrides = old.join(fresh.select("file_id", "category"), ["file_id", "category"], "left_anti").unionByName(fresh, allowMissingColumns=True)
    touched = catalog["classifications"].join(rows.select("file_id").distinct(), "file_id", "left_semi")
    changed = apply_overrides(touched.select("file_id", "categories"), overrides)
    classifications = catalog["classifications"].join(changed.withColumnRenamed("categories", "__new"), "file_id", "left").withColumn("categories", F.coalesce("__new", "categories")).drop("__new").select(*catalog["classifications"].columns)
    promoted = promote_rules(corrections, threshold=threshold, existing=catalog["learned_rules"])
    audit = catalog["audit"].unionByName(rows.select("file_id", "action", "category", "created", "provenance"), allowMissingColumns=True)
    return {"corrections": corrections, "category_overrides": overrides, "classifications": classifications, "learned_rules": promoted, "audit": audit}
