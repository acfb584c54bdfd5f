"""Smart groups: a bounded, predictable selection of categories, composites and families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackroom.functions import taxonomy as X
from stackroom.functions.paths import category_path
from stackroom.operators.similarity import NEAR
from stackroom.session import cut, drop_scratch


def members_by_category(memberships: DataFrame) -> DataFrame:
    """``(path, file_id)``, paths normalised, distinct."""
    return memberships.select(category_path(F.col("category_path")).alias("path"), "file_id").where("path <> '' and file_id <> ''").distinct()


def composite_members(pairs: DataFrame) -> DataFrame:
    """``(group_id, file_id)`` of the broad download and media groups."""
    which = reduce(lambda out, c: out.when(F.col("path").isin(*c[1][0]), c[0]), X.COMPOSITES.items(), F.when(F.lit(False), ""))
    return pairs.select(which.alias("group_id"), "file_id").where("group_id is not null").distinct()


def _rows(df: DataFrame) -> DataFrame:
    return df.select("group_id", "title", "subtitle", "kind", "priority", "items", "confidence", "members")


def smart_groups(memberships: DataFrame, clusters: DataFrame, *, max_groups: int = 18, min_size: int = 2, min_semantic: float = 0.72, with_members: bool = True) -> DataFrame:
    """``(position, group_id, title, subtitle, kind, priority, items, confidence, members)``.

    Candidates sort by priority, size, title and id; a lane takes its first few, and the first
    ``max_groups`` of all lanes show. A lane's limit depends on earlier rows of that lane alone,
    so a rank within the lane and a global order are the same as picking one by one.
    Sizes are counted for all candidates; members are gathered only for the few that show.
    """
    max_groups, min_size = max(1, max_groups), max(2, min_size)
    pairs = members_by_category(memberships)
    sized = pairs.groupBy("path").agg(F.count("*").alias("items")).where(F.col("items") >= min_size).withColumn("s", X.spec(F.col("path"))).where("s is not null")
    categories = sized.select(F.concat(F.lit("category:"), "path").alias("group_id"), F.col("s.title").alias("title"), F.concat(F.col("items").cast("string"), F.lit(" items · "), F.col("s.subtitle")).alias("subtitle"), F.lit("category").alias("kind"), F.col("s.priority").alias("priority"), "items", F.lit(None).cast("double").alias("confidence"))
    broad = composite_members(pairs).groupBy("group_id").agg(F.count("*").alias("items")).where(F.col("items") >= min_size)
    pick = lambda k: reduce(lambda out, c: out.when(F.col("group_id") == c[0], c[1][k]), X.COMPOSITES.items(), F.when(F.lit(False), F.lit(None)))
    composites = broad.select("group_id", pick(1).alias("title"), F.concat(F.col("items").cast("string"), F.lit(" items · "), pick(2)).alias("subtitle"), F.lit("category").alias("kind"), pick(3).cast("int").alias("priority"), "items", F.lit(None).cast("double").alias("confidence"))
    own = clusters.select(F.col("id").alias("family"), "relation", F.col("confidence").cast("double").alias("confidence"), F.array_sort(F.array_distinct("members")).alias("m")).withColumn("items", F.size("m").cast("long"))
    near = own.where((F.col("relation") == NEAR) & (F.col("items") >= 2)).select(F.concat(F.lit("duplicate:"), "family").alias("group_id"), F.lit("Near-duplicate family").alias("title"), F.concat(F.col("items").cast("string"), F.lit(" almost-identical files")).alias("subtitle"), F.lit("nearDuplicate").alias("kind"), F.lit(120).alias("priority"), "items", "confidence")
    related = own.where((F.col("relation") != NEAR) & (F.col("items") >= max(3, min_size)) & (F.col("confidence") >= min_semantic))
    titles = semantic_titles(related.select("family", "m"), pairs)
    semantic = related.join(titles, "family", "left").select(F.concat(F.lit("semantic:"), "family").alias("group_id"), F.coalesce("title", F.lit("Related items")).alias("title"), F.concat(F.col("items").cast("string"), F.lit(" related items")).alias("subtitle"), F.lit("semantic").alias("kind"), F.lit(85).alias("priority"), "items", "confidence")
    candidates = reduce(DataFrame.unionByName, [categories, composites, near, semantic])
    order = [F.desc("priority"), F.desc("items"), F.asc("title"), F.asc("group_id")]
    limit = reduce(lambda out, x: out.when(F.col("lane") == x[0], min(max_groups, x[1])), X.LANE_LIMITS.items(), F.when(F.lit(False), 0))
    lanes = candidates.withColumn("lane", X.lane(F.col("group_id"), F.col("kind"))).withColumn("n", F.row_number().over(Window.partitionBy("lane").orderBy(*order)))
    # The literal bound lets every task keep its first few of a lane before the shuffle.
    lanes = lanes.where((F.col("n") <= max(X.LANE_LIMITS.values())) & (F.col("n") <= limit))
    shown = lanes.orderBy(*order).limit(max_groups).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    cols = ["position", "group_id", "title", "subtitle", "kind", "priority", "items", "confidence"]
    if not with_members:
        return shown.select(*cols)
    wanted = F.broadcast(shown.select("group_id"))  # at most max_groups rows
    lists = pairs.select(F.concat(F.lit("category:"), "path").alias("group_id"), "file_id").unionByName(composite_members(pairs)).join(wanted, "group_id", "left_semi").groupBy("group_id").agg(F.array_sort(F.collect_set("file_id")).alias("members"))
    families = own.select(F.concat(F.when(F.col("relation") == NEAR, "duplicate:").otherwise("semantic:"), "family").alias("group_id"), F.col("m").alias("members")).join(wanted, "group_id", "left_semi")
    return shown.join(lists.unionByName(families), "group_id", "left").select(*cols, "members").orderBy("position")


def semantic_titles(families: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(family, title)`` by the category with most support among members, two at least, ties by name."""
    member = families.select("family", F.explode("m").alias("file_id"))
    support = member.join(pairs, "file_id").groupBy("family", "path").agg(F.count("*").alias("n")).where("n >= 2").withColumn("s", X.spec(F.col("path"))).where("s is not null")
    return support.groupBy("family").agg(F.min_by(F.col("s.title"), F.struct(-F.col("n"), F.col("path"))).alias("title")).select("family", F.concat(F.lit("Related "), "title").alias("title"))


def category_paths(categories: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(id, path)`` from an adjacency list ``(id, name, parent_id)``; nodes below a missing parent drop out.

    Every round joins each node's path to that of the node above what it covers, so paths double
    in length: a tree of depth d takes log2(d) rounds, whatever its size. A cycle is an error.
    """
    spark = categories.sparkSession
    cur = cut(categories.select("id", F.col("name").alias("path"), F.col("parent_id").alias("up")), "paths")
    for _ in range(max_rounds):
        if cur.where("up is not null").isEmpty():
            return cur.select("id", "path")
        above = cur.select(F.col("id").alias("up"), F.col("path").alias("above"), F.col("up").alias("further"))
        rooted = cur.where("up is null")
        joined = cur.where("up is not null").join(above, "up").select("id", F.concat_ws("/", "above", "path").alias("path"), F.col("further").alias("up"))
        nxt = cut(rooted.unionByName(joined), "paths")
        drop_scratch(spark, cur)
        cur = nxt
    raise RuntimeError("the categories have a cycle")


def ensure_categories(paths: DataFrame, col: str = "category_path") -> DataFrame:
    """Every prefix of every path as ``(path, name, parent)``: keyed by the full path."""
    norm = paths.select(category_path(F.col(col)).alias("p")).where("p <> ''").distinct().select(F.split("p", "/").alias("parts"))
    each = norm.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    return each.select(F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("path"), F.get("parts", F.col("n") - 1).alias("name"), F.when(F.col("n") > 1, F.array_join(F.slice("parts", F.lit(1), F.col("n") - 1), "/")).alias("parent")).distinct()


def unused_categories(categories: DataFrame, memberships: DataFrame) -> DataFrame:
    """Categories ``(path)`` that lead to no membership; ancestors of used ones stay."""
    used = ensure_categories(memberships).select("path").distinct()
    return categories.select("path").join(used, "path", "left_anti")


def tree(memberships: DataFrame) -> DataFrame:
    """``(path, name, parent, files, children)`` for every node, files of the node itself."""
    nodes = ensure_categories(memberships)
    files = members_by_category(memberships).groupBy("path").agg(F.count("*").alias("files"))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.array_sort(F.collect_list("name")).alias("children"))
    none = F.array().cast("array<string>")
    return nodes.join(files, "path", "left").join(kids, "path", "left").select("path", "name", "parent", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("children", none).alias("children"))


def leaf_tree(memberships: DataFrame) -> DataFrame:
    """``(leaf, files)``: memberships by the last component of their path."""
    pairs = members_by_category(memberships)
    return pairs.groupBy(F.element_at(F.split("path", "/"), -1).alias("leaf")).agg(F.count("*").alias("files"))
