"""Catalogue-shaped views over the synthetic tables, in Spark and (for the oracles) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.functions import labels as L
from stackroom.functions import paths as P
from stackroom.session import table

EXTENSIONS = ("txt", "md", "pdf", "png", "py", "docx", "zip", "mp4", "mp3", "html")


def files(spark: SparkSession, sf: str, contents: bool = False) -> DataFrame:
    """``documents`` as files: paths, kinds and statuses follow from the id."""
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    ext = F.element_at(F.array(*(F.lit(e) for e in EXTENSIONS)), (i % 10 + 1).cast("int"))
    folder = F.when(i % 29 == 0, "/node_modules").when(i % 43 == 0, "/bazel-out2").otherwise("")
    prefix = F.when(i % 7 == 0, F.concat(F.lit("csc_"), (100 + i % 40).cast("string"), F.lit("-"))).when(i % 11 == 0, "Screenshot ").otherwise("")
    path = F.concat(F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), F.coalesce("source", F.lit("none")), folder, F.lit("/"), prefix, F.lit("doc"), i.cast("string"), F.lit("."), ext, F.when(i % 53 == 0, ".part").otherwise(""))
    status = F.when(i % 41 == 0, "missing").when(i % 37 == 0, "unscoped").when(i % 31 == 0, "pending").otherwise("indexed")
    rows = d.withColumn("path", path)
    out = rows.select("doc_id", P.opaque_id(F.col("path")).alias("file_id"), "path", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), (F.lit(1700000000.0) + i * 60).alias("mtime"), P.kind(F.col("path")).alias("kind"), status.alias("status"), F.lit("v1").alias("last_extractor"), *([F.col("text").alias("content")] if contents else []))
    return out


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf, True).where("content is not null").select("file_id", F.col("content").alias("body"))


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf, True).where("content is not null").select("file_id", "size", F.sha2("content", 256).alias("sha256"))


def classifications(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    conf = F.when(F.col("quality").isNull(), 0.55).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0.9).when(F.col("quality") == 1, 0.6).otherwise(0.3)
    c = L.classify(F.col("path"), F.col("kind"), F.lit(None).cast("string"))
    return files(spark, sf).join(lab, "doc_id", "left").select("doc_id", "file_id", c["categories"].alias("categories"), c["reasons"].alias("reason_codes"), conf.alias("confidence"))


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    c = L.classify(F.col("path"), F.col("kind"), F.lit(None).cast("string"))
    return files(spark, sf).select(F.explode(c["categories"]).alias("category_path"), "file_id")


def inbox(spark: SparkSession, sf: str) -> DataFrame:
    from stackroom.operators.rollups import review_inbox

    rows = classifications(spark, sf)
    return review_inbox(rows).join(rows.select("file_id", "doc_id"), "file_id").select("file_id", F.when(F.col("doc_id") % 5 == 0, "resolved").otherwise("open").alias("state"), "reason", F.col("doc_id").cast("double").alias("updated"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of files: ``vec_id`` is a document's id; every fifth belongs to another model."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    return files(spark, sf).select("doc_id", "file_id").join(e, "doc_id").select("file_id", F.when(F.col("doc_id") % 5 == 4, "m1").otherwise("m0").alias("model"), "vector", "label", "doc_id")


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as chunks of the first fifty documents."""
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 50).alias("doc_id"), F.expr("vec_id div 50").cast("int").alias("chunk_index"), F.col("embedding").alias("vector"))
    return files(spark, sf).select("doc_id", "file_id").join(e, "doc_id").select("file_id", F.lit("m0").alias("model"), "chunk_index", "vector")


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts of the document of the same number."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 200).alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn") * 15).cast("double").alias("start"), (F.col("conv_id") * 1000 + F.col("turn") * 15 + 15).cast("double").alias("end"), "text")
    return files(spark, sf).select("doc_id", "file_id").join(c, "doc_id").select("file_id", "start", "end", "text")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as file changes: an error means that events were dropped; an hour is a batch."""
    e = table(spark, sf, "events")
    flags = F.when(F.col("event_id") % 997 == 0, 2).otherwise(256)
    return e.select(F.concat(F.lit("/live/u"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".txt")).alias("path"), flags.alias("flags"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as review decisions about a document's category."""
    lab = table(spark, sf, "labels").where("toxic is not null")
    f = files(spark, sf).select("doc_id", "file_id", "path")
    from stackroom.operators.learning import derive_pattern

    rows = lab.join(f, "doc_id").withColumn("p", derive_pattern(F.col("path")))
    return rows.select("file_id", F.concat(F.lit("Topic/"), (F.col("doc_id") % 4).cast("string")).alias("category"), F.when(F.col("toxic") == 1, "removeCategory").otherwise("addCategory").alias("action"), F.col("p.pattern_type").alias("pattern_type"), F.col("p.pattern").alias("pattern"), F.when(F.col("doc_id") % 13 != 0, "g1").alias("generation"))


_KIND_SQL = "CASE WHEN doc_id%53=0 THEN 'other' WHEN doc_id%10 IN (0,1,4,9) THEN 'text' WHEN doc_id%10=2 THEN 'pdf' WHEN doc_id%10=3 THEN 'image' WHEN doc_id%10=5 THEN 'office' WHEN doc_id%10=6 THEN 'archive' WHEN doc_id%10=7 THEN 'video' ELSE 'audio' END"
SQL = {
    "files": f"""files AS (SELECT *, 'file_' || substr(sha256(path),1,12) AS file_id FROM (SELECT doc_id, text AS content, lang, source,
 '/' || coalesce(lang,'xx') || '/' || coalesce(source,'none') || CASE WHEN doc_id%29=0 THEN '/node_modules' WHEN doc_id%43=0 THEN '/bazel-out2' ELSE '' END || '/' ||
 CASE WHEN doc_id%7=0 THEN 'csc_' || (100+doc_id%40)::varchar || '-' WHEN doc_id%11=0 THEN 'Screenshot ' ELSE '' END || 'doc' || doc_id::varchar || '.' ||
 (['txt','md','pdf','png','py','docx','zip','mp4','mp3','html'])[(doc_id%10+1)::int] || CASE WHEN doc_id%53=0 THEN '.part' ELSE '' END AS path,
 strlen(coalesce(text,'')) AS size, 1700000000.0::double + doc_id*60 AS mtime, {_KIND_SQL} AS kind,
 CASE WHEN doc_id%41=0 THEN 'missing' WHEN doc_id%37=0 THEN 'unscoped' WHEN doc_id%31=0 THEN 'pending' ELSE 'indexed' END AS status FROM documents))""",
    "hashes": "hashes AS (SELECT file_id, size, sha256(content) AS sha256 FROM files WHERE content IS NOT NULL)",
    "memberships": """memberships AS (
 SELECT CASE kind WHEN 'text' THEN 'Documents/Text' WHEN 'pdf' THEN 'Documents/PDF' WHEN 'image' THEN 'Image' WHEN 'office' THEN 'Documents/Office' WHEN 'archive' THEN 'Archives' WHEN 'video' THEN 'Video' WHEN 'audio' THEN 'Audio' ELSE 'Review' END AS category_path, file_id, doc_id FROM files
 UNION ALL SELECT 'School/CSC-' || (100+doc_id%40)::varchar, file_id, doc_id FROM files WHERE doc_id%7=0
 UNION ALL SELECT 'Projects/Code', file_id, doc_id FROM files WHERE doc_id%10=4 AND doc_id%53<>0
 UNION ALL SELECT 'Screenshot', file_id, doc_id FROM files WHERE doc_id%10=3 AND doc_id%53<>0 AND doc_id%11=0 AND doc_id%7<>0)""",
    "classifications": """classifications AS (SELECT f.doc_id, f.file_id, CASE WHEN quality IS NULL THEN 0.55 WHEN quality=1 AND toxic=0 THEN 0.9 WHEN quality=1 THEN 0.6 ELSE 0.3 END::double AS confidence FROM files f LEFT JOIN labels l USING (doc_id))""",
    "inbox": """inbox AS (SELECT file_id, CASE WHEN doc_id%5=0 THEN 'resolved' ELSE 'open' END AS state, CASE WHEN confidence<0.45 THEN 'needs-review' ELSE 'ambiguous' END AS reason, doc_id::double AS updated FROM classifications WHERE confidence < 0.80)""",
    "vectors": """vectors AS (SELECT f.file_id, CASE WHEN f.doc_id%5=4 THEN 'm1' ELSE 'm0' END AS model, embedding AS vector, label, f.doc_id FROM files f JOIN embeddings e ON e.vec_id=f.doc_id)""",
    "chunk_vectors": "chunk_vectors AS (SELECT f.file_id, 'm0' AS model, e.vec_id//50 AS chunk_index, embedding AS vector FROM files f JOIN embeddings e ON e.vec_id%50=f.doc_id)",
    "transcripts": """transcripts AS (SELECT f.file_id, (conv_id*1000+turn*15)::double AS start, (conv_id*1000+turn*15+15)::double AS "end", c.text FROM files f JOIN conversations c ON c.conv_id%200=f.doc_id)""",
    "live": """live AS (SELECT '/live/u' || user_id::varchar || '/' || event_type || '.txt' AS path, CASE WHEN event_id%997=0 THEN 2 ELSE 256 END AS flags, event_id, ts, strftime(ts,'%Y-%m-%d') AS day FROM events)""",
    "corrections": """corrections AS (SELECT f.file_id, 'Topic/' || (f.doc_id%4)::varchar AS category, CASE WHEN toxic=1 THEN 'removeCategory' ELSE 'addCategory' END AS action, 'pathKeyword' AS pattern_type, CASE WHEN f.doc_id%29=0 THEN 'node_modules' WHEN f.doc_id%43=0 THEN 'bazel-out2' ELSE coalesce(source,'none') END AS pattern, CASE WHEN f.doc_id%13<>0 THEN 'g1' END AS generation FROM files f JOIN labels l USING (doc_id) WHERE toxic IS NOT NULL)""",
    "exact": """exact AS (SELECT a.file_id AS a, b.file_id AS b FROM hashes a JOIN hashes b ON a.size=b.size AND a.sha256=b.sha256 AND a.file_id<b.file_id)""",
    "tokens": r"""toks AS (SELECT file_id, status, path, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM files WHERE content IS NOT NULL)""",
    "spoken": r"""spoken AS (SELECT t.file_id, f.status, f.path, start, list_filter(string_split_regex(lower(t.text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM transcripts t JOIN files f USING (file_id) WHERE trim(t.text) <> '')""",
}
NEEDS = {"hashes": ["files"], "memberships": ["files"], "classifications": ["files"], "inbox": ["classifications"], "vectors": ["files"], "chunk_vectors": ["files"], "transcripts": ["files"], "corrections": ["files"], "exact": ["hashes"], "tokens": ["files"], "spoken": ["transcripts"]}


def with_views(names: str, sql: str, recursive: bool = False) -> str:
    """``sql`` after the named views and what they need."""
    order: list[str] = []

    def add(n):
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    if not order:
        return sql
    sep = ",\n" if sql.lstrip().startswith(",") else "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in order) + (sep + sql.lstrip().lstrip(",") if sep == ",\n" else sep + sql)
