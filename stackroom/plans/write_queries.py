"""Registered queries of the write path, the learning loop's tables, and sources read from bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.functions import text as T
from stackroom.functions import vectors as V
from stackroom.operators import groups as G
from stackroom.operators import incremental as I
from stackroom.operators import learning as R
from stackroom.operators import rollups as U
from stackroom.operators import search as S
from stackroom.operators import similarity as C
from stackroom.plans import indexing as N
from stackroom.plans import views as W
from stackroom.plans.queries import _MERGED, _PHRASE, _RULES, _SEM, _SPEC, _rank
from stackroom.plans.registry import query
from stackroom.schemas import DDL
from stackroom.session import dealt, scratch_path, table
from stackroom.sources import files as SF
from stackroom.sources import pdf as PDF
from stackroom.sources import providers as V1
from stackroom.sources import tables as ST
from stackroom.streaming import live as Y

c = F.col
_RULE_DDL = "id long, pattern_type string, pattern string, target_category string, enabled boolean"


# ---- indexing ---------------------------------------------------------------------------------


def _scan(spark, sf):
    """The documents as a scan of ``/``."""
    return W.files(spark, sf, True).select("path", "size", "mtime", F.coalesce("content", F.lit("")).cast("binary").alias("content"))


def _empty(spark):
    return {name: spark.createDataFrame([], DDL[name]) for name in N.CATALOG}


@query("files", "SELECT path, file_id, size, kind, 'indexed' AS status FROM files")
def indexed_files(spark, sf):
    return N.index_root(_scan(spark, sf), _empty(spark), "/")["files"].select("path", "file_id", "size", "kind", "status")


@query("files", "SELECT file_id, size, sha256(coalesce(content, '')) AS sha256 FROM files")
def indexed_hashes(spark, sf):
    return N.index_root(_scan(spark, sf), _empty(spark), "/")["exact_hashes"].select("file_id", "size", "sha256")


@query("files", "SELECT file_id, md5(substr(content, 1, 8000)) AS body FROM files WHERE kind = 'text' AND trim(substr(content, 1, 8000)) <> ''")
def indexed_texts(spark, sf):
    return N.index_root(_scan(spark, sf), _empty(spark), "/")["text_content"].select("file_id", F.md5("body").alias("body"))


@query("files", "SELECT file_id, CASE WHEN doc_id % 9 = 5 AND NOT (contains(path, '/node_modules/') OR contains(path, '/bazel-')) THEN 'missing' ELSE 'indexed' END AS status, CASE WHEN doc_id % 9 <> 5 AND doc_id % 8 = 3 THEN 2.0 ELSE 1.0 END::double AS last_indexed FROM files")
def reindexed_files(spark, sf):
    """A second session: some files changed, some are gone; the others are not read again."""
    store = scratch_path(spark, "store")
    N.scan_session(_scan(spark, sf), store, "/", now=1.0)
    number = F.regexp_extract("path", r"doc(\d+)", 1).cast("long")
    later = _scan(spark, sf).where(number % 9 != 5).withColumn("mtime", c("mtime") + F.when(number % 8 == 3, 60.0).otherwise(0.0))
    N.scan_session(later, store, "/", now=2.0)
    return ST.load(spark, store, "files").select("file_id", "status", "last_indexed")


@query("files", "SELECT 1 AS generation, 'paused' AS completion, 0 AS missing, 1 AS batches UNION ALL SELECT 2, 'completed', 0, 2 UNION ALL SELECT 3, 'cancelled', 0, 0 UNION ALL SELECT 4, 'rootUnavailable', 0, 0 UNION ALL SELECT 5, 'limited', 0, 1")
def scan_sessions(spark, sf):
    """Sessions that end in every way, over one store."""
    store, rows = scratch_path(spark, "store"), _scan(spark, sf)
    N.scan_session(rows, store, "/", batches=2, control=lambda done: N.PAUSE if done else N.RUN, now=1.0)
    N.scan_session(rows, store, "/", batches=2, control=lambda done: N.RUN, now=2.0)
    N.scan_session(rows, store, "/", control=lambda done: N.CANCEL, now=3.0)
    N.scan_session(rows, store, "/", available=False, now=4.0)
    N.scan_session(rows.where("size > 100"), store, "/", complete=False, now=5.0)
    return ST.load(spark, store, "scan_sessions").select("generation", "completion", "missing", "batches")


@query("files", "SELECT 'files' AS name, file_id FROM files WHERE doc_id % 2 = 0 UNION ALL SELECT 'hashes', file_id FROM files WHERE content IS NOT NULL")
def committed_tables(spark, sf):
    """Two tables in one commit, one of them replaced by a second commit that reads it."""
    store = scratch_path(spark, "store")
    ST.commit(spark, store, {"mine": W.files(spark, sf), "hashes": W.hashes(spark, sf)})
    ST.commit(spark, store, {"mine": ST.load(spark, store, "mine").where("doc_id % 2 = 0")})
    parts = [ST.load(spark, store, n).select(F.lit(m).alias("name"), "file_id") for n, m in (("mine", "files"), ("hashes", "hashes"))]
    return parts[0].unionByName(parts[1])


@query("files", "SELECT path, file_id, size, floor(mtime)::double AS mtime, kind FROM files")
def file_identities(spark, sf):
    seen = W.files(spark, sf).select("path", c("size").alias("length"), F.timestamp_seconds("mtime").alias("modificationTime"))
    return SF.identities(seen).select("path", "file_id", "size", "mtime", "kind")


@query("files", "SELECT path, size FROM files ORDER BY path LIMIT 40")
def sorted_listing(spark, sf):
    seen = W.files(spark, sf).select("path", c("size").alias("length"), F.timestamp_seconds("mtime").alias("modificationTime"))
    return SF.listing(seen, 40)[0].select("path", "size")


@query("files", "SELECT path FROM files WHERE size <= 2000")
def complete_snapshots(spark, sf):
    return SF.complete(W.files(spark, sf).withColumn("length", c("size")), 2000).select("path")


@query("files", "SELECT path, CASE WHEN listed > 2000 THEN 'too-large' WHEN content IS NULL THEN 'unread' WHEN strlen(content) <> listed THEN 'changed' ELSE 'complete' END AS state FROM (SELECT *, size + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS listed FROM files)")
def snapshot_states(spark, sf):
    """Every tenth file grew since it was listed."""
    listed = W.files(spark, sf, True).withColumn("length", c("size") + F.when(c("doc_id") % 10 == 0, 1).otherwise(0)).withColumn("content", c("content").cast("binary"))
    return SF.snapshot_states(listed, 2000)


@query(None, "SELECT 8 AS generation, 1 AS wrapped")
def scan_generation(spark, sf):
    meta = spark.createDataFrame([("root_scan_counter", "7")], "k string, v string")
    return I.next_generation(meta).crossJoin(I.next_generation(meta, limit=7).select(c("generation").alias("wrapped")))  # one row each


_KEY = "||".join(f"'{k}:{p}:{t}'" + (" || ';' " if i < 2 else "") for i, (_, k, p, t, on) in enumerate(sorted(_RULES, key=lambda r: f"{r[1]}:{r[2]}:{r[3]}")) if on)


@query(None, f"SELECT 'v1|emb' || '|rules:' || substr(sha256({_KEY}), 1, 16) AS version")
def rule_version(spark, sf):
    rules = spark.createDataFrame(_RULES, _RULE_DDL)
    return spark.createDataFrame([(I.processing_version("v1", "emb", rules=rules),)], "version string")


@query("files", "SELECT file_id FROM files WHERE doc_id % 4 <> 1")
def dequeued(spark, sf):
    files = W.files(spark, sf)
    return I.dequeue(files.select("file_id"), files.where("doc_id % 4 = 1"))


# ---- learning ---------------------------------------------------------------------------------


def _review(spark, sf):
    decisions = W.corrections(spark, sf).select("file_id", "category", "action", F.lit(7.0).alias("created"))
    catalog = {
        "files": W.files(spark, sf).withColumn("mtime", c("mtime").cast("long")),
        "corrections": spark.createDataFrame([], DDL["corrections"]),
        "category_overrides": spark.createDataFrame([], DDL["category_overrides"]),
        "classifications": W.classifications(spark, sf),
        "learned_rules": None,
        "audit": spark.createDataFrame([], "file_id string, action string, category string, created double, provenance string"),
    }
    return R.review_correction(catalog, decisions)


@query("corrections", "SELECT file_id, category, action, 7.0::double AS updated FROM corrections")
def review_overrides(spark, sf):
    return _review(spark, sf)["category_overrides"]


@query("corrections memberships", "SELECT f.file_id, string_agg(k, ',' ORDER BY k) AS categories FROM (SELECT file_id, category_path AS k FROM memberships UNION SELECT file_id, category FROM corrections WHERE action = 'addCategory') f GROUP BY f.file_id")
def review_categories(spark, sf):
    return _review(spark, sf)["classifications"].select("file_id", F.array_join(F.array_sort("categories"), ",").alias("categories"))


@query("corrections", "SELECT pattern_type, pattern, category AS target_category, count(DISTINCT file_id) FILTER (action='addCategory') AS positives FROM corrections GROUP BY 1, 2, 3 HAVING count(*) FILTER (action='removeCategory') = 0 AND count(DISTINCT file_id) FILTER (action='addCategory') >= 3")
def review_promotions(spark, sf):
    return _review(spark, sf)["learned_rules"].select("pattern_type", "pattern", "target_category", "positives")


@query("corrections", "SELECT file_id, action, category, 'review' AS provenance FROM corrections")
def review_audit(spark, sf):
    return _review(spark, sf)["audit"].select("file_id", "action", "category", "provenance")


@query("files", "SELECT file_id, CASE WHEN doc_id % 15 = 0 THEN 'A' WHEN doc_id % 3 = 0 THEN 'A,B' WHEN doc_id % 5 = 0 THEN 'B' ELSE 'A,B' END AS categories FROM files")
def ordered_overrides(spark, sf):
    """A removal, an addition of the same category, another removal: the order counts."""
    files, i = W.files(spark, sf), c("doc_id")
    row = lambda rows, category, action, at: rows.select("file_id", F.lit(category).alias("category"), F.lit(action).alias("action"), F.lit(at).alias("updated"))
    over = row(files.where(i % 3 == 0), "A", "removeCategory", 1.0).unionByName(row(files.where(i % 3 == 0), "A", "addCategory", 2.0))
    over = over.unionByName(row(files.where((i % 5 == 0) & (i % 3 != 0)), "A", "removeCategory", 3.0)).unionByName(row(files.where(i % 15 == 0), "B", "removeCategory", 3.0))
    out = R.apply_overrides(files.select("file_id", F.array(F.lit("A"), F.lit("B")).alias("categories")), over)
    return out.select("file_id", F.array_join(F.array_sort("categories"), ",").alias("categories"))


@query(None, "SELECT * FROM (VALUES (1, 'md'), (2, '/en/src1/'), (3, 'pdf')) r(id, pattern)")
def rule_scan(spark, sf):
    rules = spark.createDataFrame(_RULES, _RULE_DDL)
    return R.all_rules(rules, enabled_only=True).select(c("id").cast("int").alias("id"), "pattern")


@query("files", "SELECT file_id, path, 5.0::double AS enqueued FROM files WHERE status<>'unscoped' AND contains(path, 'src1') AND doc_id % 3 <> 0")
def queued_paths(spark, sf):
    files = W.files(spark, sf)
    queue = R.reindex_queue(files, {"pattern_type": "pathKeyword", "pattern": "src1"}, 5.0)
    return R.queued_files(queue, files.where("doc_id % 3 <> 0"))


@query("files", "SELECT file_id, CASE WHEN status<>'unscoped' AND contains(path,'src1') THEN '' ELSE 'v1' END AS last_extractor, 3 AS rules FROM files")
def deleted_rule(spark, sf):
    rules, files, _ = R.delete_rule(spark.createDataFrame(_RULES, _RULE_DDL), W.files(spark, sf), {"id": 2, "pattern_type": "pathKeyword", "pattern": "src1"}, 5.0)
    return files.select("file_id", "last_extractor").crossJoin(rules.agg(F.count("*").cast("int").alias("rules")))  # one row


# ---- search -----------------------------------------------------------------------------------


@query("tokens", f"SELECT file_id, rank FROM {_rank('toks')} ORDER BY rank, file_id LIMIT 50")
def indexed_search(spark, sf):
    """The same rows as ``bm25_search``, from a published index that was built in two steps."""
    texts, store = W.texts(spark, sf), scratch_path(spark, "store")
    later = F.xxhash64("file_id") % 2 == 0
    ST.commit(spark, store, S.build_index(texts.where(~later).unionByName(texts.where(later).withColumn("body", F.lit("in the old text")))))
    old = {k: ST.load(spark, store, k) for k in ("postings", "lengths")}
    ST.commit(spark, store, S.update_index(old, texts.where(later), texts.where(later)))
    return S.search_index({k: ST.load(spark, store, k) for k in old}, _PHRASE).select("file_id", "rank")


_COS = "greatest(-1.0, least(1.0, list_dot_product(v.vector::double[], q.vector::double[])))"


@query("vectors", f"SELECT v.file_id, f.path, round({_COS}, 6) AS score FROM vectors v JOIN files f USING (file_id), (SELECT * FROM vectors WHERE doc_id = 7) q WHERE v.model = q.model AND v.file_id <> q.file_id AND f.status = 'indexed' AND {_COS} >= 0.05 ORDER BY score DESC, path LIMIT 20")
def image_to_image(spark, sf):
    files = W.files(spark, sf)
    own = files.where("doc_id = 7").select("file_id").first()["file_id"]
    return S.image_search(files, W.vectors(spark, sf), own, model="m0", threshold=0.05).withColumn("score", F.round("score", 6))


@query("files", "SELECT file_id, path, 0.5::double AS score, 'feature-print' AS source FROM files WHERE doc_id % 10 = 3")
def best_visual_search(spark, sf):
    """No embedding hits: feature prints take over."""
    files = W.files(spark, sf)
    none = files.where("false").select("file_id", "path", F.lit(1.0).alias("score"))
    return S.best_visual_search(none, files.where("doc_id % 10 = 3").select("file_id", "path", F.lit(0.5).alias("distance")))


@query("files", "SELECT file_id FROM files WHERE kind = 'image'")
def first_non_empty(spark, sf):
    files = W.files(spark, sf)
    return S.first_non_empty(files.where("kind = 'nothing'"), files.where("kind = 'image'"), files).select("file_id")


@query("tokens spoken", f"SELECT file_id, src FROM ({_MERGED}) UNION ALL SELECT file_id, 2 AS src FROM (SELECT file_id FROM files WHERE status = 'indexed' ORDER BY path LIMIT 30) WHERE file_id NOT IN (SELECT file_id FROM ({_MERGED}))")
def merged_listings(spark, sf):
    """Hits of a search, then a page of files that are not among them."""
    hits = S.exact_search(W.files(spark, sf), W.texts(spark, sf), W.transcripts(spark, sf), _PHRASE).select("file_id", "src")
    page = W.files(spark, sf).where("status = 'indexed'").orderBy("path").limit(30).select("file_id", F.lit(2).alias("src"))
    return ST.union_by_id(hits, page)


# ---- graph and groups -------------------------------------------------------------------------


@query("exact vectors", f", {_SEM}, e AS (SELECT a, b, 'semantic' AS relation, 'embedding:' || model AS signal FROM sem WHERE score >= 0.30 UNION ALL SELECT a, b, 'nearDuplicate', 'exactHash' FROM exact) SELECT a, b, relation, signal FROM e WHERE a NOT IN (SELECT file_id FROM files WHERE doc_id % 10 = 1) AND b NOT IN (SELECT file_id FROM files WHERE doc_id % 10 = 1)")
def updated_graph(spark, sf):
    """The graph after a tenth of the files changed and a tenth went, as a rebuild would have it."""
    files = W.files(spark, sf)
    nodes = W.hashes(spark, sf).select(c("file_id").alias("id"), c("sha256").alias("exact_hash"))
    vectors = W.vectors(spark, sf).select(c("file_id").alias("id"), "model", "vector")
    ids = lambda k: files.where(c("doc_id") % 10 == k).select(c("file_id").alias("id"))
    stale = vectors.join(ids(0), "id", "left_anti").unionByName(vectors.join(ids(0), "id").withColumn("vector", F.transform("vector", lambda x: -x)))
    before = C.build_edges(C.exact_edges(nodes), C.embedding_edges(stale, threshold=0.30))
    return C.update_graph(before, nodes, vectors, ids(0), ids(1), threshold=0.30)[0].select("a", "b", "relation", "signal")


@query("exact", "SELECT a, b, 'nearDuplicate' AS relation FROM exact")
def edge_scan(spark, sf):
    near = C.exact_edges(W.hashes(spark, sf).select(c("file_id").alias("id"), c("sha256").alias("exact_hash")))
    other = near.withColumn("relation", F.lit("semantic"))
    return C.edge_scan(near.unionByName(other), "nearDuplicate").select("a", "b", "relation")


@query("memberships vectors", ", s AS (SELECT label AS family, category_path AS path, count(*) AS n FROM vectors v JOIN memberships m USING (file_id) WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1), t AS (SELECT family, n, path, CASE WHEN starts_with(path,'School/') THEN substr(path,8) WHEN path='Projects/Code' THEN 'Code projects' WHEN path='Documents/PDF' THEN 'PDFs' WHEN path='Documents/Office' THEN 'Office documents' END AS title FROM s) SELECT family::varchar AS family, 'Related ' || arg_min(title, struct_pack(a := -n, b := path)) AS title FROM t WHERE title IS NOT NULL GROUP BY family")
def semantic_titles(spark, sf):
    """Vectors of one label as a family: titled after the category that most members share."""
    families = W.vectors(spark, sf).where("label is not null").groupBy(c("label").cast("string").alias("family")).agg(F.array_sort(F.collect_set("file_id")).alias("m"))
    return G.semantic_titles(families, G.members_by_category(W.memberships(spark, sf)))


@query("memberships hashes", f", {_SPEC}, top AS (SELECT group_id FROM (SELECT group_id, priority, items, title, row_number() OVER (PARTITION BY lane ORDER BY priority DESC, items DESC, title, group_id) AS k, lane FROM cand) WHERE k <= CASE lane WHEN 'duplicates' THEN 3 WHEN 'school' THEN 4 WHEN 'projects' THEN 2 WHEN 'downloads' THEN 1 WHEN 'media' THEN 1 ELSE 4 END ORDER BY priority DESC, items DESC, title, group_id LIMIT 18), mem AS (SELECT DISTINCT 'category:' || category_path AS group_id, file_id FROM memberships UNION ALL SELECT DISTINCT CASE WHEN category_path IN ('Applications','DiskImages','Packages','Archives') THEN 'composite:installers-archives' ELSE 'composite:media' END, file_id FROM memberships WHERE category_path IN ('Applications','DiskImages','Packages','Archives','Audio','Video') UNION ALL SELECT 'duplicate:' || fam, unnest(ids) FROM (SELECT substr(sha256('nearDuplicate|' || string_agg(file_id,'|' ORDER BY file_id)),1,16) AS fam, list(file_id) AS ids FROM hashes GROUP BY sha256 HAVING count(*)>1)) SELECT group_id, file_id FROM mem WHERE group_id IN (SELECT group_id FROM top)")
def group_members(spark, sf):
    clusters = C.clusters(C.exact_family_edges(W.hashes(spark, sf).select(c("file_id").alias("id"), c("sha256").alias("exact_hash"))))
    return G.smart_groups(W.memberships(spark, sf), clusters).select("group_id", F.explode("members").alias("file_id"))


@query("files", "SELECT '/' || lang AS root, count(*) AS files FROM files WHERE status <> 'unscoped' AND lang IN ('de', 'en', 'fr') GROUP BY lang ORDER BY root LIMIT 2")
def summaries_page(spark, sf):
    rows = U.project_summary(W.files(spark, sf), W.inbox(spark, sf), W.vectors(spark, sf), W.chunk_vectors(spark, sf), ["/fr", "/en", "/de"])
    return U.summaries_page(rows, 2).select("root", "files")


# ---- values -----------------------------------------------------------------------------------


@query("memberships", "SELECT file_id, string_agg(category_path, ',' ORDER BY category_path) AS categories FROM memberships GROUP BY file_id")
def json_columns(spark, sf):
    """Categories through JSON text and back."""
    text = W.classifications(spark, sf).select("file_id", T.encoded(c("categories")).alias("j"))
    return text.select("file_id", F.array_join(F.array_sort(T.decoded(c("j"), "array<string>")), ",").alias("categories"))


@query(None, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS categories, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE round(least(1, greatest(0, value)), 6) END::double AS confidence FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase', 'signup')")
def model_answers(spark, sf):
    """A model's answers in prose around JSON; every fourth has none."""
    kinds = ["click", "view", "error", "purchase", "signup"]
    e = table(spark, sf, "events").where(c("event_type").isin(*kinds))
    answer = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.array("event_type", F.lit("unknown kind")).alias("categories"), F.col("value").alias("confidence"))), F.lit(" as asked"))
    parsed = T.model_json(F.when(c("event_id") % 4 == 0, F.lit("no idea")).otherwise(answer), kinds)
    return e.select("event_id", F.array_join(parsed["categories"], ",").alias("categories"), F.round(parsed["confidence"], 6).alias("confidence"))


@query(None, "SELECT vec_id, array_to_string([round(e[i*2+1] * 100000)::bigint FOR i IN range(0, len(e)//2)][1:4], ',') AS head, (len(e)//2)::int AS samples FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings)")
def resampled(spark, sf):
    """Every vector as samples at twice the rate: each second one is left."""
    r = V.resample_mono(c("embedding").cast("array<double>"), F.lit(2.0))
    out = table(spark, sf, "embeddings").select("vec_id", r.alias("r"))
    return out.select("vec_id", F.array_join(F.transform(F.slice("r", 1, 4), lambda x: F.round(x * 100000).cast("long").cast("string")), ",").alias("head"), F.size("r").alias("samples"))


def _little(value, width: int):
    """A number as ``width`` little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * width - 1 - 2 * k, 2) for k in range(width))))


def _wav(spark, sf):
    """Customers as mono recordings: so many samples of a constant level, every seventh file cut short."""
    n = 20 + c("c_custkey") % 50
    level = F.lpad(F.hex((c("c_custkey") % 100).cast("long")), 4, "0")
    sample = F.concat(F.substring(level, 3, 2), F.substring(level, 1, 2))
    data = F.unhex(F.repeat(sample, n.cast("int")))
    head = F.concat(F.encode(F.lit("RIFF"), "US-ASCII"), _little(36 + 2 * n, 4), F.encode(F.lit("WAVEfmt "), "US-ASCII"), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(1), 2), _little(F.lit(8), 4), _little(F.lit(16), 4), _little(F.lit(2), 2), _little(F.lit(16), 2))
    whole = F.concat(head, F.encode(F.lit("data"), "US-ASCII"), _little(2 * n, 4), data)
    short = F.when(c("c_custkey") % 7 == 0, F.substring(whole, 1, 50)).otherwise(whole)
    return dealt(table(spark, sf, "customer")).select(c("c_custkey").cast("string").alias("path"), short.alias("content"))


@query(None, "SELECT c_custkey::varchar AS path, CASE WHEN c_custkey % 7 = 0 THEN 'truncated' ELSE 'ok' END AS verdict, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 2 * (20 + c_custkey % 50) END::int AS length FROM customer")
def wav_headers(spark, sf):
    return SF.wav_headers(_wav(spark, sf)).select("path", "verdict", "length")


@query(None, "SELECT c_custkey::varchar AS path, k::int AS chunk, round((c_custkey % 100) / 32768.0, 6)::double AS level, least(32, 2 * (20 + c_custkey % 50) - 32 * k)::int AS samples FROM customer, range(0, 5) r(k) WHERE c_custkey % 7 <> 0 AND 32 * k < 2 * (20 + c_custkey % 50)")
def pcm_chunks(spark, sf):
    """Eight samples a second, doubled to sixteen, in pieces of two seconds."""
    out = SF.pcm_chunks(_wav(spark, sf), rate=16, seconds=2.0)
    return out.select("path", "chunk", F.round(F.get("samples", 0).cast("double"), 6).alias("level"), F.size("samples").alias("samples"))


@query(None, "SELECT c_custkey::varchar AS path, CASE WHEN c_custkey % 100 > 0 THEN 'success' ELSE 'none' END AS state, CASE WHEN c_custkey % 100 > 0 THEN ceil(2 * (20 + c_custkey % 50) / 32.0) ELSE 0 END::int AS segments FROM customer WHERE c_custkey % 7 <> 0")
def transcribed(spark, sf):
    """Recordings through the stand-in for a speech model: levels are raised so that it hears them."""
    loud = SF.pcm_chunks(_wav(spark, sf), rate=16, seconds=2.0).withColumn("samples", F.transform("samples", lambda x: (x * 1000).cast("float")))
    return V1.transcribe_rows(loud, V1.SilenceProvider()).select("path", "state", F.size("segments").alias("segments"))


@query(None, "SELECT s_suppkey::varchar AS path, 'a' || s_suppkey || '.txt,dir/b' || s_suppkey AS members FROM supplier")
def zip_members(spark, sf):
    """Suppliers as archives of two members, read from their central directories."""

    def entry(name):
        return F.concat(F.unhex(F.lit("504B0102" + "00" * 24)), _little(F.octet_length(name), 2), F.unhex(F.lit("00" * 16)), F.encode(name, "UTF-8"))

    names = [F.concat(F.lit("a"), c("s_suppkey").cast("string"), F.lit(".txt")), F.concat(F.lit("dir/b"), c("s_suppkey").cast("string"))]
    body = F.concat(*(entry(n) for n in names))
    end = F.concat(F.unhex(F.lit("504B0506" + "00" * 4)), _little(F.lit(2), 2), _little(F.lit(2), 2), _little(F.octet_length(body), 4), _little(F.lit(10), 4), F.unhex(F.lit("0000")))
    files = table(spark, sf, "supplier").select(c("s_suppkey").cast("string").alias("path"), F.concat(F.encode(F.lit("0123456789"), "US-ASCII"), body, end).alias("content"))
    return SF.zip_members(files).select("path", F.array_join("members", ",").alias("members"))


@query(None, "SELECT p_partkey::varchar AS path, 2 AS pages, p_name || ' (part)' || chr(10) || p_partkey::varchar AS text FROM part")
def pdf_texts(spark, sf):
    """Parts as PDF files of two pages: the name as a literal string, the key in hexadecimal."""
    name = F.concat(F.lit("BT /F1 12 Tf 72 720 Td ("), F.regexp_replace("p_name", r"([()\\\\])", r"\\\\$1"), F.lit(r" \(part\)) Tj ET"))
    key = F.concat(F.lit("BT <"), F.hex(F.encode(c("p_partkey").cast("string"), "US-ASCII")), F.lit("> Tj ET"))
    stream = lambda n, body: F.concat(F.lit(f"{n} 0 obj << /Length "), F.length(body).cast("string"), F.lit(" >>\nstream\n"), body, F.lit("\nendstream endobj\n"))
    page = lambda n, content: f"{n} 0 obj << /Type /Page /Parent 2 0 R /Contents {content} 0 R >> endobj\n"
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 >> endobj\n" + page(3, 5) + page(4, 6)
    whole = F.concat(F.lit(head), stream(5, key), stream(6, name), F.lit("trailer << /Root 1 0 R >>\n%%EOF"))
    return PDF.pdf_texts(table(spark, sf, "part").select(c("p_partkey").cast("string").alias("path"), F.encode(whole, "ISO-8859-1").alias("content")))


@query("live", "SELECT 'rescan' AS kind, 9 AS event_id")
def wake_rescan(spark, sf):
    """Work after a wake: one scan, whatever else came."""
    some = W.events(spark, sf).where("event_id < 9").select("path", "flags", c("event_id").cast("long").alias("event_id"), "ts")
    return Y.coalesce(some.unionByName(Y.wake(spark, 50.0, 9))).select("kind", c("event_id").cast("int").alias("event_id"))


@query("files", r"SELECT file_id, 'hashing' AS model, 64 AS dim FROM files WHERE content IS NOT NULL AND regexp_matches(content, '\S')")
def embedded_texts(spark, sf):
    """Texts through the stand-in for an embedding model, which gives unit vectors."""
    out = V1.embed_rows(W.texts(spark, sf).withColumnRenamed("body", "text"), V1.make_provider("hashing"))
    return out.where(F.abs(V.dot(c("vector"), c("vector")) - 1) < 1e-5).select("file_id", "model", "dim")
