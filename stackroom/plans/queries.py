"""Registered queries of the catalogue's own operators, with SQL equivalents where SQL can say them.

Array results are joined into strings and floats rounded, so that results compare as plain values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stackroom.functions import labels as L
from stackroom.functions import paths as P
from stackroom.functions import taxonomy as X
from stackroom.functions import text as T
from stackroom.functions import vectors as V
from stackroom.operators import duplicates as D
from stackroom.operators import groups as G
from stackroom.operators import incremental as I
from stackroom.operators import learning as R
from stackroom.operators import metrics as M
from stackroom.operators import rollups as U
from stackroom.operators import search as S
from stackroom.operators import similarity as C
from stackroom.plans import views as W
from stackroom.plans.registry import query
from stackroom.sources import files as SF
from stackroom.sources import tables as ST
from stackroom.streaming import live as Y
from stackroom.session import table

c = F.col
joined = lambda a: F.array_join(a, ",")


def _vector(spark, sf, vec_id):
    return [float(x) for x in table(spark, sf, "embeddings").where(c("vec_id") == vec_id).first()["embedding"]]


# ---- duplicates -------------------------------------------------------------------------------


_MEMBERS = "SELECT file_id, size, sha256, copies, representative FROM hashes JOIN (SELECT size, sha256, count(*) AS copies, min(file_id) AS representative FROM hashes GROUP BY 1, 2 HAVING count(*) > 1) USING (size, sha256)"


@query("hashes", _MEMBERS)
def exact_dup_groups(spark, sf):
    return D.duplicate_members(W.hashes(spark, sf))


@query("hashes", _MEMBERS)
def staged_dup_groups(spark, sf):
    files = W.files(spark, sf, True).where("content is not null").select("file_id", c("content").cast("binary").alias("content"))
    return D.duplicate_members_staged(files)


@query("hashes", "SELECT size, sha256, count(*) AS copies, string_agg(file_id, ',' ORDER BY file_id) AS members FROM hashes GROUP BY size, sha256 HAVING count(*) > 1")
def dup_member_lists(spark, sf):
    return D.duplicate_groups(W.hashes(spark, sf)).withColumn("members", joined("members"))


@query("hashes", "SELECT h.file_id FROM hashes h JOIN files f USING (file_id) WHERE f.status NOT IN ('missing','unscoped') AND (h.size, h.sha256) IN (SELECT (size, sha256) FROM hashes GROUP BY size, sha256 HAVING count(*) > 1)")
def duplicate_file_ids(spark, sf):
    return D.duplicate_ids(W.hashes(spark, sf), W.files(spark, sf))


@query("hashes", "SELECT size, count(*) AS files FROM hashes GROUP BY size HAVING count(*) > 1")
def size_buckets(spark, sf):
    return D.size_buckets(W.hashes(spark, sf))


@query("hashes", "SELECT count(*) AS duplicate_groups FROM (SELECT 1 FROM hashes h JOIN files f USING (file_id) WHERE f.status='indexed' GROUP BY h.size, h.sha256 HAVING count(*) > 1)")
def duplicate_group_count(spark, sf):
    live = W.files(spark, sf).where("status = 'indexed'").select("file_id")
    return D.duplicate_keys(W.hashes(spark, sf).join(live, "file_id", "left_semi")).agg(F.count("*").alias("duplicate_groups"))


# ---- paths and predicates ---------------------------------------------------------------------


@query("files", "SELECT file_id, path FROM files WHERE path = '/en/src1' OR starts_with(path, '/en/src1/')")
def path_under_root(spark, sf):
    return W.files(spark, sf).where(P.under(c("path"), "/en/src1/")).select("file_id", "path")


_EXCLUDED = "(contains(path, '/node_modules/') OR contains(path, '/bazel-'))"


@query("files", f"SELECT file_id, path FROM files WHERE {_EXCLUDED}")
def excluded_dirs(spark, sf):
    return W.files(spark, sf).where(P.excluded_directory(c("path"))).select("file_id", "path")


@query("files", "SELECT file_id, path FROM files WHERE ends_with(lower(path), '.part')")
def transient_files(spark, sf):
    return W.files(spark, sf).where(P.transient(c("path"))).select("file_id", "path")


@query("files", f"SELECT file_id FROM files WHERE ends_with(path, '.part') OR {_EXCLUDED} OR starts_with(path, '/fr/')")
def live_excluded(spark, sf):
    return W.files(spark, sf).where(P.live_excluded(c("path"), ["/fr"])).select("file_id")


@query("files", "SELECT file_id, kind FROM files")
def kind_labels(spark, sf):
    return W.files(spark, sf).select("file_id", P.kind(c("path")).alias("kind"))


@query("files", "SELECT file_id, CASE WHEN size<1024 THEN 'tiny' WHEN size<102400 THEN 'small' WHEN size<10485760 THEN 'medium' WHEN size<1073741824 THEN 'large' ELSE 'huge' END AS size_class FROM files")
def size_classes(spark, sf):
    return W.files(spark, sf).select("file_id", P.size_class(c("size")).alias("size_class"))


@query("files", "SELECT file_id, array_to_string(list_sort(list_distinct([lower(p) FOR p IN string_split_regex(regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]+$', ''), '[ _\\-.\\[\\]()]') IF length(p) > 1 AND regexp_matches(p, '[a-zA-Z]')])), ',') AS tokens FROM files")
def filename_tokens(spark, sf):
    return W.files(spark, sf).select("file_id", joined(P.filename_tokens(c("path"))).alias("tokens"))


@query("files", "SELECT file_id, regexp_extract(path, '[^/]+$') AS name, regexp_extract(path, '\\.([^./]+)$', 1) AS ext, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS parent FROM files")
def name_parts(spark, sf):
    p = c("path")
    return W.files(spark, sf).select("file_id", P.basename(p).alias("name"), P.extension(p).alias("ext"), P.parent(p).alias("parent"))


@query("files", "SELECT path, 'file_' || substr(sha256(path), 1, 12) AS opaque_id FROM files")
def opaque_ids(spark, sf):
    return W.files(spark, sf).select("path", P.opaque_id(c("path")).alias("opaque_id"))


@query("files", "SELECT file_id, status FROM files WHERE status IN ('pending','missing')")
def files_by_status(spark, sf):
    return W.files(spark, sf).where(c("status").isin("pending", "missing")).select("file_id", "status")


@query("files", "SELECT file_id, path, size, mtime FROM files WHERE path IN (SELECT path FROM files ORDER BY path LIMIT 5)")
def point_lookups(spark, sf):
    files = W.files(spark, sf)
    wanted = files.select("path").orderBy("path").limit(5)
    return files.join(F.broadcast(wanted), "path").select("file_id", "path", "size", "mtime")


@query("files", "SELECT f.file_id, arg_max(r.root, length(r.root)) AS root FROM files f JOIN (VALUES ('/en'),('/en/src1'),('/de'),('/')) r(root) ON r.root='/' OR f.path=r.root OR starts_with(f.path, r.root || '/') GROUP BY f.file_id")
def longest_root(spark, sf):
    roots = spark.createDataFrame([("/en/",), ("/en/src1",), ("/de",), ("/",)], "root string")
    return U.deepest_root(W.files(spark, sf), roots).select("file_id", "root")


@query("files", "SELECT file_id, (size % 3 = 0 AND size % 2 = 1) OR (size % 3 <> 0 AND size > 0 AND size % 7 = 0) AS placeholder FROM files")
def cloud_placeholders(spark, sf):
    size = c("size")
    return W.files(spark, sf).select("file_id", P.cloud_placeholder(size % 3 == 0, F.when(size % 2 == 1, "partial").otherwise("current"), size, size % 7).alias("placeholder"))


# ---- paged views ------------------------------------------------------------------------------


@query("files", "SELECT file_id, path, kind, size, status FROM files WHERE status <> 'unscoped' AND path > '/en/src1' ORDER BY path LIMIT 200")
def files_page(spark, sf):
    return U.files_page(W.files(spark, sf), cursor="/en/src1", limit=200)


@query("files", "SELECT file_id, path, kind, size, status FROM files WHERE status <> 'unscoped' AND kind IN ('audio','video') ORDER BY path LIMIT 25")
def kind_filter_page(spark, sf):
    return U.files_page(W.files(spark, sf), kinds=("audio", "video"), limit=25)


@query("memberships", "SELECT file_id, path, kind, size, status FROM files WHERE status <> 'unscoped' AND file_id IN (SELECT file_id FROM memberships WHERE category_path='School' OR starts_with(category_path, 'School/')) ORDER BY path LIMIT 40")
def category_page(spark, sf):
    return U.files_page(W.files(spark, sf), category="School", memberships=W.memberships(spark, sf), limit=40)


@query("hashes", "SELECT file_id, path, kind, size, status FROM files WHERE status NOT IN ('unscoped','missing') AND file_id IN (SELECT h.file_id FROM hashes h JOIN (SELECT size, sha256 FROM hashes GROUP BY 1,2 HAVING count(*)>1) k USING (size, sha256)) ORDER BY path LIMIT 30")
def duplicates_page(spark, sf):
    return U.files_page(W.files(spark, sf), duplicates_of=W.hashes(spark, sf), limit=30)


@query("classifications", "SELECT f.file_id, path, kind, size, status, confidence FROM (SELECT * FROM files WHERE status<>'unscoped' ORDER BY path LIMIT 50) f LEFT JOIN classifications USING (file_id)")
def classified_page(spark, sf):
    return U.files_page(W.files(spark, sf), W.classifications(spark, sf), limit=50).drop("categories")


@query("inbox classifications", "SELECT i.file_id, f.path, i.reason, c.confidence, i.updated FROM inbox i JOIN files f USING (file_id) JOIN classifications c ON c.file_id=i.file_id WHERE state='open' ORDER BY updated DESC, i.file_id LIMIT 50")
def review_page(spark, sf):
    return U.review_page(W.inbox(spark, sf), W.files(spark, sf), W.classifications(spark, sf)).drop("categories")


# ---- rollups ----------------------------------------------------------------------------------


@query("vectors chunk_vectors", "SELECT (SELECT count(*) FROM files WHERE status='pending') AS pending, (SELECT count(*) FROM files WHERE status='indexed') AS indexed, (SELECT count(*) FROM files WHERE status='missing') AS missing, (SELECT count(*) FROM files WHERE status='failed') AS failed, (SELECT count(*) FROM files WHERE status<>'unscoped') AS total, (SELECT count(*) FROM vectors) AS embedding_rows, (SELECT sum(len(vector)*4)::bigint FROM vectors) AS embedding_bytes, (SELECT count(*) FROM chunk_vectors) AS embedding_chunk_rows, (SELECT sum(len(vector)*4)::bigint FROM chunk_vectors) AS embedding_chunk_bytes")
def status_counts(spark, sf):
    return U.status_counts(W.files(spark, sf), W.vectors(spark, sf), W.chunk_vectors(spark, sf))


@query("inbox", "SELECT count(*) FILTER (state='open') AS open, count(*) FILTER (state='resolved') AS resolved FROM inbox")
def review_summary(spark, sf):
    return U.review_summary(W.inbox(spark, sf))


@query("inbox", "SELECT file_id, reason FROM inbox")
def review_inbox_rule(spark, sf):
    return U.review_inbox(W.classifications(spark, sf)).select("file_id", "reason")


@query("inbox memberships exact", "SELECT (SELECT count(*) FROM files WHERE status<>'unscoped') AS total, (SELECT count(*) FROM files WHERE status='indexed') AS indexed, (SELECT count(*) FROM files WHERE status='missing') AS missing, (SELECT count(*) FROM inbox WHERE state='open') AS review, (SELECT count(*) FROM (SELECT DISTINCT array_to_string(string_split(category_path,'/')[1:n],'/') p FROM memberships, range(1,5) r(n) WHERE n <= len(string_split(category_path,'/'))) WHERE p<>'Review') AS categories, (SELECT count(*) FROM (SELECT 1 FROM hashes h JOIN files f USING (file_id) WHERE f.status='indexed' GROUP BY h.size,h.sha256 HAVING count(*)>1)) AS duplicate_groups, (SELECT count(*) FROM exact) AS graph_edges")
def dashboard(spark, sf):
    m = W.memberships(spark, sf)
    edges = C.exact_edge_count(W.hashes(spark, sf).select(c("file_id").alias("id"), c("sha256").alias("exact_hash")))
    return U.dashboard(W.files(spark, sf), W.inbox(spark, sf), G.ensure_categories(m), W.hashes(spark, sf), edges)


@query("files", "SELECT kind, count(*) AS files FROM files WHERE starts_with(path, '/en/') GROUP BY kind ORDER BY files DESC, kind LIMIT 16")
def kind_histogram(spark, sf):
    return U.kind_histogram(W.files(spark, sf), "/en")


@query(
    "inbox vectors chunk_vectors",
    """, r AS (SELECT root, f.* FROM files f JOIN (VALUES ('/en'),('/de'),('/en/src1')) v(root) ON starts_with(f.path, v.root || '/') WHERE status<>'unscoped'),
 st AS (SELECT file_id, count(*) AS n, sum(len(vector)*4)::bigint AS b FROM (SELECT file_id, vector FROM vectors UNION ALL SELECT file_id, vector FROM chunk_vectors) GROUP BY 1),
 k AS (SELECT root, kind, count(*) AS n FROM r GROUP BY 1,2)
 SELECT r.root, count(*) AS files, count(*) FILTER (status='indexed') AS indexed, count(*) FILTER (status='missing') AS missing, count(*) FILTER (r.file_id IN (SELECT file_id FROM inbox WHERE state='open')) AS review, count(st.n) AS with_vectors, coalesce(sum(st.n),0)::bigint AS vector_rows, coalesce(sum(st.b),0)::bigint AS vector_bytes,
 count(*)::varchar || ' files, ' || count(*) FILTER (status='indexed')::varchar || ' indexed, ' || count(*) FILTER (status='missing')::varchar || ' missing, ' || count(*) FILTER (r.file_id IN (SELECT file_id FROM inbox WHERE state='open'))::varchar || ' to review: ' || (SELECT string_agg(n::varchar || ' ' || kind, ', ' ORDER BY n DESC, kind) FROM k WHERE k.root=r.root) AS summary
 FROM r LEFT JOIN st USING (file_id) GROUP BY r.root""",
)
def project_summary(spark, sf):
    return U.project_summary(W.files(spark, sf), W.inbox(spark, sf), W.vectors(spark, sf), W.chunk_vectors(spark, sf), ["/en", "/de/", "/en/src1"]).drop("kind_counts")


@query("vectors chunk_vectors", "SELECT count(*) AS files, sum(n)::bigint AS rows, max(n) AS max_rows FROM (SELECT file_id, count(*) AS n FROM (SELECT file_id FROM vectors UNION ALL SELECT file_id FROM chunk_vectors) GROUP BY 1)")
def storage_metrics(spark, sf):
    return U.fan_out(W.vectors(spark, sf), W.chunk_vectors(spark, sf))


_COVER = """, r AS (SELECT root, f.*, f.file_id IN (SELECT file_id FROM inbox WHERE state='open') AS open, CASE WHEN starts_with(path,'/en/src2/') THEN 'excluded-prefix:src2' WHEN contains(path,'/node_modules/') THEN 'excluded-directory:node_modules' END AS reason FROM files f JOIN (VALUES ('/en'),('/fr')) v(root) ON starts_with(f.path, v.root || '/') WHERE status<>'unscoped')"""


@query("inbox", _COVER + " SELECT root, count(*) FILTER (reason IS NULL) AS eligible, count(*) FILTER (reason IS NULL AND status='indexed') AS indexed, count(*) FILTER (reason IS NULL AND open) AS review, count(*) FILTER (reason IS NULL AND status='missing') AS missing, count(*) FILTER (reason IS NOT NULL) AS skipped, count(*) FILTER (reason='excluded-prefix:src2') AS by_prefix, count(*) FILTER (reason='excluded-directory:node_modules') AS by_directory FROM r GROUP BY root")
def root_coverage(spark, sf):
    rows = U.coverage(W.files(spark, sf), W.inbox(spark, sf), ["/en", "/fr"], ["/en/src2"])[1]
    n = lambda k: F.coalesce(F.try_element_at("reasons", F.lit(k)), F.lit(0).cast("long"))
    return rows.select("root", "eligible", "indexed", "review", "missing", "skipped", n("excluded-prefix:src2").alias("by_prefix"), n("excluded-directory:node_modules").alias("by_directory"))


@query("inbox", _COVER + " SELECT 2 AS authorized_roots, 1 AS excluded_roots, count(*) FILTER (reason IS NULL) AS eligible, count(*) FILTER (reason IS NULL AND status='indexed') AS indexed, count(*) FILTER (reason IS NULL AND open) AS review, count(*) FILTER (reason IS NULL AND status='missing') AS missing, count(*) FILTER (reason IS NOT NULL) AS skipped FROM r")
def coverage_overall(spark, sf):
    return U.coverage(W.files(spark, sf), W.inbox(spark, sf), ["/en", "/fr"], ["/en/src2"])[0]


# ---- text -------------------------------------------------------------------------------------


@query("tokens", "SELECT file_id, len(t)::int AS tokens FROM toks")
def token_counts(spark, sf):
    return W.texts(spark, sf).select("file_id", F.size(T.tokens(c("body"))).alias("tokens"))


_PHRASE = "in the"
_TF = "len([i FOR i IN range(1, len(t)) IF t[i]='in' AND t[i+1]='the'])"


@query("tokens", f"SELECT file_id, {_TF}::int AS tf, len(t)::int AS length FROM toks WHERE {_TF} > 0")
def phrase_hits(spark, sf):
    return S.phrase_hits(W.texts(spark, sf), _PHRASE).select("file_id", "tf", "length")


@query("tokens", f"SELECT file_id, {_TF}::int AS tf, len(t)::int AS length FROM toks WHERE {_TF} > 0")
def phrase_from_index(spark, sf):
    return S.phrase_from_postings(S.postings(W.texts(spark, sf)), _PHRASE)


def _rank(src: str) -> str:
    return f"(SELECT file_id, status, path, round(-(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(1-0.75+0.75*len/avgl))),6) AS rank FROM (SELECT file_id, status, path, {_TF} AS tf, len(t) AS len FROM {src}) x, (SELECT count(*) AS n, avg(len(t)) AS avgl, count(*) FILTER ({_TF}>0) AS df FROM {src}) WHERE tf>0)"


@query("tokens", f"SELECT file_id, rank FROM {_rank('toks')} ORDER BY rank, file_id LIMIT 50")
def bm25_search(spark, sf):
    return S.bm25_search(W.texts(spark, sf), _PHRASE).select("file_id", "rank")


_MERGED = f"""SELECT file_id, path, src, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY src, rank) AS k FROM (SELECT file_id, path, 0 AS src, rank FROM {_rank('toks')} WHERE status='indexed' UNION ALL SELECT file_id, path, 1 AS src, rank FROM {_rank('spoken')} WHERE status='indexed')) WHERE k=1 ORDER BY src, rank, file_id LIMIT 50"""


@query("tokens spoken", _MERGED)
def merged_search(spark, sf):
    return S.exact_search(W.files(spark, sf), W.texts(spark, sf), W.transcripts(spark, sf), _PHRASE).drop("snippet")


@query("tokens spoken memberships classifications hashes", f"SELECT file_id, path, src, rank FROM ({_MERGED}) WHERE file_id IN (SELECT file_id FROM memberships WHERE category_path='Documents/Text') AND file_id IN (SELECT file_id FROM classifications WHERE confidence < 0.58)")
def filtered_search(spark, sf):
    filters = [S.Filter.category(W.memberships(spark, sf), "Documents/Text"), S.Filter.low_confidence(W.classifications(spark, sf), 0.58)]
    return S.filtered_search(W.files(spark, sf), W.texts(spark, sf), W.transcripts(spark, sf), _PHRASE, filters).drop("snippet")


@query("tokens spoken hashes", f"SELECT m.file_id, m.path, src, rank FROM ({_MERGED}) m JOIN files f USING (file_id) WHERE f.mtime > 1700001000 AND f.mtime < 1700900000 AND f.kind IN ('text','pdf','office','archive','audio') AND m.file_id IN (SELECT h.file_id FROM hashes h JOIN (SELECT size, sha256 FROM hashes GROUP BY 1,2 HAVING count(*)>1) k USING (size, sha256))")
def date_kind_duplicate_search(spark, sf):
    files = W.files(spark, sf)
    filters = [S.Filter.after(files, 1700001000), S.Filter.before(files, 1700900000), S.Filter.kind(files, "text", "pdf", "office", "archive", "audio"), S.Filter.duplicates(W.hashes(spark, sf))]
    return S.filtered_search(files, W.texts(spark, sf), W.transcripts(spark, sf), _PHRASE, filters).drop("snippet")


_CUT = "greatest(0, least(p - 5, n - 12))"


@query("tokens", f", hit AS (SELECT r.file_id, t, len(t) AS n, list_filter(range(0, len(t)-1), lambda i: t[i+1]='in' AND t[i+2]='the')[1] AS p FROM (SELECT file_id, rank FROM {_rank('toks')} ORDER BY rank, file_id LIMIT 50) r JOIN toks USING (file_id)) SELECT file_id, CASE WHEN {_CUT} > 0 THEN '…' ELSE '' END || array_to_string([CASE WHEN i = p THEN '[' ELSE '' END || t[i+1] || CASE WHEN i = p+1 THEN ']' ELSE '' END FOR i IN range({_CUT}, least(n, {_CUT}+12))], ' ') || CASE WHEN {_CUT} + 12 < n THEN '…' ELSE '' END AS snippet FROM hit")
def snippets(spark, sf):
    return S.bm25_search(W.texts(spark, sf), _PHRASE).select("file_id", "snippet")


@query("transcripts", "SELECT file_id, string_agg(text, ' ' ORDER BY start, text) AS text FROM transcripts GROUP BY file_id")
def transcript_text(spark, sf):
    return S.transcript_text(W.transcripts(spark, sf))


@query("transcripts", """SELECT start, "end", text FROM transcripts WHERE file_id=(SELECT file_id FROM files WHERE doc_id=3) ORDER BY start""")
def ordered_segments(spark, sf):
    files = W.files(spark, sf).where("doc_id = 3").select("file_id")
    return W.transcripts(spark, sf).join(files, "file_id", "left_semi").select("start", "end", "text").orderBy("start")


@query("transcripts", "SELECT DISTINCT file_id FROM transcripts WHERE trim(text) <> ''")
def files_with_transcripts(spark, sf):
    t = W.transcripts(spark, sf)
    return S.has_transcript(t, t.where(F.trim("text") != "").select("file_id", "text"))


_CHUNKS = r"""SELECT file_id, k AS chunk, part FROM (SELECT file_id, k, regexp_replace(substr(b, (k*780+1)::bigint, 900), '^\s+|\s+$', '', 'g') AS part FROM (SELECT file_id, b, unnest(range(0, CASE WHEN length(b) <= 900 THEN 1 ELSE ceil((length(b)-900)/780.0)::bigint+1 END)) AS k FROM (SELECT file_id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS b FROM files WHERE content IS NOT NULL))) WHERE part <> ''"""


@query("files", f"SELECT file_id, md5(part) AS part FROM ({_CHUNKS})")
def chunk_text(spark, sf):
    return W.texts(spark, sf).select("file_id", F.explode(T.chunks(c("body"))).alias("part")).select("file_id", F.md5("part").alias("part"))


@query("files", f"SELECT file_id, count(*)::int AS chunks FROM ({_CHUNKS}) GROUP BY file_id")
def chunk_counts(spark, sf):
    return W.texts(spark, sf).select("file_id", F.size(T.chunks(c("body"))).alias("chunks")).where("chunks > 0")


@query("files", r"SELECT file_id, CASE WHEN regexp_replace(content, '^\s+|\s+$', '', 'g') = '' THEN 'skip' WHEN regexp_extract(path, '\.([^./]+)$', 1) IN ('py','html') THEN 'source' ELSE 'prose' END AS strategy FROM files WHERE content IS NOT NULL")
def compaction_route(spark, sf):
    return W.files(spark, sf, True).where("content is not null").select("file_id", T.compaction_strategy(c("path"), c("content")).alias("strategy"))


@query("files", r"SELECT file_id, length(regexp_replace(content, '^\s+|\s+$', '', 'g')[1:4000])::int AS primary_chars, least(6, CASE WHEN length(regexp_replace(content, '^\s+|\s+$', '', 'g')) <= 900 THEN 1 ELSE ceil((length(regexp_replace(content, '^\s+|\s+$', '', 'g'))-900)/780.0)+1 END)::int AS chunks FROM files WHERE content IS NOT NULL AND regexp_replace(content, '^\s+|\s+$', '', 'g') <> '' AND regexp_extract(path, '\.([^./]+)$', 1) NOT IN ('py','html')")
def compacted_prose(spark, sf):
    k = W.files(spark, sf, True).where("content is not null").select("file_id", T.compacted(c("path"), c("content")).alias("k")).where("k.strategy = 'prose'")
    return k.select("file_id", F.length("k.primary").alias("primary_chars"), F.size("k.chunks").alias("chunks"))


_BODY = r"regexp_replace(html, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_DECLARED = f"array_to_string([substr(trim(l), 1, 220) FOR l IN string_split(b, chr(10)) IF regexp_matches(lower(trim(l)), '^({'|'.join(T.DECLARATIONS)})')], chr(10))"


@query(None, f"SELECT page_id, md5(substr('file: ' || regexp_extract(url, '[^/]*$') || chr(10) || 'head:' || chr(10) || substr(b, 1, 2400) || chr(10) || 'declarations:' || chr(10) || {_DECLARED} || chr(10) || 'tail:' || chr(10) || CASE WHEN length(b) < 800 THEN b ELSE right(b, 800) END, 1, 4000)) AS capsule FROM (SELECT page_id, url, {_BODY} AS b FROM pages)")
def page_capsules(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.source_capsule(c("url"), c("html"))).alias("capsule"))


@query("files", "SELECT file_id, substr(content, 1, 8000) AS sample, length(trim(content)) < 50 AS needs_ocr, CASE WHEN size>0 THEN round(strlen(content)/size::double, 6) ELSE 0 END AS density FROM files WHERE content IS NOT NULL")
def text_samples(spark, sf):
    t = c("content")
    return W.files(spark, sf, True).where("content is not null").select("file_id", SF.text_sample(t.cast("binary")).alias("sample"), T.needs_ocr(t).alias("needs_ocr"), F.round(T.text_density(t, c("size")), 6).alias("density"))


@query("files", "SELECT file_id, substr(content, 1, 100) AS head, substr(content, 51, 20) AS part, sha256(content) AS digest, replace(content, chr(10), ' ') AS flat FROM files WHERE content IS NOT NULL")
def bounded_reads(spark, sf):
    t = c("content")
    return W.files(spark, sf, True).where("content is not null").select("file_id", SF.head(t, 100).alias("head"), SF.read_slice(t, 50, 20).alias("part"), F.sha2(t, 256).alias("digest"), T.flatten_newlines(t).alias("flat"))


@query("live", "SELECT event_id, round((date_part('hour', ts)*3600 + date_part('minute', ts)*60 + date_part('second', ts))::double, 3) AS seconds FROM live l JOIN events USING (event_id)".replace("live l JOIN events USING (event_id)", "live"))
def clock_stamps(spark, sf):
    stamp = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(",000"))
    return W.events(spark, sf).select("event_id", F.round(T.clock_seconds(stamp), 3).alias("seconds"))


# ---- vectors ----------------------------------------------------------------------------------

_COS = "greatest(-1.0, least(1.0, list_dot_product({a}::double[], {b}::double[])))"
_QUERY7 = "(SELECT embedding FROM embeddings WHERE vec_id=7)"


@query("vectors", f"SELECT v.file_id, f.path, round({_COS.format(a='v.vector', b='q.e')}, 6) AS score FROM vectors v JOIN files f USING (file_id), (SELECT embedding AS e FROM embeddings WHERE vec_id=7) q WHERE model='m0' AND status='indexed' AND {_COS.format(a='v.vector', b='q.e')} >= 0.1 ORDER BY score DESC, path LIMIT 20")
def cosine_topk(spark, sf):
    hits = S.semantic_search(W.files(spark, sf), W.vectors(spark, sf), None, _vector(spark, sf, 7), model="m0", threshold=0.1)
    return hits.withColumn("score", F.round("score", 6))


@query("vectors chunk_vectors", f", s AS (SELECT file_id, model, vector FROM vectors UNION ALL SELECT file_id, model, vector FROM chunk_vectors) SELECT file_id, path, round(score,6) AS score FROM (SELECT s.file_id, max({_COS.format(a='s.vector', b='q.e')}) AS score FROM s, (SELECT embedding AS e FROM embeddings WHERE vec_id=7) q WHERE model='m0' GROUP BY 1) JOIN files USING (file_id) WHERE status='indexed' AND score >= 0.05 ORDER BY score DESC, path LIMIT 20")
def semantic_max_chunk(spark, sf):
    hits = S.semantic_search(W.files(spark, sf), W.vectors(spark, sf), W.chunk_vectors(spark, sf), _vector(spark, sf, 7), model="m0", threshold=0.05)
    return hits.withColumn("score", F.round("score", 6))


@query("vectors", f"SELECT v.file_id, f.path, round({_COS.format(a='v.vector', b='q.e')}, 6) AS score FROM vectors v JOIN files f USING (file_id), (SELECT embedding AS e FROM embeddings WHERE vec_id=9) q WHERE model='m1' AND status='indexed' AND {_COS.format(a='v.vector', b='q.e')} >= 0.08 ORDER BY score DESC, path LIMIT 20")
def joint_space_topk(spark, sf):
    hits = S.semantic_search(W.files(spark, sf), W.vectors(spark, sf), None, _vector(spark, sf, 9), model="m1", threshold=0.08)
    return hits.withColumn("score", F.round("score", 6))


_BYTES = "[(round((x+1)*100))::double FOR x IN {v}]"


@query("vectors", f", b AS (SELECT file_id, [floor((x+1)*100)::double FOR x IN vector] AS f, doc_id FROM vectors), q AS (SELECT [floor((x+1)*100)::double FOR x IN embedding] AS g FROM embeddings WHERE vec_id=7) SELECT b.file_id, path, round(1 - list_dot_product(f,g)/65025.0/((sqrt(list_dot_product(f,f))/255)*(sqrt(list_dot_product(g,g))/255)), 6) AS distance FROM b JOIN files USING (file_id), q WHERE status='indexed' AND 1 - list_dot_product(f,g)/65025.0/((sqrt(list_dot_product(f,f))/255)*(sqrt(list_dot_product(g,g))/255)) <= 0.5 ORDER BY distance, path LIMIT 20")
def feature_print_search(spark, sf):
    byte = lambda v: F.transform(v, lambda x: F.floor((x + 1) * 100).cast("double"))
    features = W.vectors(spark, sf).select("file_id", byte("vector").alias("feature"))
    q = table(spark, sf, "embeddings").where("vec_id = 7").select(byte("embedding").alias("g")).first()["g"]
    return S.feature_search(W.files(spark, sf), features, q).withColumn("distance", F.round("distance", 6))


@query("vectors", "SELECT file_id, round(sqrt(list_dot_product([x::double/n FOR x IN vector], [x::double/n FOR x IN vector])), 6) AS norm FROM (SELECT file_id, vector, sqrt(list_dot_product(vector::double[], vector::double[])) AS n FROM vectors)")
def l2_normalized(spark, sf):
    n = V.l2_normalize(c("vector"))
    return W.vectors(spark, sf).select("file_id", n.alias("n")).select("file_id", F.round(F.sqrt(V.dot(c("n"), c("n"))), 6).alias("norm"))


@query(None, "SELECT round(avg((l = label)::int), 6) AS recall_at_1 FROM (SELECT t.label, arg_max(o.label, struct_pack(s := list_dot_product(t.e, o.e) / (sqrt(list_dot_product(t.e, t.e)) * sqrt(list_dot_product(o.e, o.e))), b := -o.vec_id)) AS l FROM (SELECT label, arg_min(embedding::double[], vec_id) AS e FROM embeddings WHERE label IS NOT NULL GROUP BY label) t, (SELECT vec_id, label, embedding::double[] AS e FROM embeddings WHERE vec_id NOT IN (SELECT min(vec_id) FROM embeddings WHERE label IS NOT NULL GROUP BY label)) o GROUP BY t.label)")
def cosine_matrix_recall(spark, sf):
    """The first vector of each label against all other vectors of the table."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", c("embedding").alias("vector"))
    labels = (e.agg(F.max("label")).first()[0] or 0) + 2  # the last number is for vectors without a label
    first = e.where("label is not null").groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").alias("vec_id"))
    others = e.join(first.select("vec_id"), "vec_id", "left_anti").select((c("vec_id") * labels + F.coalesce("label", F.lit(labels - 1))).alias("column"), "vector")
    return S.cosine_matrix_recall(first.select("label", "vector"), others, labels).withColumn("recall_at_1", F.round("recall_at_1", 6))


# ---- similarity graph -------------------------------------------------------------------------


@query("exact", "SELECT a, b, 1.0::double AS score FROM exact")
def exact_edges(spark, sf):
    return C.exact_edges(W.hashes(spark, sf).select(c("file_id").alias("id"), c("sha256").alias("exact_hash"))).select("a", "b", "score")


_SEM = "sem AS (SELECT x.file_id AS a, y.file_id AS b, x.model, greatest(-1.0, least(1.0, list_dot_product(x.vector::double[], y.vector::double[]))) AS score FROM vectors x JOIN vectors y ON x.model=y.model AND x.file_id<y.file_id)"


@query("vectors", f", {_SEM} SELECT a, b, round(score,6) AS score, 'embedding:' || model AS signal FROM sem WHERE score >= 0.30")
def semantic_edges(spark, sf):
    return C.embedding_edges(W.vectors(spark, sf).select(c("file_id").alias("id"), "model", "vector"), threshold=0.30).select("a", "b", F.round("score", 6).alias("score"), "signal")


@query("vectors", f", {_SEM} SELECT a, b, round(score,6) AS score FROM sem WHERE score >= 0.30 AND (a IN (SELECT file_id FROM files WHERE doc_id%10=0) OR b IN (SELECT file_id FROM files WHERE doc_id%10=0))")
def incremental_edges(spark, sf):
    v = W.vectors(spark, sf)
    changed = v.where("doc_id % 10 = 0").select(c("file_id").alias("id"))
    found = C.embedding_edges(v.select(c("file_id").alias("id"), "model", "vector"), threshold=0.30, changed=changed)
    return C.canonical(found).select("a", "b", F.round("score", 6).alias("score"))


_FEAT = "fp AS (SELECT file_id, [floor(x*2)::int FOR x IN vector] AS f FROM vectors), fe AS (SELECT x.file_id AS a, y.file_id AS b, len([i FOR i IN range(1,len(x.f)+1) IF x.f[i]=y.f[i]])/len(x.f)::double AS score FROM fp x JOIN fp y ON x.file_id<y.file_id)"


@query("vectors", f", {_FEAT} SELECT a, b, score::double AS score FROM fe WHERE score >= 0.7")
def feature_print_edges(spark, sf):
    nodes = W.vectors(spark, sf).select(c("file_id").alias("id"), F.transform("vector", lambda x: F.floor(x * 2).cast("int")).alias("feature"))
    return C.feature_edges(nodes, threshold=0.7).select("a", "b", "score")


@query("vectors exact", f", {_SEM} SELECT a, b, relation, signal, round(max(score),6) AS score FROM (SELECT a,b,'nearDuplicate' AS relation,'exactHash' AS signal,1.0::double AS score FROM exact UNION ALL SELECT a,b,'semantic','embedding:'||model,score FROM sem WHERE score>=0.30) GROUP BY 1,2,3,4")
def edge_dedupe(spark, sf):
    exact = C.exact_edges(W.hashes(spark, sf).select(c("file_id").alias("id"), c("sha256").alias("exact_hash")))
    sem = C.embedding_edges(W.vectors(spark, sf).select(c("file_id").alias("id"), "model", "vector"), threshold=0.30)
    flipped = sem.select(c("b").alias("a"), c("a").alias("b"), (c("score") - 0.1).alias("score"), "relation", "signal")
    return C.build_edges(exact, sem, flipped).withColumn("score", F.round("score", 6))


def _families(spark, sf):
    exact = C.exact_family_edges(W.hashes(spark, sf).select(c("file_id").alias("id"), c("sha256").alias("exact_hash")))
    sem = C.embedding_edges(W.vectors(spark, sf).select(c("file_id").alias("id"), "model", "vector"), threshold=0.40)
    return C.clusters(exact.unionByName(sem), min_score=0.40)


_COMP = f""", {_SEM}, e AS (SELECT 'nearDuplicate' AS relation, a, b, 1.0::double AS score, 'exactHash' AS signal FROM (SELECT min(file_id) OVER (PARTITION BY sha256) AS a, file_id AS b FROM hashes) WHERE a<>b UNION ALL SELECT 'semantic', a, b, score, 'embedding:' || model FROM sem WHERE score >= 0.40),
 sym AS (SELECT relation, a, b FROM e UNION SELECT relation, b, a FROM e),
 reach(relation, a, b) AS (SELECT relation, a, b FROM sym UNION SELECT r.relation, r.a, s.b FROM reach r JOIN sym s ON s.relation=r.relation AND s.a=r.b),
 comp AS (SELECT relation, a AS node, least(a, min(b)) AS root FROM reach GROUP BY relation, a)"""


@query("vectors hashes", _COMP + " SELECT relation, root AS first, count(*)::int AS members FROM comp GROUP BY 1,2", recursive=True)
def components(spark, sf):
    return _families(spark, sf).select("relation", F.get("members", 0).alias("first"), F.size("members").alias("members"))


_DEG = ", deg AS (SELECT relation, node, sum(score) AS d FROM (SELECT relation, a AS node, score FROM e UNION ALL SELECT relation, b, score FROM e) GROUP BY 1,2)"


@query("vectors hashes", _COMP + _DEG + " SELECT relation, root AS first, node AS representative FROM (SELECT c.relation, root, c.node, row_number() OVER (PARTITION BY c.relation, root ORDER BY round(d,9) DESC, c.node) AS k FROM comp c JOIN deg USING (relation, node)) WHERE k=1", recursive=True)
def representatives(spark, sf):
    return _families(spark, sf).select("relation", F.get("members", 0).alias("first"), "representative")


@query("vectors hashes", _COMP + " SELECT c.relation, root AS first, round(min(score),6) AS confidence, 'connected by ' || arg_max(signal, struct_pack(s := score, g := signal)) AS reason FROM e JOIN comp c ON c.relation=e.relation AND c.node=e.a GROUP BY 1,2", recursive=True)
def cluster_reason(spark, sf):
    return _families(spark, sf).select("relation", F.get("members", 0).alias("first"), F.round("confidence", 6).alias("confidence"), "reason")


@query("vectors hashes", _COMP + " SELECT relation, substr(sha256(relation || '|' || string_agg(node, '|' ORDER BY node)), 1, 16) AS id FROM comp GROUP BY relation, root", recursive=True)
def cluster_ids(spark, sf):
    return _families(spark, sf).select("relation", "id")


@query("vectors hashes", _COMP + " SELECT id, relation, members FROM (SELECT relation, substr(sha256(relation || '|' || string_agg(node, '|' ORDER BY node)), 1, 16) AS id, count(*)::int AS members FROM comp GROUP BY relation, root) WHERE id > '4' ORDER BY id LIMIT 20", recursive=True)
def clusters_page(spark, sf):
    return U.clusters_page(_families(spark, sf), cursor="4", limit=20).select("id", "relation", F.size("members").alias("members"))


@query("hashes vectors classifications", "SELECT f.file_id AS id, h.sha256 AS exact_hash, coalesce(v.model, '') AS models, coalesce(round(v.vector[1]::double, 6), 0) AS first, coalesce(array_to_string([floor(x*2)::int FOR x IN v.vector], ','), '') AS feature, coalesce(c.confidence, 0) AS confidence FROM files f LEFT JOIN hashes h USING (file_id) LEFT JOIN vectors v ON v.file_id=f.file_id LEFT JOIN classifications c ON c.file_id=f.file_id WHERE f.status='indexed'")
def wide_nodes(spark, sf):
    v = W.vectors(spark, sf)
    features = v.select("file_id", F.transform("vector", lambda x: F.floor(x * 2).cast("int")).alias("feature"))
    n = C.wide_nodes(W.files(spark, sf), W.hashes(spark, sf), features, v, W.classifications(spark, sf))
    names = F.map_keys("embeddings")
    first = F.get(F.get(F.map_values("embeddings"), 0), 0).cast("double")
    return n.select("id", "exact_hash", F.coalesce(joined(names), F.lit("")).alias("models"), F.coalesce(F.round(first, 6), F.lit(0.0)).alias("first"), F.coalesce(joined(F.transform("feature", lambda x: x.cast("string"))), F.lit("")).alias("feature"), "confidence")


def _graph(spark, sf):
    m = W.memberships(spark, sf)
    clusters = C.clusters(C.exact_family_edges(W.hashes(spark, sf).select(c("file_id").alias("id"), c("sha256").alias("exact_hash"))))
    return C.organization_graph(W.files(spark, sf), m, W.inbox(spark, sf).where("state = 'open'"), clusters)


_GRAPH = """, fam AS (SELECT 'cluster:' || substr(sha256('nearDuplicate|' || string_agg(file_id, '|' ORDER BY file_id)), 1, 16) AS id, list(file_id) AS members FROM hashes GROUP BY sha256 HAVING count(*)>1),
 ge AS (SELECT 'file:'||file_id AS source_id, 'category:Missing' AS target_id, 'missing' AS relation FROM files WHERE status='missing' UNION ALL SELECT 'file:'||file_id, 'category:Review', 'review' FROM inbox WHERE state='open' UNION ALL SELECT 'file:'||file_id, 'category:'||category_path, 'category' FROM memberships UNION ALL SELECT 'file:'||unnest(members), id, 'duplicate' FROM fam)"""


@query("memberships inbox hashes", _GRAPH + " SELECT source_id, target_id, relation, 1.0::double AS weight FROM ge GROUP BY 1,2,3")
def org_graph_edges(spark, sf):
    return _graph(spark, sf)[1]


@query("memberships inbox hashes", _GRAPH + " SELECT 'file:'||file_id AS id, regexp_extract(path,'[^/]+$') AS label, kind FROM files UNION ALL SELECT DISTINCT target_id, replace(target_id,'category:',''), CASE WHEN relation='category' OR target_id='category:Review' THEN 'category' ELSE 'status' END FROM ge WHERE relation<>'duplicate' UNION ALL SELECT id, 'Near-duplicate family', 'similarity' FROM fam")
def org_graph_nodes(spark, sf):
    return _graph(spark, sf)[0]


@query("memberships inbox hashes", _GRAPH + ", n AS (SELECT 'file:'||file_id AS id FROM files UNION SELECT target_id FROM ge) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT (source_id, target_id, relation)) FROM ge) AS edges")
def graph_stats(spark, sf):
    nodes, edges = _graph(spark, sf)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


# ---- classification ---------------------------------------------------------------------------


@query("memberships", "SELECT file_id, string_agg(category_path, ',' ORDER BY category_path) AS categories FROM memberships GROUP BY file_id")
def classified_categories(spark, sf):
    k = L.classify(c("path"), c("kind"), c("content"))
    return W.files(spark, sf, True).select("file_id", joined(F.array_sort(k["categories"])).alias("categories"))


@query("files", "SELECT file_id, round(least(0.99, 0.55 + CASE WHEN doc_id%7=0 THEN 0.1 ELSE 0 END + CASE WHEN doc_id%10=4 AND doc_id%53<>0 THEN 0.15 ELSE 0 END + CASE WHEN doc_id%10=3 AND doc_id%53<>0 AND doc_id%11=0 AND doc_id%7<>0 THEN 0.1 ELSE 0 END), 6)::double AS confidence FROM files")
def classified_confidence(spark, sf):
    k = L.classify(c("path"), c("kind"), c("content"))
    return W.files(spark, sf, True).select("file_id", F.round(k["confidence"], 6).alias("confidence"))


@query("files", r"SELECT file_id, array_to_string(list_sort(list_distinct([upper(substr(x,1,3)) || '-' || regexp_extract(x, '[0-9]+') FOR x IN regexp_extract_all(' ' || lower(path) || ' ', '[^a-z0-9]((?:art|bio|bus|chm|com|csc|eco|eng|fre|his|mat|phy|psy|soc|spa)[ _-]?[0-9]{3,4})[^a-z0-9]', 1)])), ',') AS courses FROM files")
def course_codes(spark, sf):
    return W.files(spark, sf).select("file_id", joined(L.courses(F.lower("path"))).alias("courses"))


@query("files", "SELECT file_id FROM files WHERE doc_id%10=4 AND doc_id%53<>0")
def code_projects(spark, sf):
    return W.files(spark, sf).where(L.code_project(c("path"))).select("file_id")


_MIX = "(lower(content) || CASE WHEN doc_id%3=0 THEN ' canvas' ELSE '' END || CASE WHEN doc_id%6=0 THEN ' assignment' ELSE '' END || CASE WHEN doc_id%20=1 THEN ' moodle' ELSE '' END)"


@query("files", f"SELECT file_id, contains(t,'blackboard') OR contains(t,'moodle') OR contains(t,'instructure') OR (contains(t,'canvas') AND (contains(t,'course') OR contains(t,'module') OR contains(t,'assignment'))) AS lms, contains(t,'worksheet') OR contains(t,'assignment') OR contains(t,'homework') AS assignment FROM (SELECT file_id, {_MIX} AS t FROM files WHERE content IS NOT NULL)")
def lms_assignment(spark, sf):
    i = c("doc_id")
    t = F.concat(F.lower("content"), F.when(i % 3 == 0, " canvas").otherwise(""), F.when(i % 6 == 0, " assignment").otherwise(""), F.when(i % 20 == 1, " moodle").otherwise(""))
    return W.files(spark, sf, True).where("content is not null").withColumn("t", t).select("file_id", L.lms_context(c("t")).alias("lms"), L.assignment_word(c("t")).alias("assignment"))


@query("classifications", "SELECT file_id, CASE WHEN confidence>=0.8 THEN 'confident' WHEN confidence>=0.45 THEN 'ambiguous' ELSE 'unknown' END AS band FROM classifications")
def confidence_bands(spark, sf):
    return W.classifications(spark, sf).select("file_id", L.confidence_band(c("confidence")).alias("band"))


@query("files", "SELECT file_id, doc_id%4<>1 AND doc_id%6<>2 AND doc_id%9<>3 AS ok FROM files")
def contract_reject(spark, sf):
    i = c("doc_id")
    cats = F.array(F.lit("Documents/Text"), F.when(i % 4 == 1, "a/../b").otherwise("Plain"))
    reasons = F.when(i % 6 == 2, F.array(F.repeat(F.lit("x"), 65))).otherwise(F.array(F.lit("kind:text")))
    conf = F.when(i % 9 == 3, 1.5).otherwise(0.5)
    return W.files(spark, sf).select("file_id", L.contract_ok(c("file_id"), cats, F.lit("d"), reasons, conf).alias("ok"))


_SHOT_SCORE = "(CASE WHEN doc_id%11=0 AND doc_id%7<>0 THEN 0.20 ELSE 0 END + CASE WHEN doc_id%2=0 THEN 0.35 ELSE 0 END + CASE WHEN doc_id%5=0 THEN 0.10+2*0.04 ELSE 0 END + CASE WHEN doc_id%5=0 THEN 0.10 ELSE 0 END)"


@query("files", f"SELECT file_id, round({_SHOT_SCORE},6) >= 0.40 AS is_screenshot, CASE WHEN round({_SHOT_SCORE},6) >= 0.40 THEN CASE WHEN doc_id%5=0 THEN 'social' ELSE 'reference' END ELSE 'unknown' END AS subtype, round(CASE WHEN round({_SHOT_SCORE},6) >= 0.40 THEN least(0.99, 0.35+0.60*{_SHOT_SCORE}+CASE WHEN doc_id%5=0 THEN 0.15 ELSE 0 END) ELSE {_SHOT_SCORE} END, 6)::double AS confidence FROM files")
def screenshot_score(spark, sf):
    i = c("doc_id")
    ocr = F.when(i % 5 == 0, "share this menu")
    a = L.assess_screenshot(P.basename(c("path")), F.when(i % 2 == 0, 1440).otherwise(700), F.when(i % 2 == 0, 900).otherwise(100), F.array().cast("array<string>"), ocr, F.array().cast("array<string>"))
    return W.files(spark, sf).select("file_id", a.alias("a")).select("file_id", "a.is_screenshot", "a.subtype", F.round("a.confidence", 6).alias("confidence"))


@query(None, "SELECT p_partkey AS id, CASE WHEN regexp_matches(l,'cat|dog|bird|horse|elephant|bear|animal') THEN 'Image/Animals' WHEN regexp_matches(l,'car|truck|bus|bicycle|airplane|boat|vehicle') THEN 'Image/Vehicles' WHEN regexp_matches(l,'beach|mountain|forest|desert|sky|sunset|landscape') THEN 'Image/Scenery' WHEN regexp_matches(l,'food|pizza|cake|fruit|vegetable|meal') THEN 'Image/Food' WHEN contains(l,'screen') THEN 'Screenshots' WHEN regexp_matches(l,'text|document|paper') THEN 'Image/Documents' END AS category FROM (SELECT p_partkey, lower(p_name || CASE WHEN p_partkey%3=0 THEN ' dog' WHEN p_partkey%3=1 THEN ' paper' ELSE '' END) AS l FROM part)")
def vision_categories(spark, sf):
    i = c("p_partkey")
    return table(spark, sf, "part").select(i.alias("id"), L.vision_category(F.concat("p_name", F.when(i % 3 == 0, " dog").when(i % 3 == 1, " paper").otherwise(""))).alias("category"))


@query("files", "SELECT file_id, CASE WHEN doc_id%4=0 THEN 0.0 ELSE round(greatest(0, least(1, 0.35+0.25+CASE WHEN size<=12288 THEN 0.10 ELSE 0 END + CASE WHEN doc_id%2=0 THEN 0.65 ELSE 0 END)),6) END::double AS score FROM files WHERE size > 0")
def image_junk(spark, sf):
    i = c("doc_id")
    pixels = F.when(i % 2 == 0, F.array_repeat(F.lit(7), 64)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: x * 4))
    ocr = F.when(i % 4 == 0, "a text with more than two dozen letters")
    j = L.assess_junk(F.lit(100), F.lit(100), c("size"), pixels, ocr, F.lit(None).cast("array<struct<label:string,confidence:double>>"), F.lit(False))
    return W.files(spark, sf).where("size > 0").select("file_id", j["score"].alias("score"))


@query("classifications", "SELECT f.file_id, array_to_string([x FOR x IN [CASE WHEN kind='image' THEN 'siglip2' END, CASE WHEN kind='image' AND f.doc_id%2=0 THEN 'paddle-ocr' END, CASE WHEN kind='image' AND confidence<0.55 THEN 'minicpm' END] IF x IS NOT NULL], ',') AS route FROM files f JOIN classifications c ON c.file_id=f.file_id")
def model_routes(spark, sf):
    rows = W.files(spark, sf).join(W.classifications(spark, sf).select("file_id", "confidence"), "file_id")
    route = L.route_models(c("kind"), c("confidence"), c("doc_id") % 2 == 1, F.lit(True), "balanced", ["siglip2", "paddle-ocr", "minicpm"])
    return rows.select("file_id", joined(route).alias("route"))


@query("files", "SELECT file_id, CASE WHEN doc_id%53=0 OR doc_id%10 NOT IN (7,8) THEN 'probe:non-media-container' WHEN doc_id%4=0 THEN 'probe:too-long' WHEN doc_id%9=0 THEN 'probe:too-short' WHEN doc_id%3=0 THEN 'probe:music-tag' ELSE 'probe:av-duration' END AS reason FROM files")
def media_gate(spark, sf):
    i = c("doc_id")
    duration = F.when(i % 4 == 0, 9000.0).when(i % 9 == 0, 0.5).otherwise(60.0)
    g = L.speech_gate(P.extension(c("path")), F.lit(False), F.when(i % 3 == 0, "Music").otherwise(""), duration, c("size"))
    return W.files(spark, sf).select("file_id", g["reason"].alias("reason"))


@query(None, "SELECT event_id, array_to_string([round(x,6)::double::varchar FOR x IN [0.0, CASE WHEN d>0.5 THEN d*0.5 END, CASE WHEN d>1 AND greatest(0,d-0.5) > d*0.5+0.1 THEN greatest(0,d-0.5) END] IF x IS NOT NULL], ',') AS times FROM (SELECT event_id, (event_id%40)/8.0 AS d FROM events)")
def frame_times(spark, sf):
    d = (c("event_id") % 40) / 8.0
    return table(spark, sf, "events").select("event_id", joined(F.transform(V.frame_times(d), lambda x: F.round(x, 6).cast("string"))).alias("times"))


# ---- learning ---------------------------------------------------------------------------------


@query("corrections", "SELECT pattern_type, pattern, category AS target_category, 0.55::double AS confidence, false AS enabled, count(DISTINCT file_id) FILTER (action='addCategory') AS positives FROM corrections WHERE generation IS NOT NULL GROUP BY 1,2,3 HAVING count(*) FILTER (action='removeCategory')=0 AND count(DISTINCT file_id) FILTER (action='addCategory') >= 3")
def rule_promotion(spark, sf):
    return R.promote_rules(W.corrections(spark, sf)).drop("negatives")


@query("corrections", "SELECT pattern_type, pattern, category AS target_category, CASE WHEN n>0 THEN 0.35 ELSE 0.55 END::double AS confidence, n=0 AS enabled FROM (SELECT pattern_type, pattern, category, count(*) FILTER (action='removeCategory') AS n FROM corrections WHERE generation IS NOT NULL GROUP BY 1,2,3)")
def negative_block(spark, sf):
    corr = W.corrections(spark, sf)
    known = corr.where("generation is not null").select("pattern_type", "pattern", c("category").alias("target_category"), F.lit(0.55).alias("confidence"), F.lit(True).alias("enabled")).distinct()
    return R.promote_rules(corr, existing=known).select("pattern_type", "pattern", "target_category", "confidence", "enabled")


@query("files", "SELECT file_id, 'pathKeyword' AS pattern_type, CASE WHEN doc_id%29=0 THEN 'node_modules' WHEN doc_id%43=0 THEN 'bazel-out2' ELSE coalesce(source,'none') END AS pattern FROM files")
def derived_patterns(spark, sf):
    p = R.derive_pattern(c("path"))
    return W.files(spark, sf).select("file_id", p["pattern_type"].alias("pattern_type"), p["pattern"].alias("pattern"))


@query("memberships", "SELECT file_id, CASE WHEN min(doc_id)%15=0 THEN 'Review/Unknown' ELSE string_agg(category_path, ',' ORDER BY category_path) END AS categories FROM (SELECT file_id, doc_id, category_path FROM memberships WHERE NOT (doc_id%3=0 AND category_path='Documents/Text') UNION ALL SELECT file_id, doc_id, 'Kept/Manual' FROM files WHERE doc_id%5=0) GROUP BY file_id")
def override_apply(spark, sf):
    files, i = W.files(spark, sf), c("doc_id")
    over = files.where(i % 3 == 0).select("file_id", F.lit("Documents/Text").alias("category"), F.lit("removeCategory").alias("action"), F.lit(1.0).alias("updated"))
    over = over.unionByName(files.where(i % 5 == 0).select("file_id", F.lit("Kept/Manual").alias("category"), F.lit("addCategory").alias("action"), F.lit(2.0).alias("updated")))
    over = over.unionByName(files.where(i % 15 == 0).select("file_id", F.lit("Review/Unknown").alias("category"), F.lit("addCategory").alias("action"), F.lit(3.0).alias("updated")))
    out = R.apply_overrides(W.classifications(spark, sf).select("file_id", "categories"), over)
    return out.where(F.size("categories") > 0).select("file_id", joined(F.array_sort("categories")).alias("categories"))


_RULES = [(1, "extension", "md", "Notes/Markdown", True), (2, "pathKeyword", "/en/src1/", "Topics/One", True), (3, "metadata", "pdf", "Topics/Portable", True), (4, "pathKeyword", "src2", "Topics/Off", False)]


@query("files", "SELECT file_id, concat_ws(',', CASE WHEN doc_id%10=1 AND doc_id%53<>0 THEN 'learned:1:Notes/Markdown' END, CASE WHEN contains(path,'/en/src1/') THEN 'learned:2:Topics/One' END, CASE WHEN kind='pdf' THEN 'learned:3:Topics/Portable' END) AS reasons FROM files")
def rule_enrich(spark, sf):
    rules = spark.createDataFrame(_RULES, "id long, pattern_type string, pattern string, target_category string, enabled boolean")
    files = W.files(spark, sf).withColumn("evidence", c("kind")).withColumn("categories", F.array().cast("array<string>"))
    return R.enrich(files, rules).select("file_id", joined("reasons").alias("reasons"))


@query("files", "SELECT file_id, 5.0::double AS enqueued FROM files WHERE status<>'unscoped' AND doc_id%10=1 AND doc_id%53<>0")
def reindex_queue(spark, sf):
    return R.reindex_queue(W.files(spark, sf), {"pattern_type": "extension", "pattern": ".md"}, 5.0)


@query("files", "SELECT file_id, CASE WHEN status<>'unscoped' AND contains(path,'src1') THEN '' ELSE 'v1' END AS last_extractor FROM files")
def rule_toggle(spark, sf):
    rules = spark.createDataFrame(_RULES, "id long, pattern_type string, pattern string, target_category string, enabled boolean")
    return R.toggle_rule(rules, W.files(spark, sf), {"id": 2, "pattern_type": "pathKeyword", "pattern": "src1"}, False, 5.0)[1].select("file_id", "last_extractor")


@query("files", "SELECT file_id, file_id || '|' || size::varchar || '|' || mtime::bigint::varchar AS generation FROM files")
def generation_keys(spark, sf):
    return W.files(spark, sf).withColumn("mtime", c("mtime").cast("long")).select("file_id", R.generation_key("file_id", "size", "mtime").alias("generation"))


# ---- groups and categories --------------------------------------------------------------------

_SPEC = """spec AS (SELECT category_path AS path, count(*) AS items, CASE WHEN starts_with(category_path,'School/') THEN substr(category_path,8) WHEN category_path='Projects/Code' THEN 'Code projects' WHEN category_path='Documents/PDF' THEN 'PDFs' WHEN category_path='Documents/Office' THEN 'Office documents' END AS title, CASE WHEN starts_with(category_path,'School/') THEN 110 WHEN category_path='Projects/Code' THEN 106 WHEN category_path IN ('Documents/PDF','Documents/Office') THEN 90 END AS priority FROM memberships GROUP BY category_path HAVING count(*)>1),
 dup AS (SELECT substr(sha256('nearDuplicate|' || string_agg(file_id,'|' ORDER BY file_id)),1,16) AS fam, count(*) AS items FROM hashes GROUP BY sha256 HAVING count(*)>1),
 cand AS (SELECT 'category:'||path AS group_id, title, priority, items, CASE WHEN starts_with(path,'School/') THEN 'school' WHEN path='Projects/Code' THEN 'projects' ELSE 'general' END AS lane FROM spec WHERE title IS NOT NULL
 UNION ALL SELECT 'composite:installers-archives','Installers & archives',96,count(DISTINCT file_id),'downloads' FROM memberships WHERE category_path IN ('Applications','DiskImages','Packages','Archives')
 UNION ALL SELECT 'composite:media','Recordings & media',92,count(DISTINCT file_id),'media' FROM memberships WHERE category_path IN ('Audio','Video')
 UNION ALL SELECT 'duplicate:'||fam,'Near-duplicate family',120,items,'duplicates' FROM dup)"""


@query("memberships hashes", f", {_SPEC} SELECT row_number() OVER (ORDER BY priority DESC, items DESC, title, group_id)::int AS position, group_id, title, priority, items FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY priority DESC, items DESC, title, group_id) AS k FROM cand) WHERE k <= CASE lane WHEN 'duplicates' THEN 3 WHEN 'school' THEN 4 WHEN 'projects' THEN 2 WHEN 'downloads' THEN 1 WHEN 'media' THEN 1 ELSE 4 END) ORDER BY position LIMIT 18")
def smart_groups(spark, sf):
    clusters = C.clusters(C.exact_family_edges(W.hashes(spark, sf).select(c("file_id").alias("id"), c("sha256").alias("exact_hash"))))
    return G.smart_groups(W.memberships(spark, sf), clusters, with_members=False).select("position", "group_id", "title", "priority", "items")


@query("memberships", "SELECT group_id, file_id FROM (SELECT DISTINCT CASE WHEN category_path IN ('Applications','DiskImages','Packages','Archives') THEN 'composite:installers-archives' ELSE 'composite:media' END AS group_id, file_id FROM memberships WHERE category_path IN ('Applications','DiskImages','Packages','Archives','Audio','Video'))")
def composite_groups(spark, sf):
    return G.composite_members(G.members_by_category(W.memberships(spark, sf)))


@query(None, "SELECT 'n' || n_nationkey::varchar AS id, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey=r_regionkey UNION ALL SELECT 'r' || r_regionkey::varchar, r_name FROM region")
def category_paths(spark, sf):
    top = table(spark, sf, "region").select(F.concat(F.lit("r"), c("r_regionkey").cast("string")).alias("id"), c("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    low = table(spark, sf, "nation").select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("id"), c("n_name").alias("name"), F.concat(F.lit("r"), c("n_regionkey").cast("string")).alias("parent_id"))
    return G.category_paths(top.unionByName(low))


_PREFIX = "pre AS (SELECT DISTINCT array_to_string(string_split(category_path,'/')[1:n],'/') AS path, string_split(category_path,'/')[n] AS name, CASE WHEN n>1 THEN array_to_string(string_split(category_path,'/')[1:n-1],'/') END AS parent FROM memberships, range(1,6) r(n) WHERE n <= len(string_split(category_path,'/')))"


@query("memberships", f", {_PREFIX} SELECT path, name, parent FROM pre")
def ensured_categories(spark, sf):
    return G.ensure_categories(W.memberships(spark, sf))


@query("memberships", f", {_PREFIX} SELECT path FROM pre WHERE path NOT IN (SELECT array_to_string(string_split(category_path,'/')[1:n],'/') FROM memberships, range(1,6) r(n) WHERE n <= len(string_split(category_path,'/')) AND NOT starts_with(category_path,'School'))")
def unused_categories(spark, sf):
    m = W.memberships(spark, sf)
    return G.unused_categories(G.ensure_categories(m), m.where(~c("category_path").startswith("School")))


@query("memberships", f", {_PREFIX} SELECT p.path, p.name, coalesce((SELECT count(*) FROM memberships m WHERE m.category_path=p.path),0) AS files, coalesce((SELECT string_agg(k.name, ',' ORDER BY k.name) FROM pre k WHERE k.parent=p.path),'') AS children FROM pre p")
def tree_rollup(spark, sf):
    return G.tree(W.memberships(spark, sf)).select("path", "name", "files", joined("children").alias("children"))


@query("memberships", "SELECT string_split(category_path,'/')[-1] AS leaf, count(*) AS files FROM memberships GROUP BY 1")
def leaf_tree(spark, sf):
    return G.leaf_tree(W.memberships(spark, sf))


@query("memberships", "SELECT file_id, category_path AS path FROM memberships")
def normalized_categories(spark, sf):
    messy = F.concat(F.lit(" /"), F.replace("category_path", F.lit("/"), F.lit(" // ")), F.lit("/ "))
    return W.memberships(spark, sf).select("file_id", P.category_path(messy).alias("path"))


@query(None, "SELECT n_nationkey AS id, array_to_string([upper(substr(w,1,1)) || lower(substr(w,2)) FOR w IN string_split(replace(n_name,'_',' '),' ') IF w<>''], ' ') || ' LMS' AS title FROM nation")
def humanized(spark, sf):
    return table(spark, sf, "nation").select(c("n_nationkey").alias("id"), X.humanize(F.concat(F.translate("n_name", " ", "_"), F.lit("-lms"))).alias("title"))


# ---- incremental ------------------------------------------------------------------------------


@query("files", "SELECT path FROM files WHERE status<>'indexed' OR doc_id%6=0 OR doc_id%9=4 OR doc_id%17=5")
def needs_processing(spark, sf):
    files, i = W.files(spark, sf), c("doc_id")
    now = files.select("path", F.when(i % 6 == 0, c("size") + 1).otherwise(c("size")).alias("size"), F.when(i % 9 == 4, c("mtime") + 2).otherwise(c("mtime") + 0.0004).alias("mtime"))
    stored = files.where("doc_id % 17 <> 5")
    return I.needs_processing(now, stored, "v1").select("path")


@query("files", "SELECT path FROM files WHERE starts_with(path,'/en/') AND status NOT IN ('missing','unscoped') AND doc_id%8=3")
def unseen_candidates(spark, sf):
    files = W.files(spark, sf)
    return I.unseen(files, files.where("doc_id % 8 <> 3"), "/en").select("path")


@query("files", f"SELECT path, CASE WHEN starts_with(path,'/en/') AND status NOT IN ('missing','unscoped') AND doc_id%8=3 AND NOT {_EXCLUDED} AND NOT starts_with(path,'/en/src3/') THEN 'missing' ELSE status END AS status FROM files")
def missing_sweep(spark, sf):
    files = W.files(spark, sf)
    return I.missing_sweep(files, files.where("doc_id % 8 <> 3"), "/en", unreadable=["/en/src3"]).select("path", "status")


@query("files", "SELECT path, CASE WHEN starts_with(path,'/de/') THEN 'unscoped' ELSE status END AS status FROM files")
def scope_removed(spark, sf):
    return I.set_scope(W.files(spark, sf), "/de", False).select("path", "status")


@query("files", "SELECT path, CASE WHEN starts_with(path,'/en/') AND status='unscoped' THEN 'pending' ELSE status END AS status FROM files")
def scope_restored(spark, sf):
    return I.set_scope(W.files(spark, sf), "/en", True).select("path", "status")


@query("files", "SELECT path, CASE WHEN starts_with(path,'/es/') AND status<>'unscoped' THEN 'missing' ELSE status END AS status FROM files")
def subtree_missing(spark, sf):
    return I.subtree_missing(W.files(spark, sf), "/es").select("path", "status")


_BACK = "back AS (SELECT '/live/u' || user_id::varchar AS prefix, arg_max(event_type, t) AS reason, least(count(*),30)::int AS attempts, max(t) AS last_attempt FROM (SELECT user_id, event_type, event_id::double AS t FROM events) GROUP BY 1), bo AS (SELECT *, last_attempt + least(1800.0, 30.0*pow(2.0, least(attempts-1, 10)))::double AS retry_after FROM back)"


def _backoff(spark, sf, **kw):
    e = table(spark, sf, "events")
    return I.access_backoff(e.select(F.concat(F.lit("/live/u"), c("user_id").cast("string")).alias("prefix"), c("event_type").alias("reason"), c("event_id").cast("double").alias("now")), **kw)


@query(None, f"WITH {_BACK} SELECT prefix, reason, attempts, last_attempt, retry_after FROM bo")
def access_backoff(spark, sf):
    return _backoff(spark, sf)


@query(None, f"WITH {_BACK} SELECT prefix, last_attempt FROM bo ORDER BY last_attempt DESC, prefix LIMIT 32")
def backoff_prune(spark, sf):
    return _backoff(spark, sf, keep=32).select("prefix", "last_attempt")


@query(None, f"WITH {_BACK} SELECT prefix, retry_after FROM bo WHERE retry_after > 2000 AND NOT (prefix='/live/u1' OR starts_with(prefix,'/live/u1/')) ORDER BY retry_after, prefix")
def active_backoff(spark, sf):
    return I.active_backoff(I.clear_backoff(_backoff(spark, sf), "/live/u1"), 2000.0).select("prefix", "retry_after")


@query("files", "SELECT path, CASE WHEN doc_id%10=1 THEN size+100 ELSE size END AS size FROM files UNION ALL SELECT '/new/' || doc_id::varchar, size FROM files WHERE doc_id%10=2")
def upsert_rows(spark, sf):
    files = W.files(spark, sf)
    rows = files.where("doc_id % 10 = 1").withColumn("size", c("size") + 100).unionByName(files.where("doc_id % 10 = 2").withColumn("path", F.concat(F.lit("/new/"), c("doc_id").cast("string"))))
    return ST.upsert(files, rows, ["path"]).select("path", "size")


@query("transcripts", "SELECT file_id, start, text FROM transcripts WHERE file_id NOT IN (SELECT file_id FROM files WHERE doc_id IN (1,2)) UNION ALL SELECT file_id, 0.0::double, 'new' FROM files WHERE doc_id IN (1,2)")
def replace_segments(spark, sf):
    rows = W.files(spark, sf).where("doc_id in (1, 2)").select("file_id", F.lit(0.0).alias("start"), F.lit("new").alias("text"))
    return ST.replace_per_key(W.transcripts(spark, sf).select("file_id", "start", "text"), rows, ["file_id"])


@query("memberships", "SELECT DISTINCT category_path, file_id FROM memberships UNION SELECT 'Documents/Text', file_id FROM files WHERE doc_id%10<3")
def insert_or_ignore(spark, sf):
    rows = W.files(spark, sf).where("doc_id % 10 < 3").select(F.lit("Documents/Text").alias("category_path"), "file_id")
    return ST.insert_or_ignore(W.memberships(spark, sf), rows, ["category_path", "file_id"])


@query("memberships vectors hashes", "SELECT 'memberships' AS name, count(*) AS rows FROM memberships WHERE doc_id%4<>0 UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE doc_id%4<>0 UNION ALL SELECT 'hashes', count(*) FROM hashes WHERE file_id NOT IN (SELECT file_id FROM files WHERE doc_id%4=0)")
def cascading_purge(spark, sf):
    gone = W.files(spark, sf).where("doc_id % 4 = 0")
    left = ST.purge({"memberships": W.memberships(spark, sf), "vectors": W.vectors(spark, sf), "hashes": W.hashes(spark, sf)}, gone)
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("inbox", "SELECT file_id, CASE WHEN updated % 2 = 0 THEN 'resolved' ELSE state END AS state FROM inbox")
def resolve_review(spark, sf):
    box = W.inbox(spark, sf)
    return I.resolve_review(box, box.where("updated % 2 = 0"), 9.0).select("file_id", "state")


@query("live", "SELECT event_id, CASE event_id%4 WHEN 0 THEN 'missing' WHEN 1 THEN 'backoff' WHEN 2 THEN 'scan' ELSE 'index' END AS action FROM live")
def delta_actions(spark, sf):
    k = c("event_id") % 4
    rows = W.events(spark, sf).withColumn("error", F.when(k == 0, "ENOENT").when(k == 1, "EACCES")).withColumn("is_directory", k == 2)
    return I.classify_deltas(rows).select("event_id", "action")


@query("files", "SELECT file_id, 'text' AS stage, substr(path, 1, 200) AS message FROM files WHERE status='pending'")
def error_log(spark, sf):
    rows = W.files(spark, sf).where("status = 'pending'").select(c("file_id").alias("opaque_ref"), F.lit("text").alias("stage"), c("path").alias("message"))
    log = spark.createDataFrame([], "opaque_ref string, stage string, message string, created double")
    return I.log_errors(log, rows, 1.0).select(c("opaque_ref").alias("file_id"), "stage", "message")


@query("memberships", "SELECT file_id, string_agg(category_path, ',' ORDER BY category_path) AS categories FROM (SELECT file_id, category_path FROM memberships WHERE NOT (doc_id%3=0 AND category_path='Documents/Text') UNION SELECT file_id, 'Notes/Markdown' FROM files WHERE doc_id%10=1 AND doc_id%53<>0) GROUP BY file_id")
def reclassified(spark, sf):
    rules = spark.createDataFrame(_RULES[:1], "id long, pattern_type string, pattern string, target_category string, enabled boolean")
    files = W.files(spark, sf)
    over = files.where("doc_id % 3 = 0").select("file_id", F.lit("Documents/Text").alias("category"), F.lit("removeCategory").alias("action"), F.lit(1.0).alias("updated"))
    stored = files.join(W.classifications(spark, sf).select("file_id", c("categories").alias("base_categories")), "file_id").withColumn("evidence", c("kind"))
    out = I.reclassify(stored, over, rules)
    return out.where(F.size("categories") > 0).select("file_id", joined(F.array_sort("categories")).alias("categories"))


# ---- quality metrics --------------------------------------------------------------------------


def _set_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    pick = lambda m: F.filter(F.array(*(F.when(c("doc_id") % k == 0, F.lit(f"c{k}")) for k in m)), lambda x: x.isNotNull())
    return d.select("doc_id", pick((2, 3, 5)).alias("truth"), pick((2, 3, 7)).alias("predicted"))


_SETS = "sets AS (SELECT doc_id, [x FOR x IN [CASE WHEN doc_id%2=0 THEN 'c2' END, CASE WHEN doc_id%3=0 THEN 'c3' END, CASE WHEN doc_id%5=0 THEN 'c5' END] IF x IS NOT NULL] AS t, [x FOR x IN [CASE WHEN doc_id%2=0 THEN 'c2' END, CASE WHEN doc_id%3=0 THEN 'c3' END, CASE WHEN doc_id%7=0 THEN 'c7' END] IF x IS NOT NULL] AS p FROM documents), sc AS (SELECT *, CASE WHEN len(p)=0 THEN 1.0 ELSE len(list_intersect(t,p))/len(p) END AS pr, CASE WHEN len(t)=0 THEN 1.0 ELSE len(list_intersect(t,p))/len(t) END AS rc FROM sets)"


@query(None, f"WITH {_SETS} SELECT round(avg(pr),6) AS precision, round(avg(rc),6) AS recall, round(avg(CASE WHEN pr+rc=0 THEN 0 ELSE 2*pr*rc/(pr+rc) END),6) AS f1 FROM sc")
def prf1(spark, sf):
    return M.macro_set_scores(_set_rows(spark, sf)).select(*(F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")))


def _label_rows(spark, sf):
    return table(spark, sf, "labels").select(c("quality").cast("string").alias("truth"), F.when(c("doc_id") % 6 == 0, "1").otherwise(c("quality").cast("string")).alias("predicted"))


_LR = "lr AS (SELECT quality::varchar AS t, CASE WHEN doc_id%6=0 THEN '1' ELSE quality::varchar END AS p FROM labels)"


@query(None, f"WITH {_LR} SELECT round(avg((t=p)::int),6) AS accuracy FROM lr")
def label_accuracy(spark, sf):
    return M.accuracy(_label_rows(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


@query(None, f"WITH {_LR} SELECT round(avg(2.0*tp/(2*tp+fp+fn)),6) AS macro_f1 FROM (SELECT l, sum((t=l AND p=l)::int) AS tp, sum((t<>l AND p=l)::int) AS fp, sum((t=l AND p<>l)::int) AS fn FROM lr, (SELECT DISTINCT t AS l FROM lr) GROUP BY l)")
def macro_f1(spark, sf):
    return M.macro_f1(_label_rows(spark, sf)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(None, f"WITH {_SETS} SELECT round(avg(CASE WHEN len(t)=0 THEN 1.0 ELSE len(list_intersect(t, p[1:1]))/len(t) END),6) AS recall FROM sets")
def recall_at_k(spark, sf):
    rows = _set_rows(spark, sf).select(c("truth").alias("relevant"), c("predicted").alias("ranked"))
    return M.recall_at_k(rows, 1).select(F.round("recall", 6).alias("recall"))


@query(None, "SELECT round(sum(top)/sum(n),6) AS purity FROM (SELECT source, max(n) AS top, sum(n) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1,2) GROUP BY 1)")
def purity(spark, sf):
    return M.purity(table(spark, sf, "documents").select(c("source").alias("cluster"), c("lang").alias("label"))).select(F.round("purity", 6).alias("purity"))


@query(None, "SELECT round(avg(s),6) AS completeness FROM (SELECT lang, max(n)/sum(n) AS s FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1,2) GROUP BY 1)")
def completeness(spark, sf):
    return M.completeness(table(spark, sf, "documents").select(c("source").alias("cluster"), c("lang").alias("label"))).select(F.round("completeness", 6).alias("completeness"))


@query(None, "SELECT round(greatest(0, (f-l)/f::double),6) AS reduction FROM (SELECT arg_min(n, turn) AS f, arg_max(n, turn) AS l FROM (SELECT turn, count(*) AS n FROM conversations GROUP BY 1))")
def correction_reduction(spark, sf):
    runs = table(spark, sf, "conversations").groupBy(c("turn").alias("run")).agg(F.count("*").alias("manual_corrections"))
    return M.correction_reduction(runs).select(F.round("reduction", 6).alias("reduction"))


@query(None, "SELECT quantile_disc(value, 0.95) AS value FROM events")
def latency_percentile(spark, sf):
    return M.percentile(table(spark, sf, "events"), "value", 0.95)


@query(None, "SELECT round(avg(value),6) AS mean, round(avg((event_type='error')::int),6) AS share FROM events")
def mean_measures(spark, sf):
    e = table(spark, sf, "events")
    mean = M.mean_number(e, "value").select(F.round("mean", 6).alias("mean"))
    share = M.mean_flag(e.withColumn("bad", c("event_type") == "error"), "bad").select(F.round("mean", 6).alias("share"))
    return mean.crossJoin(share)  # one row each


@query(None, "SELECT arg_max(event_type, r) AS provider FROM (SELECT event_type, struct_pack(a := round(avg((user_id%2=0)::int),6), b := -max(event_id)) AS r FROM events GROUP BY 1) HAVING count(DISTINCT event_type) >= 2")
def best_provider(spark, sf):
    runs = table(spark, sf, "events").groupBy(c("event_type").alias("provider")).agg(F.round(F.avg((c("user_id") % 2 == 0).cast("double")), 6).alias("recall_at_1"), F.max("event_id").alias("p95"))
    return M.best_provider(runs.withColumn("comparable", F.lit(True)))


# ---- streaming, batch equivalents -------------------------------------------------------------


@query("live", "SELECT day, 'path' AS kind, path, arg_max(flags, event_id) AS flags, max(event_id) AS event_id FROM live WHERE flags & 55 = 0 AND day NOT IN (SELECT day FROM live WHERE flags & 55 <> 0) GROUP BY day, path UNION ALL SELECT day, 'rescan', NULL, 0, max(event_id) FROM live WHERE day IN (SELECT day FROM live WHERE flags & 55 <> 0) GROUP BY day")
def live_coalesce(spark, sf):
    return Y.coalesce(W.events(spark, sf), keys=("day",))


@query("live", "SELECT day, CASE WHEN count(DISTINCT path) > 200 OR bool_or(flags & 55 <> 0) THEN 'rescan' ELSE 'paths' END AS outcome FROM live GROUP BY day")
def storm_collapse(spark, sf):
    work = Y.coalesce(W.events(spark, sf), keys=("day",), max_pending=200)
    return work.groupBy("day").agg(F.when(F.bool_or(c("kind") == "rescan"), "rescan").otherwise("paths").alias("outcome"))


@query("live", "SELECT day, count(*) AS events, count(DISTINCT path) AS pending, least(count(DISTINCT path), 200) AS peak, count(DISTINCT path) > 200 AS collapsed, bool_or(flags & 55 <> 0) AS dropped FROM live GROUP BY day")
def live_metrics(spark, sf):
    return Y.batch_metrics(W.events(spark, sf), keys=("day",), max_pending=200)


@query("live", "SELECT event_id FROM live WHERE flags & 55 <> 0")
def dropped_events(spark, sf):
    return W.events(spark, sf).where(Y.dropped(c("flags"))).select("event_id")


@query("live", ", g AS (SELECT ts, path, event_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS n FROM live), s AS (SELECT ts, path, sum(n) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, count(DISTINCT path)::int AS paths FROM s GROUP BY k")
def debounce_sessions(spark, sf):
    return Y.debounced(W.events(spark, sf), "300 seconds").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "paths")


@query(
    "live",
    """, m AS (SELECT DISTINCT epoch(ts::timestamp)::double AS t FROM live WHERE flags & 55 <> 0),
 scan(x) AS (SELECT min(t) FROM m HAVING min(t) IS NOT NULL UNION ALL SELECT greatest(n, x + 86400.0) FROM (SELECT x, (SELECT min(t) FROM m WHERE t > x) AS n FROM scan) WHERE n IS NOT NULL)
 SELECT 'all' AS key, x AS scan_at FROM scan""",
    recursive=True,
)
def rate_limited_rescan(spark, sf):
    markers = W.events(spark, sf).where(Y.dropped(c("flags"))).select(F.lit("all").alias("key"), c("ts").cast("double").alias("ts"))
    return Y.reconcile_plan(markers, cooldown=86_400.0)


@query("transcripts", "SELECT file_id, count(*) AS segments FROM transcripts GROUP BY 1 HAVING count(*) >= 1")
def transcript_counts(spark, sf):
    return W.transcripts(spark, sf).groupBy("file_id").agg(F.count("*").alias("segments"))


@query("files", "SELECT file_id, size::varchar AS size, kind, regexp_extract(path, '\\.([^./]+)$', 1) AS extension FROM files")
def metadata_map(spark, sf):
    m = SF.metadata(W.files(spark, sf))
    return m.select("file_id", *(F.element_at("metadata", F.lit(k)).alias(k) for k in ("size", "kind", "extension")))
