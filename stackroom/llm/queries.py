"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm import langid, linededup, minhash, mixing, packing, pqsearch, quality, secrets, substring, warc
from stackroom.session import dealt, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines, lines removed, those with an equal earlier line, links of its lines, digest of what is kept."""
    out = linededup.dedup_lines(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_lines", "n_dropped", "n_exact", "n_links", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_single(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~F.coalesce(held, F.lit(False))))
    held_out = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held, F.lit(False)))
    return langid.identify(held_out, model).withColumn("held_out", F.coalesce(held, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pqsearch.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secrets.report(secrets.scan(docs, secrets.train(docs)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the mix that no selection decides."""
    return mixing.mix_single(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules alone."""
    return quality.score(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), None).drop("probability")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base patterns alone."""
    return secrets.report(secrets.scan(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), None)).drop("spans")


_ALL = (op1_line_dedup, op2_mix_sources, op3_language_id, op4_best_fit_packing, op5_embedding_near_dedup, op6_quality_rules, op7_warc, op8_secret_scan, op9_substring_dedup, op10_minhash_near_dedup, mix_targets, quality_measures, secret_base_spans)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_REACH = """sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b), comp AS (SELECT a AS node, least(a, min(b)) AS root FROM reach GROUP BY a)"""

_SPANS = "(SELECT doc_id, '{0}' AS kind, {1} AS k, list_sum([length(x) FOR x IN p[1:i]] || [length(x) FOR x IN m[1:i-1]])::BIGINT AS s, m[i] AS hit FROM (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{2}') AS p, regexp_extract_all(t, '{2}') AS m FROM d)))"
_ASSIGN = secrets.ASSIGN.replace("'", "''")

#: SQL for the operators that it can express. Models (op3, op6, op8), seeded selection (op2) and
#: greedy packing (op4) have none; tests hold them against plain versions, and queries of their
#: plain columns (mix_targets, quality_measures, secret_base_spans) against SQL.
ORACLE: dict[str, str] = {
    "op1_line_dedup": r"""WITH ln AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
 big AS (SELECT doc_id, i, l, length(l) AS n FROM ln WHERE length(l) >= 24 OR regexp_matches(l, '[^ \t\n\x0B\f\r]')),
 cls AS (SELECT l, n, min((doc_id, i)) AS f, n - length(replace(l, 'e', '')) AS ne, n - length(replace(l, 'n', '')) AS nn, n - length(replace(l, 't', '')) AS nt, n - length(replace(l, 'i', '')) AS ni, n - length(replace(l, ' ', '')) AS nb FROM big GROUP BY l, n),
 link AS (SELECT a.l AS a, b.l AS b, b.f AS f FROM cls a JOIN cls b ON a.n >= 24 AND b.n >= 24 AND b.n BETWEEN a.n - 2 AND a.n + 2 AND a.l <> b.l AND abs(a.ne - b.ne) + abs(a.nn - b.nn) + abs(a.nt - b.nt) + abs(a.ni - b.ni) + abs(a.nb - b.nb) <= 4 AND levenshtein(a.l, b.l) <= 2),
 per AS (SELECT a, count(*) AS links, min(f) AS f FROM link GROUP BY a),
 occ AS (SELECT b.doc_id, b.i, (b.doc_id, b.i) > least(c.f, coalesce(p.f, c.f)) AS gone, (b.doc_id, b.i) > c.f AS again, coalesce(p.links, 0) AS links FROM big b JOIN cls c ON c.l = b.l LEFT JOIN per p ON p.a = b.l),
 agg AS (SELECT doc_id, count(*) FILTER (gone) AS n_dropped, count(*) FILTER (again) AS n_exact, sum(links)::BIGINT AS n_links, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (gone), '') AS dropped, list(i) FILTER (gone) AS drops FROM occ GROUP BY doc_id)
 SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_exact, 0) AS n_exact, coalesce(n_links, 0) AS n_links, coalesce(dropped, '') AS dropped,
 sha256(array_to_string([string_split(d.text, chr(10))[k] FOR k IN range(1, len(string_split(d.text, chr(10))) + 1) IF NOT list_contains(coalesce(a.drops, []), k - 1)], chr(10))) AS kept_sha256 FROM documents d LEFT JOIN agg a USING (doc_id)""",
    "op5_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
 link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND x.n > 0 AND y.n > 0 AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.93), {_REACH}
 SELECT vec_id, coalesce((SELECT count(*) FROM link WHERE a = vec_id), 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept FROM v LEFT JOIN comp ON node = vec_id""",
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
 SELECT page_id, strlen(p.h) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(d, ((k // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1, 1) FOR k IN range(0, 32)], '') AS payload_digest,
 CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM p JOIN f ON f.h = p.h""",
    "op9_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), win AS (SELECT doc_id, p, array_to_string(w[p:p+49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
 first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s), cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM win JOIN first USING (s) WHERE m < doc_id), per AS (SELECT doc_id, list(k) AS ks FROM cov GROUP BY doc_id)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(ks, k)] END, ' ')) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id)""",
    "op10_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2), link AS (SELECT a, b FROM pairs JOIN c p ON p.doc_id = a JOIN c q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)), {_REACH}
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept FROM d LEFT JOIN c USING (doc_id) LEFT JOIN comp ON node = d.doc_id""",
    "mix_targets": f"""WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS.format('text')})::BIGINT AS size FROM documents), per AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
 s AS (SELECT list(source ORDER BY source NULLS LAST) AS names, list(n ORDER BY source NULLS LAST) AS n, [[3, 1, 2][i % 3 + 1] FOR i IN range(0, count(*))] AS w, 1.5 * sum(n) AS total FROM per),
 fill AS (SELECT [0.0::DOUBLE FOR x IN n] AS out, [x > 0 FOR x IN n] AS open, false AS done FROM s UNION ALL
  SELECT CASE WHEN list_bool_or(over) THEN [CASE WHEN over[i] THEN 2.0 * n[i] ELSE out[i] END FOR i IN range(1, len(n) + 1)] ELSE [CASE WHEN open[i] THEN share[i] ELSE out[i] END FOR i IN range(1, len(n) + 1)] END, [open[i] AND NOT over[i] FOR i IN range(1, len(n) + 1)], NOT list_bool_or(over)
  FROM (SELECT *, [open[i] AND share[i] > 2.0 * n[i] FOR i IN range(1, len(n) + 1)] AS over FROM (SELECT out, open, done, n, w, [(total - list_sum([CASE WHEN open[j] THEN 0.0 ELSE out[j] END FOR j IN range(1, len(n) + 1)])) * w[i] / list_sum([CASE WHEN open[j] THEN w[j] ELSE 0 END FOR j IN range(1, len(n) + 1)]) FOR i IN range(1, len(n) + 1)] AS share FROM fill, s WHERE NOT done AND list_bool_or(open))))
 SELECT doc_id, size, p.n AS source_size, round((SELECT out FROM fill WHERE done)[list_position((SELECT [coalesce('s' || x, '-') FOR x IN names] FROM s), coalesce('s' || d.source, '-'))], 4) AS target FROM d JOIN per p ON p.source IS NOT DISTINCT FROM d.source""",
    "quality_measures": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format('text')} AS w FROM documents), win AS (SELECT doc_id, p, array_to_string(w[p:p+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
 rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
 m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d) d LEFT JOIN rep USING (doc_id))
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS kept FROM m""",
    "secret_base_spans": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT * FROM {_SPANS.format('assign', 0, _ASSIGN)} WHERE length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 8 UNION ALL SELECT * FROM {_SPANS.format('access', 1, secrets.ACCESS)} WHERE length(hit) >= 16 UNION ALL SELECT * FROM {_SPANS.format('hex', 2, secrets.HEX)} WHERE length(hit) >= 32)
 SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(kind || ':' || s::VARCHAR || ':' || (s + length(hit))::VARCHAR, ',' ORDER BY s, k), '')) AS base_sha256 FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
}
