"""Queries over the driver's tables by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native
from ..operators import analysis, coreset, curate, curves, evaluate, funnel, generate, graphs
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
MAX_CHARS = 8_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- funnel -------------------------------------------------------------------------------------------------------

_HELD_OUT = "doc_id % 97 = 5"  # the held-out split whose hashes are leaks
_JUDGED = f"""
WITH t AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE {_HELD_OUT}),
d AS (
  SELECT doc_id, source, text, sha256(coalesce(text, '')) AS sha,
         CASE WHEN length(coalesce(text, '')) = 0 THEN 'no_text' WHEN length(text) > {MAX_CHARS} THEN 'too_long'
              WHEN sha256(text) IN (SELECT sha FROM t) THEN 'test_leak' END AS early,
         CASE WHEN len(regexp_extract_all(text, '[.]')) < 2 THEN 'late_few_stops' END AS late FROM documents),
f AS (SELECT sha, min(doc_id) AS first FROM d WHERE early IS NULL AND late IS NULL GROUP BY sha),
j AS (
  SELECT d.doc_id, d.source, d.text, coalesce(early, CASE WHEN late IS NULL AND d.doc_id > f.first THEN 'exact_dup' END, late) AS reject_reason FROM d LEFT JOIN f USING (sha))
"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha256", native.sha256(F.col("text")))
    rows = funnel.with_leak_flag(docs, docs.filter(_HELD_OUT).select("sha256"), "sha256")
    rules = [("no_text", F.length("text") == 0), ("too_long", F.length("text") > MAX_CHARS), ("test_leak", F.col("leaked"))]
    return funnel.reject(rows, rules, "sha256", "doc_id", [("late_few_stops", F.regexp_count("text", F.lit("[.]")) < 2)])


@query(_JUDGED + "SELECT coalesce(reject_reason, 'kept') AS reason, source, count(*) AS n FROM j GROUP BY ALL")
def reject_funnel(spark, d):
    return judged(spark, d).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason"), "source").agg(F.count("*").alias("n"))


@query(_JUDGED + "SELECT doc_id, reject_reason FROM j")
def reject_rows(spark, d):
    return judged(spark, d).select("doc_id", "reject_reason")


@query(_JUDGED + "SELECT count(*) AS scanned, count(*) FILTER (reject_reason IS NULL OR reject_reason IN ('exact_dup', 'late_few_stops')) AS pass_a, count(*) FILTER (reject_reason IS NULL OR reject_reason = 'late_few_stops') AS distinct_texts, count(*) FILTER (reject_reason IS NULL) AS pool FROM j")
def funnel_counts(spark, d):
    r = F.col("reject_reason")
    return judged(spark, d).agg(F.count("*").alias("scanned"), F.count_if(r.isNull() | r.isin("exact_dup", "late_few_stops")).alias("pass_a"), F.count_if(r.isNull() | (r == "late_few_stops")).alias("distinct_texts"), F.count_if(r.isNull()).alias("pool"))


@query(_JUDGED + """, c AS (SELECT reject_reason, count(*) AS n FROM j WHERE reject_reason IS NOT NULL GROUP BY 1)
SELECT reject_reason, n, row_number() OVER (ORDER BY CASE reject_reason WHEN 'too_long' THEN 1 WHEN 'test_leak' THEN 2 ELSE 3 END, n DESC, reject_reason)::INTEGER AS place FROM c""")
def rejection_order(spark, d):
    return analysis.by_fixed_order(judged(spark, d).filter("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n")), "reject_reason", ("too_long", "test_leak"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_dedup(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", native.sha256(F.col("text")).alias("sha256"))
    return funnel.exact_dedup(docs, "sha256", "doc_id")


@query(f"SELECT doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.{_HELD_OUT} AND sha256(b.text) = sha256(a.text))")
def leak_antijoin(spark, d):
    docs = table(spark, d, "documents").select("doc_id", native.sha256(F.col("text")).alias("sha256"))
    return docs.join(docs.filter(_HELD_OUT).select("sha256"), "sha256", "left_anti").select("doc_id")


@query("""SELECT doc_id, kept FROM (SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY left(sha256(text), 16)) AS kept FROM documents)""")
def near_dedup_equal(spark, d):
    docs = table(spark, d, "documents").select("doc_id", native.average_hash_key(F.col("text")).alias("phash"))
    return funnel.near_dedup(docs, "phash", "doc_id", threshold=0).select("doc_id", "kept")


@query()
def near_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", native.average_hash_key(F.col("text")).alias("phash"))
    return funnel.near_dedup(docs, "phash", "doc_id", threshold=24, prefix=2).select("doc_id", "kept")


@query("""
WITH k AS (SELECT min(doc_id) AS doc_id, left(sha256(text), 16) AS key FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT a.doc_id AS left_id, b.doc_id AS right_id, (bit_count(xor(('0x' || substr(a.key, 1, 8))::BIGINT, ('0x' || substr(b.key, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.key, 9, 8))::BIGINT, ('0x' || substr(b.key, 9, 8))::BIGINT)))::INTEGER AS bits
FROM k a JOIN k b ON left(a.key, 3) = left(b.key, 3) AND a.doc_id < b.doc_id
""")
def hash_hamming(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", native.average_hash_key(F.col("text")).alias("key"))
    keyed = docs.withColumn("block", F.substring("key", 1, 3))
    other = keyed.select(F.col("doc_id").alias("right_id"), F.col("key").alias("right_key"), "block")
    pairs = keyed.join(other, "block").filter("doc_id < right_id")
    return pairs.select(F.col("doc_id").alias("left_id"), "right_id", native.hamming(F.col("key"), F.col("right_key")).alias("bits"))


# A text as 4 rows of 16 grey values, the counts of these letters in its quarters: near copies have near keys.
_LETTERS = "aeiotnsrhdlwbgmf"
_KEYS = f"""
WITH RECURSIVE p AS (SELECT doc_id, [substr(text, 1 + length(text) * i // 4, length(text) * (i + 1) // 4 - length(text) * i // 4) FOR i IN range(4)] AS part FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, [length(part[1 + i // 16]) - length(replace(part[1 + i // 16], substr('{_LETTERS}', 1 + i % 16, 1), '')) FOR i IN range(64)] AS cells FROM p),
b AS (SELECT doc_id, [CASE WHEN 64 * x >= list_sum(cells) THEN 1 ELSE 0 END FOR x IN cells] AS bits FROM c),
k AS (SELECT doc_id, array_to_string([substr('0123456789abcdef', 1 + 8 * bits[4 * i + 1] + 4 * bits[4 * i + 2] + 2 * bits[4 * i + 3] + bits[4 * i + 4], 1) FOR i IN range(16)], '') AS key FROM b)"""


def _apart(a: str, b: str) -> str:
    """SQL for the differing bits of two keys of 16 digits."""
    return " + ".join(f"bit_count(xor(('0x' || substr({a}, {k}, 8))::BIGINT, ('0x' || substr({b}, {k}, 8))::BIGINT))" for k in (1, 9))


def _greedy(rows: str, block: str) -> str:
    """SQL of greedy near dedup at 3 bits over a relation (key, pos) with distinct keys, as relation `g` (key, keeps)."""
    return f"""o AS (SELECT key, {block} AS block, row_number() OVER (PARTITION BY {block} ORDER BY pos) AS n FROM {rows}),
g AS (SELECT block, 0::BIGINT AS n, ''::VARCHAR AS key, false AS keeps, []::VARCHAR[] AS kept FROM (SELECT DISTINCT block FROM o)
      UNION ALL
      SELECT o.block, o.n, o.key, len([x FOR x IN g.kept IF {_apart('x', 'o.key')} <= 3]) = 0,
             CASE WHEN len([x FOR x IN g.kept IF {_apart('x', 'o.key')} <= 3]) = 0 THEN list_append(g.kept, o.key) ELSE g.kept END
      FROM g JOIN o ON o.block = g.block AND o.n = g.n + 1)"""


def profiled(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").filter("text is not null")
    return texts.select("doc_id", native.hex_key(native.mean_bits(native.letter_cells(F.col("text"), _LETTERS, 4))).alias("key"))


@query(_KEYS + " SELECT doc_id, key FROM k")
def profile_keys(spark, d):
    return profiled(spark, d)


@query(_KEYS + f""", f AS (SELECT key, min(doc_id) AS pos FROM k GROUP BY key), {_greedy('f', 'left(key, 4)')}
SELECT doc_id, coalesce(keeps AND doc_id = pos, false) AS kept FROM k JOIN f USING (key) JOIN g USING (key)""")
def near_dedup_profiles(spark, d):
    return funnel.near_dedup(profiled(spark, d), "key", "doc_id").select("doc_id", "kept")


@query(_KEYS + f""", f AS (SELECT key, min(doc_id) AS pos FROM k GROUP BY key)
SELECT a.key AS u, b.key AS v FROM f a JOIN f b ON left(a.key, 4) = left(b.key, 4) AND a.pos < b.pos AND {_apart('a.key', 'b.key')} <= 3""")
def near_pairs(spark, d):
    return funnel.near_pairs(profiled(spark, d).groupBy("key").agg(F.min("doc_id").alias("at")))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
b AS (SELECT vec_id, array_to_string([CASE WHEN x * len(e) >= list_reduce(e, lambda a, y: a + y, 0.0::DOUBLE) THEN '1' ELSE '0' END FOR x IN e], '') AS bits FROM v)
SELECT vec_id, left(sha256(bits), 16) AS phash FROM b""")
def average_hash(spark, d):
    return table(spark, d, "embeddings").select("vec_id", native.average_hash_key(native.mean_bits(F.col("embedding"))).alias("phash"))


# --- markup scalars on pages ---------------------------------------------------------------------------------------


@query("SELECT page_id, sha256(b) AS blob_sha, length(b)::INTEGER AS n FROM (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<article\\b.*?</article>'), ''), nullif(regexp_extract(html, '(?is)<article\\b.*'), ''), html) AS b FROM pages)".replace("\\\\", "\\"))
def blob_extract(spark, d):
    blob = native.blob_or_raw(F.col("html"), "article")
    return table(spark, d, "pages").select("page_id", native.sha256(blob).alias("blob_sha"), F.length(blob).alias("n"))


_TAGS = """
WITH c AS (SELECT page_id, (length(lower(html)) - length(replace(lower(html), '<p', ''))) // 2 AS n_text, (length(lower(html)) - length(replace(lower(html), '<div', ''))) // 4 AS n_rect,
                  (length(lower(html)) - length(replace(lower(html), '<a', ''))) // 2 + (length(lower(html)) - length(replace(lower(html), '<li', ''))) // 3 AS n_line,
                  (length(lower(html)) - length(replace(lower(html), '<script', ''))) // 7 AS n_path FROM pages),
b AS (SELECT *, CASE WHEN n_rect >= 2 AND n_text >= 1 AND n_line >= 1 THEN 'workflow_like' WHEN n_line >= 3 AND n_text <= 3 AND n_path <= 2 THEN 'geometry_like' WHEN n_text >= 1 THEN 'labeled' ELSE 'other' END AS bucket FROM c)
"""


def bucketed(spark, d) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.withColumn("bucket", native.bucket(F.col("html"), "<div", ("<a", "<li"), "<script", "<p"))


@query(_TAGS + "SELECT page_id, bucket FROM b")
def tag_buckets(spark, d):
    return bucketed(spark, d).select("page_id", "bucket")


@query(_TAGS + "SELECT bucket, count(*) AS n, 100.0::DOUBLE * count(*) / greatest(sum(count(*)) OVER (), 1) AS share FROM b GROUP BY bucket")
def bucket_share(spark, d):
    return analysis.shares(bucketed(spark, d))


@query(_TAGS + "SELECT bucket, count(*) AS n_pool, count(*) FILTER (page_id % 3 = 0) AS n_selected FROM b GROUP BY bucket")
def pool_and_selected(spark, d):
    return analysis.pool_and_selected(bucketed(spark, d), F.col("page_id") % 3 == 0)


@query(_TAGS + """, m AS (SELECT page_id, n_rect + n_line AS bk, n_path + n_text AS c, n_rect + n_line + n_path + n_text AS n FROM b)
SELECT page_id, coalesce(round(1e0 * bk / nullif(n, 0), 9), 0) AS clean, coalesce(round(1e0 * c / nullif(n, 0), 9), 0) AS pd, round(ln(1e0 + n), 9) AS ec,
       CASE WHEN n = 0 THEN 'vfig_no_geometry' WHEN coalesce(1e0 * bk / nullif(n, 0), 0) < 0.4 THEN 'vfig_low_clean' WHEN c > 50 THEN 'vfig_too_many_complex' END AS reason FROM m""")
def code_filter(spark, d):
    n = lambda x: native.count_of(F.col("html"), x)
    b, k, c, t = n("<div"), n("<a") + n("<li"), n("<script") + n("<p"), F.lit(0)
    m = native.shape_metrics(b, k, c, t)
    rows = table(spark, d, "pages").select("page_id", F.round(m["clean"], 9).alias("clean"), F.round(m["pd"], 9).alias("pd"), F.round(m["ec"], 9).alias("ec"), m["n"].alias("n"), m["clean"].alias("raw"), c.alias("c"))
    return rows.select("page_id", "clean", "pd", "ec", native.code_reason(F.lit(True), F.col("n"), F.col("raw"), F.col("c")).alias("reason"))


_HARD = """
WITH h AS (SELECT doc_id, round(0.25 * length(text) + 0.20 * len(regexp_extract_all(text, '\\n')) + 0.15 * (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[MLHVCSQTAZmlhvcsqtaz]'))) END) + 0.15 * sqrt(1e0 * length(text)) + 0.10 * len(regexp_extract_all(text, '[.]')), 6)::DOUBLE AS difficulty FROM documents WHERE text IS NOT NULL)
""".replace("\\\\", "\\")


def hard(spark, d) -> DataFrame:
    n, lines, stops = F.length("text"), F.regexp_count("text", F.lit("\n")), F.regexp_count("text", F.lit("[.]"))
    score = native.difficulty(n, lines, native.path_segments(F.col("text")), n, stops, F.lit(0), F.lit(0))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.round(score.cast("double"), 6).alias("difficulty"))


@query(_HARD + "SELECT round(quantile_cont(difficulty, 0.25), 4) AS p25, round(quantile_cont(difficulty, 0.5), 4) AS p50, round(quantile_cont(difficulty, 0.75), 4) AS p75, round(quantile_cont(difficulty, 0.9), 4) AS p90 FROM h")
def difficulty_quantiles(spark, d):
    q = analysis.quantiles(hard(spark, d), "difficulty")
    return q.select(*(F.round(c, 4).alias(c) for c in q.columns))


@query(_HARD + "SELECT doc_id, difficulty FROM h ORDER BY difficulty DESC, doc_id LIMIT 300")
def topk_difficulty(spark, d):
    return funnel.top(hard(spark, d), 300, F.desc("difficulty"), "doc_id")


@query(_HARD + ", e AS (SELECT min(difficulty) AS lo, max(difficulty) AS hi, count(*) AS n FROM h) SELECT least(floor((difficulty - lo) / ((hi - lo) / 40)), 39)::INTEGER AS bin, count(*) AS n, round(count(*) / (any_value(e.n) * ((any_value(hi) - any_value(lo)) / 40)), 9) AS density FROM h, e GROUP BY 1")
def difficulty_density(spark, d):
    return analysis.density(hard(spark, d), "difficulty").withColumn("density", F.round("density", 9))


@query("SELECT url_id AS page_id, w FROM (SELECT page_id AS url_id, try_cast(nullif(regexp_extract(u, '(?i)^([0-9.]+)\\s*(pt|px|cm|mm|in|em|ex|pc|%)?$', 1), '') AS DOUBLE) AS w FROM (SELECT page_id, trim(page_id::VARCHAR || CASE page_id % 3 WHEN 0 THEN 'px' WHEN 1 THEN '.5 pt' ELSE 'zz' END) AS u FROM pages))".replace("\\\\", "\\"))
def dimensions(spark, d):
    u = F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "px").when(F.col("page_id") % 3 == 1, ".5 pt").otherwise("zz"))
    return table(spark, d, "pages").select("page_id", native.dimension(u).alias("w"))


@query("SELECT page_id, round(CASE WHEN page_id % 5 = 0 THEN 1.0 ELSE 1e0 * (1 + page_id % 7) / (page_id % 5) END, 9)::DOUBLE AS aspect FROM pages")
def aspect_ratio(spark, d):
    box = F.concat_ws(", ", F.lit("0 0"), (1 + F.col("page_id") % 7).cast("string"), (F.col("page_id") % 5).cast("string"))
    return table(spark, d, "pages").select("page_id", F.round(native.aspect(box), 9).alias("aspect"))


@query("SELECT page_id, left(replace(url, '.svg', ''), 64) AS id, left('broad_' || replace(url, '.svg', ''), 64) AS broad_id, replace(replace(replace(left(html, 200), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS preview, 'pool/' || page_id::VARCHAR AS rel FROM pages")
def derived_names(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", native.derived_id(u).alias("id"), native.derived_id(u, "broad_").alias("broad_id"), native.html_escape(native.cut(F.col("html"), 200)).alias("preview"), native.relative_path(F.lit("pool"), F.col("page_id").cast("string")).alias("rel"))


# --- embeddings and selection --------------------------------------------------------------------------------------


@query("SELECT vec_id, round(list_sum(list_transform(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8))), 6) AS total FROM embeddings")
def l2_normalize(spark, d):
    v = coreset.l2_normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / coalesce(nullif(stddev_pop(n_chars) OVER (), 0), 1), 6) AS z FROM documents")
def zscore(spark, d):
    return coreset.zscore(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("z")), "z").withColumn("z", F.round("z", 6))


_DISTANCE = """
WITH e AS (SELECT vec_id AS idx, label AS cluster, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT cluster, i, avg(x) AS m FROM e GROUP BY ALL),
r AS (SELECT idx, cluster, round(sum((x - m) * (x - m)), 9) AS d2 FROM e JOIN c USING (cluster, i) GROUP BY ALL),
s AS (SELECT cluster, count(*) AS size FROM r GROUP BY cluster),
g AS (SELECT cluster, arg_min(idx, (d2, idx)) AS idx FROM r GROUP BY cluster)
"""


def clustered(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").alias("cluster"), F.col("embedding").alias("v"))
    return coreset.with_distance(rows).select("idx", "cluster", "d2", (F.col("idx") * 7919 % 1009).alias("difficulty"), F.col("idx").cast("string").alias("key"))


@query(_DISTANCE + "SELECT cluster, idx FROM g")
def medoids(spark, d):
    return coreset.medoids(clustered(spark, d))


@query("SELECT cluster, count(embeddings.label) AS size FROM (SELECT unnest(range(12)) AS cluster) k LEFT JOIN embeddings ON label = cluster GROUP BY cluster")
def cluster_sizes(spark, d):
    return coreset.sizes(clustered(spark, d), k=12)


@query("SELECT min(vec_id) AS idx, label AS cluster, count(*) AS size FROM embeddings GROUP BY label ORDER BY count(*), label LIMIT 4")
def rare_pick(spark, d):
    return clustered(spark, d).groupBy("cluster").agg(F.min("idx").alias("idx"), F.count("*").alias("size")).orderBy("size", "cluster").limit(4)


@query(_DISTANCE + """, a AS (SELECT idx FROM g JOIN s USING (cluster) ORDER BY greatest(1.0, sqrt(size)) DESC, g.cluster LIMIT 6),
h AS (SELECT idx FROM r WHERE idx NOT IN (FROM a) ORDER BY idx * 7919 % 1009 DESC, idx LIMIT 20),
l AS (SELECT cluster, min(idx) AS idx, count(*) AS size FROM r GROUP BY cluster),
q AS (SELECT idx FROM l WHERE idx NOT IN (FROM a) AND idx NOT IN (FROM h) ORDER BY size, cluster LIMIT 3),
o AS (SELECT idx, row_number() OVER (ORDER BY md5('42:' || idx::VARCHAR), idx) AS n FROM r WHERE idx NOT IN (FROM a) AND idx NOT IN (FROM h) AND idx NOT IN (FROM q)),
u AS (SELECT idx, 0 AS st, 0 AS n FROM a UNION ALL SELECT idx, 1, 0 FROM h UNION ALL SELECT idx, 2, 0 FROM q UNION ALL SELECT idx, CASE WHEN n <= 8 THEN 3 ELSE 4 END, n FROM o),
k AS (SELECT idx, st, row_number() OVER (ORDER BY st, n, idx) AS rank FROM u)
SELECT idx, ['medoid', 'complex', 'rare', 'reserve', 'fill'][st + 1] AS reason, rank::INTEGER AS rank FROM k WHERE rank <= 60""")
def quota_select(spark, d):
    return coreset.select(clustered(spark, d), 60, (6, 20, 3, 8))


@query()
def kmeans_clusters(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))
    return coreset.kmeans(rows, 10).select("idx", "cluster")


@query("""
WITH e AS (SELECT vec_id AS idx, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings), u AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e WHERE label IS NOT NULL),
m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cluster, list(x ORDER BY i) AS c FROM m GROUP BY label),
p AS (SELECT idx, cluster, sqrt(list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, len(v) + 1)])) AS distance FROM e, c)
SELECT idx, arg_min(cluster, (distance, cluster))::INTEGER AS cluster, round(min(distance), 6) AS distance FROM p GROUP BY idx""")
def nearest_centroid(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"), "label")
    centres = [r["centre"] for r in coreset.centroids(rows.filter("label is not null"), "label").orderBy("label").collect()]  # a row a label
    return coreset.nearest(rows.select("idx", "v"), centres).select("idx", "cluster", F.round("distance", 6).alias("distance"))


@query()
def minibatch_clusters(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))
    return coreset.nearest(rows, coreset.minibatch_kmeans(rows, 10, batch=500)).select("idx", "cluster", "distance")


@query()
def pca2(spark, d):
    return coreset.pca2(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))).select("vec_id", "x", "y")


@query("SELECT 'embed' AS stage, count(*) = (SELECT count(*) FROM embeddings) AND min(len(embedding)) = max(len(embedding)) AND count(*) FILTER (list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0) = 0 AND min(len(embedding)) >= 256 AS ok, CASE WHEN min(len(embedding)) >= 256 THEN '' ELSE 'dimension' END AS detail FROM embeddings")
def embedding_gate(spark, d):
    rows = table(spark, d, "embeddings")
    return analysis.embedding_gate(rows, rows.count())


# --- evaluation ----------------------------------------------------------------------------------------------------


@query("SELECT g.id, g.quality, p.lang FROM (SELECT doc_id // 2 AS id, arg_max(quality, doc_id) AS quality FROM labels GROUP BY 1) g JOIN (SELECT doc_id // 2 AS id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1) p USING (id)")
def gold_pred_join(spark, d):
    half = F.expr("doc_id div 2").alias("id")
    gold = table(spark, d, "labels").select(half, F.col("doc_id").alias("pos"), "quality")
    return evaluate.gold_with_predictions(gold, table(spark, d, "documents").select(half, F.col("doc_id").alias("pos"), "lang")).select("id", "quality", "lang")


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'id' ELSE 'ood' END AS split FROM labels) WHERE split IS NULL OR split = 'id'")
def split_filter(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 2 == 0, "id").otherwise("ood").alias("split"))
    return rows.filter(evaluate.in_split("split", "id")).select("doc_id")


_VALUE = "CASE WHEN doc_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN doc_id % 13 = 0 THEN NULL ELSE 1e0 * n_chars END"


def valued(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", "lang", F.when(i % 11 == 0, float("nan")).when(i % 13 == 0, None).otherwise(F.col("n_chars").cast("double")).alias("v"))


@query(f"SELECT lang, round(coalesce(avg(v) FILTER (NOT isnan(v)), 'NaN'::DOUBLE), 6) AS mean FROM (SELECT lang, {_VALUE} AS v FROM documents) GROUP BY lang")
def nan_safe_mean(spark, d):
    return valued(spark, d).groupBy("lang").agg(F.round(evaluate.safe_mean(F.col("v")), 6).alias("mean"))


@query(f"SELECT round(avg(v) FILTER (lang = 'en' AND NOT isnan(v)) - avg(v) FILTER (lang = 'de' AND NOT isnan(v)), 6) AS gap FROM (SELECT lang, {_VALUE} AS v FROM documents)")
def id_ood_gap(spark, d):
    return valued(spark, d).agg(F.round(evaluate.gap(F.col("v"), F.col("lang"), "en", "de"), 6).alias("gap"))


@query("SELECT round(abs(a - b), 9) AS delta, abs(a - b) < 0.05 AS warn FROM (SELECT avg(1e0 * quality) AS a, avg(1e0 * toxic) AS b FROM labels)")
def control_delta(spark, d):
    m = table(spark, d, "labels").agg(F.avg(F.col("quality").cast("double")).alias("a"), F.avg(F.col("toxic").cast("double")).alias("b"))
    return m.select(F.round(F.abs(F.col("a") - F.col("b")), 9).alias("delta"), evaluate.control_warning(F.col("a"), F.col("b")).alias("warn"))


@query("""
WITH v AS (SELECT quality AS g, 1e0 * toxic AS v, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS i FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
n AS (SELECT g, count(*) AS n, round(avg(v), 9) AS mean FROM v GROUP BY g),
p AS (SELECT g, b, ('0x' || left(md5(b::VARCHAR || ':' || i::VARCHAR), 8))::BIGINT % n AS i FROM v JOIN n USING (g), (SELECT unnest(range(1000)) AS b)),
m AS (SELECT g, b, round(avg(v), 9) AS m FROM p JOIN v USING (g, i) GROUP BY ALL)
SELECT g AS quality, any_value(mean) AS mean, list_sort(list(m))[26] AS lo, list_sort(list(m))[975] AS hi FROM m JOIN n USING (g) GROUP BY g""")
def bootstrap_md5(spark, d):
    return evaluate.bootstrap_md5(table(spark, d, "labels").filter("quality is not null"), "quality", "toxic", "doc_id")


@query(f"""
WITH v AS (SELECT source AS g, doc_id AS k, round(1e0 * n_chars / 1000, 3)::DOUBLE AS v FROM documents WHERE n_chars IS NOT NULL),
t AS (SELECT g, v, md5('7:' || j || ':' || k) AS d, j FROM v, (SELECT unnest(range(50)) AS j)),
n AS (SELECT g, 4 * j + i AS b, v, len([x FOR x IN {evaluate.POISSON} IF ('0x' || substr(d, 8 * i + 1, 8))::BIGINT >= x]) AS n FROM t, (SELECT unnest(range(4)) AS i)),
m AS (SELECT g, b, round(sum(v * n) / sum(n), 9) AS m FROM n WHERE n > 0 GROUP BY ALL),
l AS (SELECT g, list_sort(list(m)) AS ms FROM m GROUP BY g)
SELECT v.g AS source, round(avg(v), 6) AS mean, round(any_value(ms[floor(len(ms) * 0.025)::INTEGER + 1]), 6) AS lo, round(any_value(ms[greatest(floor(len(ms) * 0.975)::INTEGER, 1)]), 6) AS hi FROM v JOIN l ON v.g IS NOT DISTINCT FROM l.g GROUP BY v.g""")
def bootstrap_counts(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.round(F.col("n_chars") / 1000, 3).alias("v"))
    found = evaluate.bootstrap_counts(docs, "source", "v", "doc_id", 200, seed=7)
    return found.select("source", *(F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")))


@query()
def bootstrap_exact(spark, d):
    rows = table(spark, d, "labels").select("quality", F.col("toxic").cast("double").alias("v"), "doc_id")
    return evaluate.bootstrap_by(rows, "quality", "v", "doc_id")


_TYPES = "SELECT user_id, list_distinct(list(event_type) FILTER (event_id % 2 = 0)) AS p, list_distinct(list(event_type) FILTER (event_id % 2 = 1)) AS g FROM events GROUP BY user_id"


@query(f"""WITH t AS (SELECT user_id, coalesce(p, []) AS p, coalesce(g, []) AS g FROM ({_TYPES})), s AS (SELECT user_id, len(p) AS np, len(g) AS ng, len(list_intersect(p, g)) AS h FROM t)
SELECT user_id, round(CASE WHEN np = 0 AND ng = 0 THEN 1 ELSE coalesce(1e0 * h / nullif(np, 0), 0) END, 9)::DOUBLE AS precision, round(CASE WHEN np = 0 AND ng = 0 THEN 1 ELSE coalesce(1e0 * h / nullif(ng, 0), 0) END, 9)::DOUBLE AS recall,
round(CASE WHEN np = 0 AND ng = 0 THEN 1 ELSE coalesce(2e0 * h / nullif(np + ng, 0), 0) END, 9)::DOUBLE AS f1 FROM s""")
def set_f1(spark, d):
    half = lambda k: F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type")))
    sets = table(spark, d, "events").groupBy("user_id").agg(half(0).alias("p"), half(1).alias("g"))
    s = sets.select("user_id", graphs.set_scores(F.col("p"), F.col("g")).alias("s"))
    return s.select("user_id", *(F.round(f"s.{k}", 9).alias(k) for k in ("precision", "recall", "f1")))


_MOVES = "SELECT user_id AS graph, event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"
_PATHS = """{n}1 AS (SELECT DISTINCT graph, [src, dst] AS trail FROM {e} WHERE src <> dst), {n}2 AS (SELECT graph, list_append(trail, dst) AS trail FROM {n}1 JOIN {e} USING (graph) WHERE src = trail[-1] AND NOT list_contains(trail, dst)),
{n}3 AS (SELECT graph, list_append(trail, dst) AS trail FROM {n}2 JOIN {e} USING (graph) WHERE src = trail[-1] AND NOT list_contains(trail, dst)), {n} AS (FROM {n}1 UNION FROM {n}2 UNION FROM {n}3)"""


@query(f"WITH m AS ({_MOVES}), pe AS (SELECT DISTINCT graph, src, dst FROM m WHERE dst IS NOT NULL AND event_id % 3 <> 0), ge AS (SELECT DISTINCT graph, src, dst FROM m WHERE dst IS NOT NULL AND event_id % 3 <> 1), " + _PATHS.format(n="p", e="pe") + ", " + _PATHS.format(n="g", e="ge") + """,
r AS (SELECT g.graph, count(*) AS n_gold, count(p.trail) AS n_hit FROM g LEFT JOIN p ON p.graph = g.graph AND p.trail = g.trail GROUP BY g.graph)
SELECT u.graph, coalesce(n_gold, 0) AS n_gold, coalesce(n_hit, 0) AS n_hit, round(coalesce(1e0 * n_hit / n_gold, 1), 9) AS reach FROM (SELECT DISTINCT user_id AS graph FROM events) u LEFT JOIN r ON r.graph = u.graph""")
def reachability(spark, d):
    w = Window.partitionBy("graph").orderBy("ts", "event_id")
    moves = table(spark, d, "events").select(F.col("user_id").alias("graph"), "event_id", "ts", F.col("event_type").alias("src")).withColumn("dst", F.lead("src").over(w))
    edges = moves.filter("dst is not null")
    return graphs.reachability(edges.filter("event_id % 3 <> 0"), edges.filter("event_id % 3 <> 1"), moves).withColumn("reach", F.round("reach", 9))


# --- curves --------------------------------------------------------------------------------------------------------

_CURVE = """
WITH h AS (SELECT event_type AS series, date_trunc('hour', ts) AS hour, round(sum(value), 6) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY hour) - 1 AS step, round(sum(v) OVER (PARTITION BY series ORDER BY hour), 4) AS value FROM h),
p AS (SELECT series, step, value, 100e0 * step / greatest(max(step) OVER (PARTITION BY series), 1) AS pct, first_value(value) OVER w AS f, last_value(value) OVER w AS l FROM s WINDOW w AS (PARTITION BY series ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT series, step, pct, CASE WHEN abs(l - f) < 1e-8 THEN 0 ELSE round((value - f) / (l - f), 9) END AS gain FROM p)
"""


def gains(spark, d) -> DataFrame:
    hourly = table(spark, d, "events").filter("value is not null").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.sum("value"), 6).alias("v"))
    w = Window.partitionBy("series").orderBy("hour")
    s = hourly.select("series", (F.row_number().over(w) - 1).alias("step"), F.round(F.sum("v").over(w), 4).alias("value"))
    s = s.withColumn("pct", 100.0 * F.col("step") / F.greatest(F.max("step").over(Window.partitionBy("series")), F.lit(1)))
    return curves.normalized_gain(s, "series").withColumn("gain", F.round("gain", 9))


@query(_CURVE + "SELECT series, step::INTEGER AS step, round(gain, 6) AS gain FROM g")
def normalized_gain(spark, d):
    return gains(spark, d).select("series", "step", F.round("gain", 6).alias("gain"))


@query(_CURVE + "SELECT series, round(arg_min(pct, step) FILTER (gain >= 0.5), 6) AS t50, round(arg_min(pct, step) FILTER (gain >= 0.9), 6) AS t90 FROM g GROUP BY series")
def emergence(spark, d):
    e = curves.emergence(gains(spark, d), "series")
    return e.select("series", F.round("t50", 6).alias("t50"), F.round("t90", 6).alias("t90"))


@query(_CURVE + """, y AS (SELECT a.step, a.pct, a.gain - b.gain AS y FROM g a JOIN g b USING (step) WHERE a.series = (SELECT min(series) FROM g) AND b.series = (SELECT max(series) FROM g)),
z AS (SELECT 0.5 * (y + lead(y) OVER (ORDER BY step)) * (lead(pct) OVER (ORDER BY step) - pct) AS piece FROM y) SELECT round(coalesce(sum(piece), 0), 4) AS area FROM z""")
def area_between(spark, d):
    g = gains(spark, d)
    ends = g.agg(F.min("series").alias("lo"), F.max("series").alias("hi"))
    named = g.crossJoin(F.broadcast(ends)).withColumn("series", F.when(F.col("series") == F.col("lo"), "a").when(F.col("series") == F.col("hi"), "b")).withColumn("run", F.lit(0))  # ends is one row
    return curves.area(named, "a", "b", "run").select(F.round("area", 4).alias("area"))


# --- nested data ---------------------------------------------------------------------------------------------------


@query("SELECT conv_id, count(*) AS n, sha256(string_agg(role || '|' || coalesce(text, ''), chr(10) ORDER BY turn)) AS sha FROM conversations GROUP BY conv_id")
def chat_messages(spark, d):
    content = F.struct("turn", F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))).alias("content")).alias("m"))
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(content)).alias("messages"))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["m"]["role"], F.lit("|"), m["m"]["content"][0]["text"])), "\n")
    return chats.select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(flat, 256).alias("sha"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props))::INTEGER AS n_keys FROM events")
def json_props(spark, d):
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", F.call_function("get_json_object", F.col("props"), F.concat(F.lit("$."), F.try_element_at(keys, F.lit(1)))).alias("first_value"), F.size(keys).alias("n_keys"))


_TRIPLES = "SELECT o_custkey AS graph, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'c' || o_custkey || chr(9) || lower(o_orderstatus) || chr(9) || 'o' || (o_orderkey % 10) WHEN 1 THEN '(c' || o_custkey || ', ' || lower(o_orderstatus) || ', o' || (o_orderkey % 10) || ')' ELSE '# note ' || o_orderkey END AS line FROM orders"


def triplet_graphs(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    c, s, t = F.concat(F.lit("c"), "o_custkey"), F.lower("o_orderstatus"), F.concat(F.lit("o"), F.col("o_orderkey") % 10)
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("\t", c, s, t)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("("), F.concat_ws(", ", c, s, t), F.lit(")"))).otherwise(F.concat(F.lit("# note "), "o_orderkey"))
    files = o.select(F.col("o_custkey").alias("graph"), F.struct("o_orderkey", line.alias("line")).alias("l")).groupBy("graph").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
    return files.select("graph", graphs.from_triplets(native.triplets(F.col("text"))).alias("scene"))


@query(f"WITH l AS ({_TRIPLES}), t AS (SELECT * FROM l WHERE line NOT LIKE '#%'), n AS (SELECT graph, unnest(['c' || graph, 'o' || (o_orderkey % 10)]) AS name FROM t), c AS (SELECT graph, count(DISTINCT name) AS n_entities FROM n GROUP BY graph) SELECT u.graph, coalesce(n_entities, 0)::INTEGER AS n_entities, coalesce(k, 0)::INTEGER AS n_relations FROM (SELECT DISTINCT graph FROM l) u LEFT JOIN c ON c.graph = u.graph LEFT JOIN (SELECT graph, count(*) AS k FROM t GROUP BY graph) r ON r.graph = u.graph")
def triplets_to_graph(spark, d):
    return triplet_graphs(spark, d).select("graph", F.size("scene.entities").alias("n_entities"), F.size("scene.relations").alias("n_relations"))


@query(f"SELECT graph, 'c' || graph AS src, 'o' || (o_orderkey % 10) AS dst, line_label AS label, count(*) AS n FROM (SELECT *, (SELECT lower(o_orderstatus) FROM orders x WHERE x.o_orderkey = l.o_orderkey) AS line_label FROM ({_TRIPLES}) l) WHERE line NOT LIKE '#%' GROUP BY ALL")
def scene_graph_explode(spark, d):
    return triplet_graphs(spark, d).select("graph", F.explode("scene.relations").alias("r")).groupBy("graph", "r.src", "r.dst", "r.label").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, CASE WHEN o_orderstatus = 'O' THEN 'edge' ELSE lower(o_orderstatus) END AS type, o_orderstatus AS label FROM orders")
def edge_syntax(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", "").otherwise(F.lower("o_orderstatus"))
    edge = F.concat(F.lit("c"), "o_custkey", F.lit(">o"), "o_orderkey", F.lit(":"), kind, F.lit(":"), "o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in native.edge_fields(edge).items()))


# --- generated diagrams --------------------------------------------------------------------------------------------


@query()
def generate_corpus(spark, d):
    return generate.corpus(spark)


@query()
def validate_markup(spark, d):
    rows = generate.corpus(spark).select(F.xxhash64("id").alias("row_pos"), F.concat("id", F.lit(".svg")).alias("filename"), "svg")
    return curate.scan(rows, rows.select(F.lit("-").alias("sha256")).limit(1)).select("id", "bucket", "reject_reason", "sha256", "vfig_clean", "difficulty")


@query("""WITH s AS (SELECT * FROM (VALUES ('train', 2000), ('id', 250), ('ood', 250)) v(split, n)), r AS (SELECT split, n, unnest(range(n)) AS i FROM s)
SELECT CASE WHEN i < n // 2 THEN 'wf_' ELSE 'geo_' END || split || '_' || lpad(i::VARCHAR, 4, '0') AS id, CASE WHEN i < n // 2 THEN 'workflow' ELSE 'geometry' END AS grammar, 1e0 AS entity_f1, 1e0 AS relation_f1, 1e0 AS spatial FROM r""")
def gold_recovery(spark, d):
    from ..functions.markup import with_scene

    rows = with_scene(generate.corpus(spark), col="predicted").withColumn("gold", graphs.from_json(F.col("scene_graph"))).withColumn("graph", F.col("id"))
    e = graphs.set_scores(graphs.entity_keys(F.col("predicted")), graphs.entity_keys(F.col("gold")))["f1"]
    r = graphs.set_scores(graphs.relation_keys(F.col("predicted")), graphs.relation_keys(F.col("gold")))["f1"]
    return graphs.spatial(rows).select("id", "grammar", e.alias("entity_f1"), r.alias("relation_f1"), "spatial")
