"""The thirteen thin queries ``opN_<name>`` and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (
    decontaminate, exact_dedup, hard_negatives, license_scan, lm_score, merkle, mixing, near_dup, quality_cnn, span_dedup, suffix_dedup, token_orc, url_lists,
)
from panelcast.llm.util import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_license_scan", license_scan.oracle())
def op1(spark, d):
    return license_scan.scan(table(spark, d, "documents")).drop("matches")


@register("op2_span_dedup")
def op2(spark, d):
    return span_dedup.remove_repeats(table(spark, d, "documents"))


@register("op3_token_orc")
def op3(spark, d):
    return token_orc.token_output(table(spark, d, "documents"), tokenizer_path())


@register(
    "op4_mixing",
    """WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS wt FROM s),
fill AS (SELECT 0 AS step, 1.5 * (SELECT sum(source_size) FROM s) AS pot, (SELECT sum(wt) FROM w)::DOUBLE AS whole, []::BIGINT[] AS capped
  UNION ALL
  SELECT step + 1, pot - 2.0 * n.size, whole - n.wt, list_concat(capped, n.ks) FROM fill,
  LATERAL (SELECT coalesce(sum(source_size), 0) AS size, coalesce(sum(wt), 0) AS wt, list(k) AS ks FROM w WHERE NOT list_contains(fill.capped, k) AND fill.pot * wt / fill.whole > 2.0 * source_size) n
  WHERE n.wt > 0),
f AS (SELECT * FROM fill ORDER BY step DESC LIMIT 1),
g AS (SELECT w.*, CASE WHEN list_contains(f.capped, k) THEN 2.0 * source_size ELSE f.pot * wt / f.whole END AS target FROM w, f),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size * 16777216) AS BIGINT) END AS rate,
  CAST('0x' || substr(md5(coalesce(source, '') || CASE WHEN source IS NULL THEN '?' ELSE '=' END || '7'), 1, 6) AS BIGINT) AS u FROM g),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INT), md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7'), doc_id NULLS LAST) AS place FROM d)
SELECT p.doc_id, p.size, r.source_size, CAST(r.target AS DOUBLE) AS target, p.size * (((place * rate + u) >> 24) - (((place - 1) * rate + u) >> 24)) AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source""",
)
def op4(spark, d):
    got = mixing.plan_copies(table(spark, d, "documents"), keep=("doc_id",))
    return got.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


@register(
    "op5_url_lists",
    """WITH c AS (SELECT page_id, url, ((page_id * 7919) % 365) AS day, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages),
hosts AS (SELECT DISTINCT h, CAST('0x' || substr(md5(h), 1, 4) AS BIGINT) AS n, CAST('0x' || substr(md5(h), 5, 4) AS BIGINT) % 300 AS day FROM c WHERE h <> ''),
pp AS (SELECT DISTINCT h || '/' || p[1] AS key FROM c WHERE h <> '' AND len(p) > 0),
e AS (SELECT h AS key, day, 'block' AS action FROM hosts WHERE n % 3 = 0 UNION ALL SELECT h, day + 90, 'allow' FROM hosts WHERE n % 6 = 0
  UNION ALL SELECT h, 0, 'block' FROM hosts WHERE h LIKE '%cheap-pills%'
  UNION ALL SELECT key, CAST('0x' || substr(md5(key), 5, 4) AS BIGINT) % 300, 'block' FROM pp WHERE CAST('0x' || substr(md5(key), 1, 4) AS BIGINT) % 5 = 0),
o AS (SELECT key, day, max(action) AS action FROM e GROUP BY 1, 2),
i AS (SELECT key, action, day AS since, lead(day, 1, 2932896) OVER (PARTITION BY key ORDER BY day) AS until FROM o),
l AS (SELECT DISTINCT page_id, url, day, h, p, string_split(h, '.') AS ls FROM c),
k AS (SELECT page_id, url, day, array_to_string(ls[j : len(ls)], '.') AS key, len(ls) - j AS rank FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS j FROM l WHERE h <> '')
  UNION ALL SELECT page_id, url, day, h || '/' || array_to_string(p[1 : j], '/'), 1000 + j FROM (SELECT *, unnest(range(1, least(len(p), 2) + 1)) AS j FROM l WHERE h <> '')),
m AS (SELECT page_id, url, k.day, rank, k.key, action FROM k JOIN i ON k.key = i.key AND k.day >= since AND k.day < until),
b AS (SELECT page_id, url, day, count(*) AS n_active, arg_max(key, rank) AS decided_by, arg_max(action, rank) AS action FROM m GROUP BY 1, 2, 3),
n AS (SELECT page_id, url, day, count(*) AS n_captures FROM c GROUP BY 1, 2, 3)
SELECT n.page_id, n.url, n.day, n_captures, coalesce(n_active, 0) AS n_active, decided_by, action, action IS DISTINCT FROM 'block' AS kept
FROM n LEFT JOIN b ON n.page_id = b.page_id AND n.url = b.url AND n.day = b.day""",
)
def op5(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return url_lists.evaluate(pages.withColumn("day", url_lists.capture_day(F.col("page_id"))), url_lists.derived_entries(pages))


@register(
    "op6_near_dup",
    """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS sh FROM d),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.root) AS component_id, n.doc_id = min(r.root) AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2""",
)
def op6(spark, d):
    return near_dup.near_duplicates(table(spark, d, "documents"), n=4).select("doc_id", "n_shingles", "component_id", "kept")


@register("op7_decontaminate")
def op7(spark, d):
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@register("op8_lm_score")
def op8(spark, d):
    held = lm_score.held_out(F.col("doc_id"))
    got = lm_score.score(table(spark, d, "documents"), ~held)
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op9_quality_cnn")
def op9(spark, d):
    docs = table(spark, d, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, d, "labels")))


@register(
    "op10_exact_dedup",
    """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t""",
)
def op10(spark, d):
    return exact_dedup.exact_dedup(table(spark, d, "documents"))


@register("op11_suffix_dedup")
def op11(spark, d):
    return suffix_dedup.remove_repeats(table(spark, d, "documents")).drop("kept")


@register(
    "op12_merkle_manifest",
    """WITH RECURSIVE f AS (SELECT *, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc,
  concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head FROM documents),
l AS (SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS other FROM f),
r AS (SELECT doc_id, lang, leaf, coalesce(other, leaf) AS other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS k, i, n, leaf AS h FROM r UNION ALL SELECT lang, k + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, k, i // 8),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS k, i, n, h FROM s UNION ALL SELECT k + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 8),
tn AS (SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM t WHERE n > 1 WINDOW w AS (PARTITION BY lang, k, i // 8 ORDER BY i)),
un AS (SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM u WHERE n > 1 WINDOW w AS (PARTITION BY k, i // 8 ORDER BY i)),
x AS (SELECT lang, i AS row_no, 0 AS k, i, n, other AS h, '' AS proof FROM r UNION ALL SELECT x.lang, row_no, x.k + 1, x.i // 8, (x.n + 7) // 8, sha256(a || x.h || b), proof || a || b FROM x JOIN tn ON x.n > 1 AND x.lang IS NOT DISTINCT FROM tn.lang AND x.k = tn.k AND x.i = tn.i),
y AS (SELECT x.lang, row_no, 0 AS k, s.i, s.n, x.h, proof FROM x JOIN s ON x.n = 1 AND x.lang IS NOT DISTINCT FROM s.lang UNION ALL SELECT lang, row_no, y.k + 1, y.i // 8, (y.n + 7) // 8, sha256(a || y.h || b), proof || a || b FROM y JOIN un ON y.n > 1 AND y.k = un.k AND y.i = un.i)
SELECT r.doc_id, r.leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, y.h AS folded_root, y.h = u.h AS verified
FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang JOIN u ON u.n = 1 JOIN y ON y.n = 1 AND y.lang IS NOT DISTINCT FROM r.lang AND y.row_no = r.i""",
)
def op12(spark, d):
    return merkle.manifest(table(spark, d, "documents"), tamper=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


@register(
    "op13_hard_negatives",
    """WITH e AS (SELECT row_number() OVER () AS n, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.n AS a, a.id AS anchor_id, b.n AS b, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.n <> b.n),
g AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) <= 5)
SELECT g.anchor_id, g.id AS positive_id, CAST(row_number() OVER (PARTITION BY g.a, g.b ORDER BY p.score DESC, p.id NULLS LAST) AS INT) AS rank, p.id AS negative_id, g.score AS positive_score, p.score AS negative_score
FROM g JOIN p ON g.a = p.a AND NOT p.same AND 30 * g.score <= 100 * p.score AND 100 * p.score <= 90 * g.score QUALIFY rank <= 10""",
)
def op13(spark, d):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, d, "embeddings"), label=shifted)
