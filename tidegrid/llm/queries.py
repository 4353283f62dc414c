"""The queries of this subpackage and their SQL, under the names that __spark_entry__.py registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import align, counts, idstore, licenses, maxent, mixing, packing, quality, setsketch, urlrules, vamana, variants, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The rules that the contract of op10 fixes.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_vamana_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read_back(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op6_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"))


#: The end id that the contracts of op7 and op9 fix.
END_ID = 2


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, 1024)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.encode_and_read_back(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


OP10_SQL = """
WITH rules(host, path, verdict) AS (VALUES %s),
p AS (SELECT row_number() OVER () AS r, page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
labels AS (SELECT DISTINCT len(string_split(host, '.')) AS k FROM rules),
lengths AS (SELECT DISTINCT length(path) AS n FROM rules),
size AS (SELECT r, (SELECT count(*) FROM labels WHERE k <= len(string_split(p.host, '.'))) * (SELECT count(*) FROM lengths WHERE n <= length(p.path)) AS n_expressions FROM p),
m AS (SELECT r, q.host || q.path AS rule, q.verdict, row_number() OVER (PARTITION BY r ORDER BY length(q.host || q.path) DESC) AS k
  FROM p JOIN rules q ON (p.host = q.host OR ends_with(p.host, '.' || q.host)) AND starts_with(p.path, q.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, n_expressions
FROM p JOIN size USING (r) LEFT JOIN m ON p.r = m.r AND m.k = 1""" % ", ".join(str(r) for r in URL_RULES)

#: Components of links (a, b), both ways, by the least that each reaches.
_REACHED = "r(node, reach) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach), c AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)"

OP1_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1), {_REACHED}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id"""

OP3_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to, url FROM f"""

OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.x = y.x AND x.doc_id <> y.doc_id AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
{_REACHED}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON c.node = doc_id"""

#: The CRC-32 of `<id>:<run>` by a table, made from the polynomial; words one edit apart by what is left of them without one letter.
OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list(list_reduce([i::BIGINT] || list_transform(range(8), lambda x: x::BIGINT), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM counted, crc),
spelled AS (SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT word, n, unnest(range(length(word))) AS k FROM w),
r AS (SELECT word, n, k, word[1 : k] || word[k + 2 :] AS rest FROM d),
pairs AS (SELECT x.word, y.word AS other, y.n AS other_n FROM r x JOIN r y USING (rest, k) WHERE x.word <> y.word
  UNION SELECT r.word, w.word, w.n FROM r JOIN w ON r.rest = w.word UNION SELECT w.word, r.word, r.n FROM r JOIN w ON r.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
path(word, root) AS (SELECT word, word FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.root WHERE f.form IS NOT NULL),
ends AS (SELECT path.word, path.root FROM path JOIN f ON f.word = path.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"""

QUERIES: dict[str, Query] = {
    "op1_vamana_dedup": op1_vamana_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_warc_archive": op3_warc_archive,
    "op4_quality_rules": op4_quality_rules,
    "op5_setsketch_dedup": op5_setsketch_dedup,
    "op6_maxent_scores": op6_maxent_scores,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_mix_sources": op8_mix_sources,
    "op9_token_ids": op9_token_ids,
    "op10_url_filter": op10_url_filter,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_token_counts": op13_token_counts,
}
SQL: dict[str, str] = {
    "op1_vamana_dedup": OP1_SQL,
    "op3_warc_archive": OP3_SQL,
    "op5_setsketch_dedup": OP5_SQL,
    "op2_license_scan": licenses.scan_sql(),
    "op10_url_filter": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
}
