"""Queries of the training-data operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from .common import documents
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .html_text import extract_pages
from .jaccard_join import jaccard_components, jaccard_links
from .lm_scoring import score_documents
from .media import media_column
from .packing import pack_documents
from .pii import detect
from .sharding import shard_documents
from .sp_sampling import sampled_encodings
from .spelling import spelling_variants
from .toxicity import classify
from .warc import archive_pages


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))


def op1_ngram_jaccard_links(spark, sf_dir):
    return jaccard_links(documents(spark, sf_dir))


def op2_lm_scoring(spark, sf_dir):
    return score_documents(documents(spark, sf_dir))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


def op4_pii(spark, sf_dir):
    return detect(documents(spark, sf_dir))


def op5_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))


def op6_toxicity(spark, sf_dir):
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_html_extraction(spark, sf_dir):
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_sharding(spark, sf_dir):
    return shard_documents(documents(spark, sf_dir))


def op9_media_columns(spark, sf_dir):
    return media_column(documents(spark, sf_dir))


def op10_sentencepiece(spark, sf_dir):
    return sampled_encodings(documents(spark, sf_dir))


def op11_warc(spark, sf_dir):
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_filter_audit(spark, sf_dir):
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_spelling(spark, sf_dir):
    return spelling_variants(documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest([array_to_string(l[i:i + 3], ' ') for i in range(1, greatest(len(l) - 3, 1) + 1)]) AS s FROM w WHERE len(l) > 0)),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
hit AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y FROM hit JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sz ON sz.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) g ON g.x = d.doc_id
"""

OP1_LINKS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest([array_to_string(l[i:i + 3], ' ') for i in range(1, greatest(len(l) - 3, 1) + 1)]) AS s FROM w WHERE len(l) > 0)),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
hit AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT x, y, c = p.n AND c = q.n AS same FROM hit JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
class AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(y), d.doc_id)) AS k FROM documents d LEFT JOIN link ON x = d.doc_id AND same GROUP BY d.doc_id),
degree AS (SELECT x, count(DISTINCT k) AS n_links FROM link JOIN class ON class.doc_id = y WHERE NOT same GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN sz ON sz.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) g ON g.x = d.doc_id LEFT JOIN degree ON degree.x = d.doc_id
"""

OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT n, count(*) AS group_size, first(doc_id ORDER BY length(x) DESC, doc_id) AS keep_id FROM t GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.n) AS text_sha256 FROM t JOIN g ON t.n = g.n
"""

OP11_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT h, n, max(page_id) AS best FROM d WHERE n >= 1000 GROUP BY h, n)
SELECT d.page_id, d.n AS payload_bytes, d.h AS payload_digest, CASE WHEN d.page_id < best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN d.page_id < best THEN best END AS refers_to
FROM d LEFT JOIN k ON k.h = d.h AND k.n = d.n
"""

OP12_SQL = r"""
WITH t AS (
  SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents d),
least_id AS (SELECT x, min(doc_id) AS m FROM t GROUP BY x),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(if(len(w) < 200, 'A', ''), if(100 * len(list_distinct(w)) < 50 * len(w), 'B', ''), if(100 * length(regexp_replace(t.x, '[^A-Z]', '', 'g')) > 3 * length(t.x), 'C', ''),
      if(regexp_matches(t.x, '[#$%&*|]'), 'D', ''), if(t.doc_id > m, 'E', '')) AS fails
  FROM t JOIN least_id USING (x) LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT concat(a1.x, a2.x, a3.x, a4.x, a5.x) AS filter_order FROM a a1, a a2, a a3, a a4, a a5
  WHERE len(list_distinct([a1.x, a2.x, a3.x, a4.x, a5.x])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM o),
r AS (
  SELECT part, filter_order, step, fails, n, good, toxic, contains(fails, substr(filter_order, step, 1)) AS here, translate(left(filter_order, step - 1), fails, '') <> left(filter_order, step - 1) AS gone,
    fails = substr(filter_order, step, 1) AS alone, substr(filter_order, step, 1) AS flt FROM c, s),
q AS (
  SELECT part, filter_order, step, flt, sum(if(NOT here AND NOT gone, n, 0))::BIGINT AS kept, sum(if(here AND NOT gone, n, 0))::BIGINT AS removed, sum(if(here AND gone, n, 0))::BIGINT AS redundant,
    sum(if(alone, n, 0))::BIGINT AS unique_fails, sum(if(here AND NOT gone, good, 0))::BIGINT AS good_lost, sum(if(here AND NOT gone, toxic, 0))::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, flt),
v AS (SELECT part, flt, sum(removed)::BIGINT AS shapley FROM q GROUP BY part, flt)
SELECT q.part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM q JOIN v ON v.part = q.part AND v.flt = q.flt
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS tab FROM (SELECT unnest(range(256)) AS b)),
runs AS MATERIALIZED (
  SELECT doc_id, r, count(*) AS n, encode(concat(doc_id, ':', r)) AS b FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)
  GROUP BY doc_id, r),
hashed AS (
  SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT for i in range(octet_length(b))]),
    lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]))) AS h FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word AS x, b.word AS y, b.n AS m FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.s = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.s = b.word),
best AS (SELECT x, count(*) AS n_near, first(y ORDER BY m DESC, y) AS y, max(m) AS m FROM near GROUP BY x),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN y END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best ON x = word),
walk(word, here) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.here AS root, f.n, f.n_near, f.form_n FROM walk JOIN forms e ON e.word = walk.here AND e.form IS NULL JOIN forms f ON f.word = walk.word
"""

QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op1_ngram_jaccard_links": op1_ngram_jaccard_links, "op2_lm_scoring": op2_lm_scoring, "op3_exact_dedup": op3_exact_dedup, "op4_pii": op4_pii, "op5_packing": op5_packing, "op6_toxicity": op6_toxicity, "op7_html_extraction": op7_html_extraction, "op8_sharding": op8_sharding, "op9_media_columns": op9_media_columns, "op10_sentencepiece": op10_sentencepiece, "op11_warc": op11_warc, "op12_filter_audit": op12_filter_audit, "op13_spelling": op13_spelling}
ORACLE_SQL = {"op1_ngram_jaccard": OP1_SQL, "op1_ngram_jaccard_links": OP1_LINKS_SQL, "op3_exact_dedup": OP3_SQL, "op11_warc": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_spelling": OP13_SQL}
