"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnscope.llm import op1_warc, op2_neardup, op3_licenses, op4_substrings, op5_decontam, op6_quality, op7_packing, op8_ann, op9_langid, op10_sharding
from txnscope.llm import op11_topk, op12_align, op13_search
from txnscope.llm.catalog import LlmQuery
from txnscope.llm.common import table


def op1_warc_round_trip(spark, sf_dir):
    return op1_warc.warc_round_trip(spark, table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r
"""


def op2_near_duplicates(spark, sf_dir):
    return op2_neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM documents
          UNION SELECT r.doc_id, t.b FROM reach r JOIN two t ON t.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op3_licenses_scan(spark, sf_dir):
    return op3_licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op10_shard_bytes(spark, sf_dir):
    out = op10_sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_passages(spark, sf_dir):
    return op4_substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op5_contaminated(spark, sf_dir):
    return op5_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_classify(spark, sf_dir):
    return op6_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pack(spark, sf_dir):
    return op7_packing.pack_digest(table(spark, sf_dir, "documents"))


def op9_language(spark, sf_dir):
    return op9_langid.identify(table(spark, sf_dir, "documents"))


def op8_nearest(spark, sf_dir):
    return op8_ann.search(table(spark, sf_dir, "embeddings"))


def op11_top(spark, sf_dir):
    return op11_topk.search(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


def op12_pairs(spark, sf_dir):
    return op12_align.align(table(spark, sf_dir, "documents"))


def op13_ranked(spark, sf_dir):
    return op13_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n, ws FROM w WHERE len(ws) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
t AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM t, g GROUP BY term),
i AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT r, doc_id, 75 + (25 * n * nn) // ll AS m FROM d, g),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM i JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM k WHERE n <= 20
"""


QUERIES = [
    LlmQuery("op1_warc", op1_warc_round_trip, OP1_SQL),
    LlmQuery("op2_neardup", op2_near_duplicates, OP2_SQL),
    LlmQuery("op3_licenses", op3_licenses_scan),
    LlmQuery("op4_substrings", op4_passages),
    LlmQuery("op5_decontam", op5_contaminated),
    LlmQuery("op6_quality", op6_classify),
    LlmQuery("op7_packing", op7_pack),
    LlmQuery("op8_ann", op8_nearest),
    LlmQuery("op9_langid", op9_language),
    LlmQuery("op10_sharding", op10_shard_bytes),
    LlmQuery("op11_topk", op11_top, OP11_SQL),
    LlmQuery("op12_align", op12_pairs),
    LlmQuery("op13_search", op13_ranked, OP13_SQL),
]
