"""Queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, divergence, exact, idstore, licenses, mixing, packing, pii, quality, simhash, spelling, urls, warc
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="max")


SQL["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op8_pareto_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


SQL["op8_pareto_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((place - 1) % 3 + 1)::INT] AS weight FROM s
), r AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT min_by(level, ratio) FROM l WHERE ratio >= level)) AS target FROM l
), e AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target,
    least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END, 2.0) AS expect,
    (('0x' || md5('17:' || coalesce(d.doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN expect > floor(expect) AND size > 0 THEN (u / (1 - u)) / ((expect - floor(expect)) / (1 - (expect - floor(expect)))) END AS rank FROM e
), c AS (
  SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    target - sum(size * floor(expect)) OVER (PARTITION BY source) AS need FROM q
)
SELECT doc_id, size, source_size, target, (size * (floor(expect) + CASE WHEN rank IS NOT NULL AND upto - size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


@query
def op5_cost_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_id_store(spark, sf_dir):
    return idstore.round_trip(table(spark, sf_dir, "documents"))


@query
def op7_simhash_pivots(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


@query
def op3_warc_index(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL["op3_warc_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to FROM g
"""


@query
def op4_chat_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    return chat.round_trip(rows.unionByName(own))


SQL["op4_chat_parts"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, (length(text) - length(replace(text, '\', ''))) + len(regexp_extract_all(text, '<s>|</s>|<<SYS>>|<</SYS>>|<\||\[INST\]|\[/INST\]')) AS text_more,
    (length(role) - length(replace(role, '\', ''))) + len(regexp_extract_all(role, '<s>|</s>|<<SYS>>|<</SYS>>|<\||\[INST\]|\[/INST\]')) AS role_more
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(role) + role_more + length(text) + text_more)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attached_tokens, sha256('') AS attachments_sha256
FROM e GROUP BY conv_id
"""


@query
def op9_url_rules(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


SQL["op9_url_rules"] = urls.reference_sql()


@query
def op10_repetition_rules(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents")).drop("line_share", "gram_share")


SQL["op10_repetition_rules"] = quality.reference_sql()


@query
def op2_pii_boosting(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op11_license_rules(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


SQL["op11_license_rules"] = licenses.reference_sql()


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


SQL["op12_spelling_variants"] = spelling.reference_sql()


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op13_source_divergence"] = divergence.reference_sql()
