"""The ten operators' queries and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontam, html_text, langid, mixing, neardup, secret_scan, sharding, token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1,
        "op2_secret_ledger": secret_scan.op2,
        "op3_chat_roles": chat.op3,
        "op4_winnowing": decontam.op4,
        "op5_line_blocks": html_text.op5,
        "op6_byte_network": langid.op6,
        "op7_projection_tree": ann.op7,
        "op8_token_grammar": token_store.op8,
        "op9_signature_join": neardup.op9,
        "op10_sharding": sharding.op10,
    }


_OP1 = """
WITH held AS (SELECT source, count(*)::DOUBLE AS held, sqrt(count(*)::DOUBLE) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(held) FROM held) * weight / (SELECT sum(weight) FROM held) / held AS rate FROM held),
parts AS (SELECT source, greatest(1, ceil(rate / 16.0))::INT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS mean FROM rates),
terms AS (SELECT source, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM parts, range(0, 96) AS r(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM terms),
tables AS (SELECT source, list(f ORDER BY k) AS f FROM cdf GROUP BY source),
draws AS (
  SELECT doc_id, d.source, part,
    (('0x' || substr(md5('29:' || doc_id || CASE WHEN parts > 1 THEN ':' || part ELSE '' END), 1, 15))::BIGINT::DOUBLE + 0.5) / 1152921504606846976.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, parts + 1)) AS part)),
counted AS (SELECT doc_id, draws.source, sum(len(list_filter(f, lambda x: x <= u)))::INT AS copies
  FROM draws JOIN tables ON draws.source IS NOT DISTINCT FROM tables.source GROUP BY doc_id, draws.source),
copied AS (SELECT doc_id, copies, unnest(range(0, copies))::INT AS copy FROM counted)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copies, copy, ('0x' || substr(md5('30:' || d.doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM copied JOIN documents d ON copied.doc_id = d.doc_id
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, lengths)),
hits AS (SELECT doc_id, item_id, i, places.n FROM places JOIN windows USING (n, span)),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words ON d.doc_id = hit_words.doc_id LEFT JOIN hit_items ON d.doc_id = hit_items.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": _OP1, "op4_winnowing": _OP4}
