"""The corpus queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import chat, decontaminate, langid, neardup, packing, quality, sharding, substrings, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_chat_format": chat.op4_chat_format,
    "op5_jump_shards": sharding.op5_jump_shards,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_warc": warc.op8_warc,
    "op9_language_id": langid.op9_language_id,
    "op10_minhash_near_dedup": neardup.op10_minhash_near_dedup,
}

#: Where SQL can express an operator; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM words WHERE len(w) >= 20),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM places),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM ranked, (SELECT unnest(range(0, 20)) AS j) WHERE r > 1),
each AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM words),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN left_over USING (doc_id)""",
    "op4_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn><body></turn>') + 1
                + length(replace(replace(role, '&', '&amp;'), '<', '&lt;'))
                + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op6_decontaminate": r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM folded, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
met AS (SELECT doc_id, n, i, item FROM doc_windows JOIN item_windows USING (n, k)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op8_warc": r"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last_id FROM payloads)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to, true AS whole
FROM grouped""",
}
