"""The training-data operators over whole tables: one query each, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookreplay.llm import ann, conversation_repair, html_extract, line_dedup, lm_lattice, mixing, packing, prefix_trie, quality, simhash, token_files, url_filter, warc
from bookreplay.llm.common import table

#: Fixed rules of the contract: verdict, host/path.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: The list of URLs: canonical URLs of the table whose SHA-256 begins with this digit, one in sixteen.
LISTED = "0"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.select(url_filter.canonical(F.col("url")).alias("url")).where(F.sha2("url", 256).startswith(LISTED))
    return url_filter.filter_urls(pages, listed, URL_RULES).drop("maybe")


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(table(spark, sf_dir, "pages"))
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position"
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_lattice.lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.audited(rows, conversation_repair.damaged(rows))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.deduplicated(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: SQL that DuckDB can run, for the queries whose every column SQL can express. The others hash by
#: XXH64, tokenize, train or search approximately; tests hold them against brute-force versions.
HOST = """translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
PARTS = f"""after AS (SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
parts AS (SELECT *, {HOST} AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1) AS query FROM after)"""
ORACLES = {
    "op1_url_filter": f"""WITH {PARTS},
kept AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]*|ref|fbclid|gclid)='))), '&') AS params FROM parts),
canon AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS key FROM kept),
listed AS (SELECT DISTINCT key FROM canon WHERE sha256(key) LIKE '0%' AND key <> ''),
ruled AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7' WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule,
 key IN (SELECT key FROM listed) AS is_listed FROM canon)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict, is_listed FROM ruled""",
    "op2_warc_index": f"""WITH {PARTS},
sized AS (SELECT page_id, url, after, host, path, query, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM parts),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized),
keyed AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again, CASE WHEN host = '' THEN coalesce(nullif(url, ''), '-') ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url_key,
 strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y%m%d%H%M%S') AS captured_at FROM firsts)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to, url_key, captured_at,
 row_number() OVER (ORDER BY url_key, captured_at) - 1 AS position FROM keyed""",
    # The tables' pages keep their text in one article, whose only inline element is b.
    "op9_main_text": """WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM c) SELECT page_id, url, text, length(text) AS n_chars FROM d""",
}


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    octets = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}), 4294967295)"


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES |= {
    # A path for each state that the rows so far may have led to: the least (cost, audit, text), row by row.
    "op11_conversation_repair": f"""WITH RECURSIVE fates AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
struck AS (SELECT *, {crc32_sql('k')} % 20 AS f FROM fates),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM struck WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, trim(text, {SPACES}) AS bare FROM damaged),
judged AS (SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN 'k' ELSE 't' END AS fault,
 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
inserts(s, t, c, e, x) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', 'user:' || chr(10)), (1, 2, 5, 'I', 'user:' || chr(10)), (3, 2, 5, 'I', 'user:' || chr(10)), (2, 3, 5, 'I', 'assistant:' || chr(10)),
 (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
arcs(s, t, c, e, need, said) AS (VALUES (0, 0, 2, 'D', NULL, NULL), (1, 1, 2, 'D', NULL, NULL), (2, 2, 2, 'D', NULL, NULL), (3, 3, 2, 'D', NULL, NULL), (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (3, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL),
 (0, 2, 1, 'R', NULL, 'user'), (1, 2, 1, 'R', NULL, 'user'), (3, 2, 1, 'R', NULL, 'user'), (2, 3, 1, 'R', NULL, 'assistant')),
paths(conv_id, i, s, b) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'line': ''}} FROM judged
 UNION ALL SELECT p.conv_id, p.i + 1, a.t, min({{'cost': p.b.cost + n.c + a.c + CASE WHEN a.e <> 'D' AND r.fault = 't' THEN 5 ELSE 0 END, 'audit': p.b.audit || n.e || a.e, 'line': p.b.line || n.x || CASE WHEN a.e = 'D' THEN '' ELSE coalesce(a.said, r.role) || ':' || r.text || chr(10) END}})
 FROM paths p JOIN inserts n ON n.s = p.s JOIN judged r ON r.conv_id = p.conv_id AND r.i = p.i + 1 JOIN arcs a ON a.s = n.t AND (a.e = 'D' OR r.fault IN ('k', 't')) AND (a.need IS NULL OR a.need = r.initial) GROUP BY p.conv_id, p.i + 1, a.t),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
 count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY conv_id),
best AS (SELECT p.conv_id, min({{'cost': b.cost + n.c, 'audit': b.audit || n.e, 'line': b.line || n.x}}) AS b FROM paths p JOIN counted c ON c.conv_id = p.conv_id AND c.n = p.i JOIN inserts n ON n.s = p.s AND n.t IN (0, 3) GROUP BY p.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
 sha256(coalesce(left(b.line, length(b.line) - 1), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted USING (conv_id) LEFT JOIN best USING (conv_id)""",
    "op12_line_dedup": f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT doc_id, line, i, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id""",
    # A prefix is named by the hash of its turns; a node's smallest member's prefixes are its ancestors.
    "op13_prefix_trie": f"""WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql('k')} % 6 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS k FROM own)),
lent AS (SELECT conv_id, h, (SELECT count(*) FROM own o WHERE o.conv_id = base AND o.i <= h) AS m FROM convs),
made AS (SELECT c.conv_id, o.i AS depth, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h UNION ALL SELECT o.conv_id, m + i - h, role, text FROM own o JOIN lent USING (conv_id) WHERE i > h),
prefixes AS (SELECT conv_id, depth, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS path, length(text) AS chars FROM made WINDOW w AS (PARTITION BY conv_id ORDER BY depth) UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
linked AS (SELECT *, lag(path) OVER w AS up, lead(path) OVER w IS NULL AS is_end FROM prefixes WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (SELECT depth, path, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM linked GROUP BY depth, path),
told AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.up = n.path AND c.depth = n.depth + 1) AS n_children FROM nodes n),
below AS (SELECT a.depth, a.path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM told u JOIN prefixes a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.depth, a.path)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, t.ends_sha256 FROM told t JOIN below b ON b.depth = t.depth AND b.path = t.path LEFT JOIN nodes p ON p.path = t.up AND p.depth = t.depth - 1""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
