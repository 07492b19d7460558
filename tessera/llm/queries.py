"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.decontaminate import contained_items
from tessera.llm.html_extract import extract_pages
from tessera.llm.importance import resample
from tessera.llm.jaccard import jaccard_components
from tessera.llm.line_dedup import line_digest
from tessera.llm.minhash import near_duplicates
from tessera.llm.quality import Limits, quality_rules
from tessera.llm.secrets import scan_secrets
from tessera.llm.segment import sample_segmentations
from tessera.llm.suffix_dedup import suffix_dedup
from tessera.llm.trie import conversation_trie
from tessera.llm.warc import round_trip
from tessera.llm.whitening import whiten_embeddings


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = Limits()
    found = quality_rules(table(spark, sf_dir, "documents"), limits)
    shares = [F.get("dup_ngram_chars", F.lit(i)).alias(f"dup_chars_{k}") for i, (k, _) in enumerate(limits.dup_ngram_chars)]
    return found.select(*(c for c in found.columns if c not in ("dup_ngram_chars", "base_failed", "kept")), *shares, "base_failed", "kept")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), with_ids=True)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_jaccard_join, op3_decontamination, op4_html_extraction, op5_warc_salvage, op6_sentencepiece_sampling, op7_secret_scan, op8_line_dedup, op9_importance_resampling, op10_suffix_dedup, op11_whitening, op12_conversation_trie, op13_minhash_dedup)}

_WORD = r"[^\x20\x09-\x0D]+"


def _secret_sql() -> str:
    """Spans of each kind by what stands between its matches; a match of `assign` counts by its second group."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
    kinds = [("assign", f"(?i){assign}", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    more = [("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?-----END [A-Z ]*PRIVATE KEY-----)?"), ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}"), ("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), ("cloud", r"\bAIza[A-Za-z0-9_-]{35}")]
    kinds += [(k, rule, 0, 0) for k, rule in more]
    found = " UNION ALL ".join(f"SELECT r, {i} AS k, '{k}' AS kind, regexp_extract_all(t, '{rule}') AS ms, regexp_split_to_array(t, '{rule}') AS gs, regexp_extract_all(t, '{rule}', {group}) AS xs, {least} AS least FROM d" for i, (k, rule, group, least) in enumerate(kinds))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
m AS (SELECT r, k, kind, i, len(gs[i]) AS gap, len(ms[i]) AS size, len(xs[i]) >= least AS ok FROM f, range(1, len(ms) + 1) x(i)),
s AS (SELECT r, k, kind, ok, (sum(gap + size) OVER (PARTITION BY r, k ORDER BY i))::BIGINT AS e, size FROM m),
g AS (SELECT r, k, e - size AS s, kind || ':' || (e - size) || ':' || e AS said FROM s WHERE ok)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN g USING (r) GROUP BY d.r, d.doc_id"""


def _links_sql(k: int) -> str:
    """Components of documents whose sets of k-word shingles share 85 % of their union."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= {k} THEN [array_to_string(ws[i:i + {k - 1}], ' ') FOR i IN range(1, len(ws) - {k - 2})] WHEN len(ws) > 0 THEN ['short ' || array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 185 * count(*) >= 85 * ((SELECT n.n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n.n FROM n WHERE n.doc_id = b.doc_id))
), r AS (
  SELECT doc_id, doc_id AS reach FROM documents
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id"""


SQL: dict[str, str] = {
    # A member's path is a list of turns; nodes are its prefixes. crc32 goes bit by bit.
    "op12_conversation_trie": r"""
WITH o AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT *, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT FOR i IN range(8)]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 6)::BIGINT AS h FROM o
), p AS (
  SELECT a.c, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS path FROM h a LEFT JOIN o b ON b.c = a.c - a.c % 100
), k AS (SELECT c, path, d, path[1:d] AS k FROM p, range(0, len(path) + 1) x(d)),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(path) = d) AS ends FROM k GROUP BY k, d),
ch AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
s AS (
  SELECT f.k[1:u] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(CASE WHEN f.d = 0 THEN 0 ELSE (n_convs - 1) * len(f.k[f.d].t) END)::BIGINT AS saved_tokens
  FROM f, range(0, f.d + 1) x(u) GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, CASE WHEN f.d > 0 THEN up.conv_id END AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (k) LEFT JOIN n up ON f.d > 0 AND up.k = f.k[1:f.d - 1]""",
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
p AS (SELECT r, i, len(ws[i]) AS n FROM d, range(1, len(ws) + 1) x(i)),
g AS (SELECT r, k, i, hash(ws[i:i + k - 1]) AS g FROM d, (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS k), range(1, len(ws) - k + 2) x(i)),
again AS (SELECT r, k, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k, g) AS c, row_number() OVER (PARTITION BY r, k, g ORDER BY i) AS rn FROM g) WHERE c > 1 AND (k = 3 OR rn > 1)),
covered AS (SELECT DISTINCT r, k, i + j AS i FROM again, range(0, k) x(j)),
shares AS (SELECT r, k, count(*) AS words, sum(n) AS chars FROM covered JOIN p USING (r, i) GROUP BY r, k),
l AS (SELECT r, i, line, list_sum([len(w) FOR w IN regexp_extract_all(line, '{_WORD}')]) AS n FROM (SELECT r, i, string_split(t, chr(10))[i] AS line FROM d, range(1, len(string_split(t, chr(10))) + 1) x(i)) WHERE regexp_matches(line, '{_WORD}')),
ll AS (SELECT r, count(*) AS n_lines, count(*) FILTER (rn > 1) AS n_dup_lines, sum(n) FILTER (rn > 1) AS dup_line_chars FROM (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) AS rn FROM l) GROUP BY r),
s AS (SELECT r, {", ".join(f"max(chars) FILTER (k = {k}) AS dup_chars_{k}" for k in (5, 6, 7, 8, 9, 10))}, max(words) FILTER (k = 3) AS n_repeat_words FROM shares GROUP BY r),
x AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum([len(w) FOR w IN ws]), 0)::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {", ".join(f"coalesce(dup_chars_{k}, 0)::BIGINT AS dup_chars_{k}" for k in (5, 6, 7, 8, 9, 10))},
    coalesce(n_lines, 0) AS n_lines, len(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, len(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
  FROM d LEFT JOIN ll USING (r) LEFT JOIN s USING (r)
), y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT * EXCLUDE (n_lines, upper, letters), NOT base_failed AND NOT (n_dup_lines > 0.3::DOUBLE * n_lines OR dup_line_chars > 0.2::DOUBLE * word_chars OR n_symbols > 0.1::DOUBLE * n_words OR upper > 0.6::DOUBLE * letters OR greatest({", ".join(f"dup_chars_{k}" for k in (5, 6, 7, 8, 9, 10))}) > 0.2::DOUBLE * word_chars) AS kept
FROM y""",
    "op7_secret_scan": _secret_sql(),
    "op2_jaccard_join": _links_sql(4),
    "op13_minhash_dedup": f"SELECT *, doc_id = component_id AS kept FROM ({_links_sql(5)})",
    "op5_warc_salvage": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT hex, max(page_id) AS keeper FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN k USING (hex)""",
    "op3_decontamination": r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(string_split(trim(regexp_replace(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')), ' '), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT kind, id, sh FROM (SELECT kind, id, unnest([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) AS sh FROM w WHERE len(ws) >= 5)
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n) AS n_item_shingles, count(*) AS n_shared
FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.sh = i.sh JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(n.n)""",
}
