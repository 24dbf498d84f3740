"""The queries of the training-data operators, each over its whole table, and SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docsieve.llm import bpe, conversation_trie, fill_in_middle, jaccard_join, language_id, line_dedup, packing, quality_rules, secret_scan, substring_dedup, token_store, topk_search, warc
from docsieve.sources import tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op7(_table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op1(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    return packing.op2(_table(spark, sf_dir, "documents"), tokenizer)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> DataFrame:
    return bpe.op4(_table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op5(_table(spark, sf_dir, "pages"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.op6(_table(spark, sf_dir, "embeddings"))


def op8_token_store(spark: SparkSession, sf_dir: str, tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    return token_store.op8(_table(spark, sf_dir, "documents"), tokenizer)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op9(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.op11(_table(spark, sf_dir, "conversations"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op12(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.op13(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_warc": op5_warc,
    "op6_topk_search": op6_topk_search,
    "op8_token_store": op8_token_store,
    "op9_secret_scan": op9_secret_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_line_dedup": op12_line_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def _secret_sql() -> str:
    """The secret scan for DuckDB: runs of each kind by splitting, windows of a candidate one row each."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = [(k, kind, pattern, group) for k, (kind, pattern, group, _) in enumerate(secret_scan.BASE)]
    kinds += [(len(kinds) + k, kind, pattern, 0) for k, (kind, _, pattern, _, _) in enumerate(secret_scan.CLASSES)]
    runs = " UNION ALL ".join(
        f"""SELECT r, {k} AS ord, '{kind}' AS kind, ms[i] AS v, length(gs[i]) AS size,
            coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
        FROM (SELECT r, ms, gs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT r, regexp_extract_all(t, {quoted(pattern)}) AS ms, regexp_extract_all(t, {quoted(pattern)}, {group}) AS gs,
                   string_split_regex(t, {quoted(pattern)}) AS ps
            FROM d WHERE regexp_matches(t, {quoted(pattern)})))"""
        for k, kind, pattern, group in kinds
    )
    base = " OR ".join(f"(ord = {k} AND size >= {least})" for k, (_, _, _, least) in enumerate(secret_scan.BASE))
    fit = " OR ".join(
        f"(ord = {len(secret_scan.BASE) + k} AND {' AND '.join(f'regexp_matches(v, {quoted(h)})' for h in holds)}"
        f" AND NOT regexp_matches(v, {quoted('|'.join(secret_scan.ALLOW))}))"
        for k, (_, _, _, holds, _) in enumerate(secret_scan.CLASSES)
    )
    limit = " ".join(f"WHEN {len(secret_scan.BASE) + k} THEN {secret_scan.sum_limit(bits)}" for k, (*_, bits) in enumerate(secret_scan.CLASSES))
    width, terms = secret_scan.WINDOW, secret_scan._TERMS[1:]
    label = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
runs AS (SELECT *, s + length(v) AS e FROM ({runs})),
base AS (SELECT * FROM runs WHERE {base}),
likely AS (SELECT *, row_number() OVER () AS c FROM runs WHERE {fit}),
windows AS (SELECT c, w, unnest(string_split(substr(v, w, {width}), '')) AS ch
            FROM (SELECT c, v, unnest(range(1, length(v) - {width - 2})) AS w FROM likely)),
sums AS (SELECT c, w, sum(({terms})[n]) AS total FROM (SELECT c, w, ch, count(*) AS n FROM windows GROUP BY ALL) GROUP BY ALL),
more AS (SELECT likely.* EXCLUDE (c) FROM likely JOIN (SELECT c, min(total) AS best FROM sums GROUP BY c) USING (c)
         WHERE best <= CASE ord {limit} END),
clear AS (SELECT * FROM more m WHERE NOT EXISTS (
            SELECT 1 FROM (SELECT * FROM base UNION ALL SELECT * FROM more) o WHERE o.r = m.r AND o.s < m.e AND m.s < o.e AND o.ord < m.ord)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM clear),
sums_by AS (
  SELECT r, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
         string_agg({label}, ',' ORDER BY s, ord, e) FILTER (ord < {len(secret_scan.BASE)}) AS base, string_agg({label}, ',' ORDER BY s, ord, e) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums_by USING (r)"""


_TRIE_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
crc_table AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, c FROM (
      WITH RECURSIVE step(b, k, c) AS (
        SELECT b, 0, b FROM (SELECT unnest(range(256))::BIGINT AS b)
        UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8)
      SELECT b, c FROM step WHERE k = 8))),
c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda s, x: xor(s >> 8, crcs[xor(s & 255, x) + 1])), 4294967295) % 6 AS h,
    conv_id - conv_id % 100 AS base
  FROM (SELECT DISTINCT conv_id FROM t), crc_table),
rebuilt AS (
  SELECT c.conv_id, t.rank AS o, role, text FROM c JOIN t ON t.conv_id = c.base AND t.rank <= h
  UNION ALL SELECT c.conv_id, t.rank + 1000000, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.rank > h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS depth, md5(md5(role) || text) AS d, length(text) AS size FROM rebuilt),
path AS (
  SELECT conv_id, depth, string_agg(d, '') OVER w AS key, size, lead(depth) OVER w IS NULL AS last FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM placed) FROM c),
node AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM path GROUP BY ALL),
kids AS (SELECT key[1:-33] AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
sums AS (
  SELECT key[1:32 * up] AS key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * size) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM full_node) GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN sums USING (key) LEFT JOIN node p ON f.depth > 0 AND p.key = f.key[1:-33]"""


ORACLE_SQL = {
    "op11_conversation_trie": _TRIE_SQL,
    "op12_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT r, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
f AS (SELECT r, doc_id, i, line, k.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM l LEFT JOIN k USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS a, ('0x' || s[9:16])::BIGINT % (n + 1) AS b, ('0x' || s[17:24])::BIGINT % 100 AS c, ('0x' || s[25:32])::BIGINT % 100 AS o FROM d),
f AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN o < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(a, b) AS lo, greatest(a, b) AS hi FROM h),
x AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM x""",
    "op5_warc": """
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM head AND head IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)""",
    "op6_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5""",
    "op9_secret_scan": _secret_sql(),
    "op7_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
triples AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM triples) WHERE n >= 2),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
m AS (
  SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(t, '[^A-Za-z\x{C0}-\x{10FFFF}]', '', 'g')) AS n_letters
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (n_words > 1000000)::INT
    + 8 * (word_chars < 2 * n_words)::INT + 16 * (word_chars > 25 * n_words)::INT + 32 * (10 * n_symbols > n_words)::INT
    + 64 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::INT + 128 * (2 * n_letters < word_chars)::INT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_letters, fail_bits
FROM b""",
}
