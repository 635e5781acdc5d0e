"""The registered queries of the training-data operators: thin views of each operator's result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bytebpe, chat, langid, media, packing, quality, simhash, tokencount, urlfilter, warc
from palimpsest.llm.common import shared_dir, table


def op1_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.to_media(table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


#: (verdict, host/path) rules of op4.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.conversations(chat.events_of(turns)))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bytebpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(warc.captures(table(spark, sf_dir, "pages"), least_bytes=0), path)
    found = warc.transactions(warc.read(spark, path, with_block=False))
    return found.select(
        warc.page_id(F.col("capture_id")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.computed_digest", "response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        warc.page_id(F.col("response.refers_to")).alias("refers_to"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_webp": op1_media_webp,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_url_filters": op4_url_filters,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
}

_URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)(\??[^#]*)(#?[\s\S]*)$"

#: FP-growth's rules written out: every combination of a URL's tokens that enough blocked URLs have, counted with and
#: without the label.
_OP4 = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u, contains(coalesce(url, ''), '://') AS ok,
    translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path
  FROM pages
), cut AS (
  SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS segments FROM parts
), named AS (
  SELECT *, CASE WHEN NOT ok THEN [] ELSE list_filter(list_concat([
    'scheme:' || nullif(regexp_extract(u, '^([\s\S]*?)://', 1), ''),
    'domain:' || nullif(regexp_extract(host, '([^.]*\.)?[^.]*$', 0), ''),
    'label:' || CASE WHEN len(labels) > 2 THEN nullif(labels[1], '') END,
    'depth:' || CAST(least(len(segments) - 1, 9) AS VARCHAR),
    'query:' || nullif(regexp_replace(regexp_extract(u, '{_URL}', 3), '=[^&]*', '', 'g'), ''),
    CASE WHEN regexp_extract(u, '{_URL}', 4) <> '' THEN 'fragment:#' END
  ], list_transform(range(1, len(labels) - 1), lambda k: 'host:' || array_to_string(labels[k:], '.')),
  list_transform(range(2, len(segments) + 1), lambda k: 'path' || CAST(k - 1 AS VARCHAR) || ':' || nullif(regexp_replace(segments[k], '[0-9]+', '#', 'g'), ''))
  ), lambda x: x IS NOT NULL) END AS tokens FROM cut
), marks AS (
  SELECT doc_id, max(toxic) > 0 AS block FROM labels GROUP BY doc_id HAVING max(toxic) IS NOT NULL
), labelled AS (
  SELECT r, tokens, block FROM named JOIN marks ON page_id = doc_id
), least AS (
  SELECT CASE WHEN count(*) < 20 THEN 1e18 ELSE ceil(greatest(0.001, 20 / count(*)) * count(*)) END AS need FROM labelled
), often AS (
  SELECT token FROM (SELECT unnest(tokens) AS token, block FROM labelled) GROUP BY token HAVING count(*) FILTER (WHERE block) >= (SELECT need FROM least)
), reduced AS (
  SELECT r, block, list(token ORDER BY token) AS items FROM (SELECT r, block, unnest(tokens) AS token FROM labelled) JOIN often USING (token) GROUP BY r, block
), combos AS (
  SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items, block FROM (SELECT items, block, unnest(range(1, 1 << len(items))) AS m FROM reduced)
), rules AS (
  SELECT items FROM combos GROUP BY items
  HAVING count(*) FILTER (WHERE block) >= (SELECT need FROM least) AND count(*) FILTER (WHERE block) / count(*) >= 0.6
), fired AS (
  SELECT DISTINCT r FROM named, rules WHERE list_has_all(tokens, items)
), fits AS (
  SELECT r, v, rule FROM named, (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(v, h, p), (SELECT '') s(x), LATERAL (SELECT h || p AS rule)
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM fits GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN fired.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN best USING (r) LEFT JOIN fired USING (r)
"""

_ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

_OP6 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len("<s>[INST]  [/INST]") + 1 + len("</s>") + 1}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

_OP8 = """
WITH own AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY h) AS first FROM own
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM named
"""

#: The base columns word for word; windows are compared as text.
_OP10 = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, range(8) t(k) GROUP BY r
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM split LEFT JOIN covered USING (r)
), failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (word_chars < 2 * n_words OR word_chars > 16 * n_words) AND NOT (100 * n_dup_lines > 30 * n_lines) AS kept
FROM failed
"""

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": _OP4,
    "op6_chat_formatting": _OP6,
    "op8_warc": _OP8,
    "op10_quality_rules": _OP10,
}
