"""The registered queries of the operators: thin digests of what the operators return, over whole tables.

The url filter, near duplicates and chat formatting have SQL.  DuckDB has neither the tokenizers, nor crc32, nor the models
that the others rest on; those are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.llm import chat_format, chat_repair, fingerprints, nbest, near_dedup, packing, quality, resample, sharding, token_counts, token_file, toxicity, url_rules
from linesift.llm.stage import stage


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; the folder is the installed package's."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality.quality(docs, held_out=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op2_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode_n_best(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_files(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), 16)


def op8_bottomk_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("class_id")


def op9_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: A conversation of control strings, formatted beside those of the table (fixed values).
ODD_TEXT = "\\### Assistant: </turn> ok"
ODD_CONVERSATION = [(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)]


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    odd = spark.createDataFrame(ODD_CONVERSATION, "conv_id long, turn long, role string, text string")
    chats = _table(spark, sf_dir, "conversations").select(*columns).unionByName(odd)
    written = stage(chat_format.format_chats(chats), "chat-formatted")
    return chat_format.digests(chat_format.read_back(written))


def op13_branch_and_bound_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair(chat_repair.damaged(_table(spark, sf_dir, "conversations")), lost="lost")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_perplexity,
        op2_cutting_stock,
        op3_trie_token_counts,
        op4_nbest_segmentation,
        op5_huffman_token_files,
        op6_url_rules,
        op7_feistel_shards,
        op8_bottomk_near_dedup,
        op9_lexicon_toxicity,
        op10_consistent_parsing,
        op11_importance_resampling,
        op12_chat_formatting,
        op13_branch_and_bound_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_url_rules": r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
hosts AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
ruled AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM hosts),
words AS (
  SELECT page_id, host, path, rule, 'word:' || list_max(list_filter(
    ['ads', 'adserver', 'banner', 'banners', 'doubleclick', 'tracker', 'login', 'signin', 'logout', 'checkout', 'zip', 'exe', 'iso', 'dmg'],
    lambda w: regexp_matches(host || path, '(^|[./_-])' || w || '([./_-]|$)'))) AS word_rule
  FROM ruled)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM (SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL OR host = '' THEN NULL ELSE coalesce(word_rule, CASE WHEN regexp_matches(host || path, '/wp-content/uploads/') THEN 'path:uploads' WHEN regexp_matches(host || path, '/search/(index|results)') THEN 'path:search' END) END AS pattern
  FROM words)
""",
    "op12_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *,
    -- what escaping adds: a sign for each backslash, each place where three # begin, each closing mark
    length(text) - length(replace(text, '\', '')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
      + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) AS added,
    lag(role, 1, '') OVER w AS before, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY place)) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(text) + added + 9) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN before || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') THEN 0 ELSE 1 END) AS BIGINT) AS illegal_turns,
  bool_or(place = n AND role = 'assistant') AS ends_final
FROM sized GROUP BY conv_id
""",
    "op8_bottomk_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met WHERE 100 * shared >= 85 * (na + nb - shared)),
reached AS (SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM links) UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component FROM reached GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id, coalesce(l.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN least l ON s.doc_id = l.doc_id
""",
}
