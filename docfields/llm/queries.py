"""The registered queries of this subpackage: thin steps from the given tables to the operators and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm import collocations, contamination, filter_audit, near_entries, packing, pieces, quality, repeated_lines, repeated_passages, repeated_text, url_rules, vector_search, word_pieces


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("full_text"))


def _sha(values: Column) -> Column:
    return F.sha2(F.array_join(values, ","), 256)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.benchmark_matches(_entries(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("entry_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        _sha(F.array_sort(F.col("item_ids").cast("array<string>"))).alias("items_sha256"), "contaminated")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encoded_entries(_entries(spark, sf_dir), model_path())
    return coded.select(
        F.col("entry_id").alias("doc_id"), F.size("token_ids").cast("bigint").alias("n_tokens"),
        _sha(F.col("token_ids").cast("array<string>")).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeated_lines.deduplicated_lines(_entries(spark, sf_dir))
    return kept.select(F.col("entry_id").alias("doc_id"), F.col("full_text").alias("text"), "n_removed_lines")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_text.repeated_spans(_entries(spark, sf_dir))
    return found.select(
        F.col("entry_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages.near_duplicate_passages(_entries(spark, sf_dir))
    return found.withColumnsRenamed({"entry_id": "doc_id", "of_entry_id": "of_doc_id"})


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest_vectors(
        _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, key="vec_id", vector="embedding")


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("entry_id"), F.col("url").alias("image_url"))
    return url_rules.judged_urls(pages, URL_RULES).withColumnRenamed("entry_id", "page_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = word_pieces.word_piece_vocabulary([p for p, _, kind in pieces.read_pieces(model_path()) if kind == 1])
    return word_pieces.token_counts(_entries(spark, sf_dir), vocabulary).withColumnRenamed("entry_id", "doc_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_id"), "quality")
    return quality.quality_scores(_entries(spark, sf_dir), labels).withColumnRenamed("entry_id", "doc_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_entries.near_duplicate_entries(_entries(spark, sf_dir))
    return found.select(
        F.col("entry_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "documents").select(F.col("text").alias("full_text"), "lang")
    return collocations.collocations(texts, group="lang", no_group="und")


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("entry_id"), F.col("text").alias("full_text"), F.col("lang").alias("template_id"))
    judged = _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("entry_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filter_audit.filter_interactions(entries, judged)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(_entries(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(pieces.select(
        F.col("entry_id").alias("doc_id"), "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_url_filters": op7_url_filters,
    "op8_token_counts": op8_token_counts,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_best_fit_packing": op13_best_fit_packing,
}

# SQL cannot say the other methods at this size; tests/llm holds each query against a brute-force version.
ORACLES: dict[str, str] = {"op12_filter_interaction_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM texts),
failed AS (
  SELECT doc_id, part,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM split),
judged AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed LEFT JOIN judged USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
bits AS (
  SELECT filter_order, step, 1 << (ascii(substr(filter_order, step::INT, 1)) - 65) AS bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::INT, 1)) - 65))), 0)::BIGINT AS earlier
  FROM steps),
totals AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM masks CROSS JOIN bits GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM totals
"""}
