"""The queries of this subpackage and what DuckDB can say about them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat_format, line_dedup, media_chunks, mixing, quality, sharding, simhash, substring_dedup, token_files, turn_repair, window_packing
from .sql import clustering_sql, repair_sql

BYTE_BPE, WORD_BPE, WORD_BPE_IDS, END_ID, PACKED_END_ID = "byte_bpe_50k.json", "word_bpe_49k.json", 49_408, 1, 2


def tokenizer(name: str) -> str:
    """Where the installed tokenizer files are; operators take such a path as a parameter."""
    return importlib.import_module("public_tokenizers").path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.read_media(*media_chunks.store_media(documents(spark, sf_dir)))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.round_trip(turns.unionByName(own))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer(BYTE_BPE)
    coded = bpe.decode_ids(bpe.encode_texts(documents(spark, sf_dir).select("doc_id", "text"), path), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 16)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = token_files.write_token_files(documents(spark, sf_dir), tokenizer(WORD_BPE), END_ID, WORD_BPE_IDS)
    return token_files.read_token_files(manifest, folder, WORD_BPE_IDS)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack(documents(spark, sf_dir), tokenizer(WORD_BPE), PACKED_END_ID)


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_substring_dedup, op2_media_columns, op3_chat_formatting, op4_bpe, op5_sharding, op6_line_dedup, op7_token_files, op8_simhash, op9_mixing, op10_quality, op11_packing, op12_clustering, op13_conversation_repair)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


SUBSTRING_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spots AS (SELECT r, doc_id, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50),
win AS (SELECT spots.r, spots.doc_id, spots.i, md5(array_to_string(list_slice(w, spots.i, spots.i + 49), ' ')) AS k FROM spots JOIN split USING (r)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
lost AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM split WHERE r IN (SELECT r FROM lost)),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN gone ON word.r = gone.r AND word.p = gone.p GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM split LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
made AS (SELECT *, len(text) + len(regexp_extract_all(text, '###|</turn>')) AS body, text LIKE '%###%' OR text LIKE '%</turn>%' AS hard FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + len(role) + 2 + body + 9) AS BIGINT) AS formatted_chars, count(*) FILTER (hard) AS escaped_turns
FROM made GROUP BY conv_id
"""

MIXING_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM doc GROUP BY source),
wts AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w FROM src),
tot AS (SELECT sum(source_size)::DOUBLE AS t FROM src),
fill AS (
  SELECT 0 AS step, no, w, source_size, NULL::DOUBLE AS capped FROM wts
  UNION ALL
  SELECT step + 1, no, w, source_size, coalesce(capped, CASE WHEN free * w / unit > 3.0 * source_size THEN 3.0 * source_size END)
  FROM (SELECT *, (SELECT t FROM tot) - sum(coalesce(capped, 0)) OVER () AS free, sum(CASE WHEN capped IS NULL THEN w END) OVER () AS unit FROM fill) WHERE step < 25),
tgt AS (SELECT no, coalesce(capped, ((SELECT t FROM tot) - sum(coalesce(capped, 0)) OVER ()) * w / sum(CASE WHEN capped IS NULL THEN w END) OVER ()) AS target FROM fill WHERE step = 25),
laid AS (SELECT doc.*, source_size, wts.no, target, sum(size) OVER (PARTITION BY wts.no ORDER BY md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), size, doc_id ROWS UNBOUNDED PRECEDING) - size AS ofs
         FROM doc JOIN wts ON doc.source IS NOT DISTINCT FROM wts.source JOIN tgt ON tgt.no = wts.no)
SELECT doc_id, size, source_size, target,
       CAST(coalesce((SELECT sum(greatest(0, least(size, least(CAST(round(target) AS BIGINT), 3 * source_size) - (e * source_size + ofs)))) FROM (VALUES (0), (1), (2)) v(e)), 0) AS BIGINT) AS taken
FROM laid
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRING_SQL, "op3_chat_formatting": CHAT_SQL, "op9_mixing": MIXING_SQL, "op12_clustering": clustering_sql(), "op13_conversation_repair": repair_sql()}
