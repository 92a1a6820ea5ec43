"""The registered queries of the operators: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audio, filter_audit, fingerprints, langid, mixing, packing, pii, records, sharding, simhash, substrings, toxicity
from .common import table

#: The vocabulary files; paths, never copies.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_features(table(spark, sf_dir, "documents"))


#: Bytes of a shard in op3.
SHARD_BYTES = 1 << 20


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)
    return found.select("doc_id", "n_bytes", "depth", "shard", "shard_bytes", "page", "page_bytes")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = records.write_records(table(spark, sf_dir, "documents"), TOKENIZER)
    return records.read_records(spark, out)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.learn(docs))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_media_columns": op2_media_columns,
    "op3_extendible_sharding": op3_extendible_sharding,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_mix_sources": op7_mix_sources,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_token_records": op10_token_records,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_personal_data": op13_personal_data,
}

#: The rest hashes, trains or draws in ways that SQL has no words for; tests/llm holds it against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_extendible_sharding": f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
 c AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS n FROM d, range(0, 61) t(depth) GROUP BY ALL),
 r AS (SELECT rn, doc_id, n_bytes, h, n, CAST(depth AS INT) AS depth, prefix, CAST(bytes AS BIGINT) AS shard_bytes, row_number() OVER (PARTITION BY rn ORDER BY depth) AS k
  FROM d JOIN c ON prefix = h >> (60 - depth) WHERE bytes <= {SHARD_BYTES} OR depth = 60),
 s AS (SELECT *, shard_bytes > {SHARD_BYTES} AND n > 1 AS crowded, n_bytes > {SHARD_BYTES} / 2 AS big FROM r WHERE k = 1),
 o AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY h, crowded, big ORDER BY n_bytes, doc_id, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before, row_number() OVER (PARTITION BY h, crowded, big ORDER BY n_bytes, doc_id, rn) - 1 AS place,
  sum(CASE WHEN NOT big THEN n_bytes END) OVER (PARTITION BY h, crowded) AS small FROM s),
 p AS (SELECT *, CAST(CASE WHEN NOT crowded THEN 0 WHEN big THEN CASE WHEN small IS NULL THEN 0 ELSE floor(greatest(0, small - 1) / ({SHARD_BYTES} / 2)) + 1 END + place ELSE floor(bytes_before / ({SHARD_BYTES} / 2)) END AS INT) AS page FROM o)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, shard_bytes, page,
 CAST(CASE WHEN crowded THEN sum(n_bytes) OVER (PARTITION BY h, crowded, page) ELSE shard_bytes END AS BIGINT) AS page_bytes FROM p""",
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
 k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS words FROM s),
 r AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY words) > 1),
 c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, 35) t(j)),
 u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
 l AS (SELECT u.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY u.p) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.p = c.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN l ON l.doc_id = d.doc_id""",
    "op12_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 f AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails FROM w),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
 g AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
 c AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
 p AS (SELECT a.letter || b.letter || c3.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c3.bit, d.bit, e.bit] AS bits
  FROM c a, c b, c c3, c d, c e WHERE a.bit | b.bit | c3.bit | d.bit | e.bit = 31),
 s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS before FROM p, range(1, 6) t(k)),
 r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS removed,
  coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0) AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
}
