"""Registered queries of this subpackage: each applies one operator, with its
production parameters, to the whole table and derives the result's columns."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from larder.llm import (byte_bpe, decontaminate, histogram_shard, license_scan, merkle, quality, simhash, spelling, spotsigs,
                        stream_dedup, substring_dedup, suffix_dedup, token_output)
from larder.llm.common import ship_package

END_ID = 2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _removed(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", _removed("spans").alias("n_removed"),
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spotsigs.with_classes(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next", "length", "edited_length", "class_id", "n_links")


def op3_histogram_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shard.digests(histogram_shard.shard_rows(_read(spark, sf_dir, "documents"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", _removed("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    done = quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    return done.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_bpe.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                     public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.token_folder(spark)
    token_output.write_ids(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_output.read_ids(spark, path).select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    done = merkle.manifest(merkle.leaves(_read(spark, sf_dir, "documents"), tamper=(tampered, "text", lowered)))
    return done.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_read(spark, sf_dir, "documents"))


def op13_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    done = stream_dedup.stream_dedup(spark, f"{sf_dir}/documents.parquet")
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    ship_package(spark)
    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d),
x AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS low FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, p + k AS c FROM (SELECT doc_id, p FROM x JOIN m USING (h) WHERE doc_id > low), range(0, 50) t(k)),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS c FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.c) AS kept, count(*) AS n FROM u ANTI JOIN g USING (doc_id, c) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, len(x) // 2 AS n FROM d),
p AS (SELECT doc_id, unnest(range(0, n - 99)) AS p, x FROM n),
s AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS h FROM p),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM s),
c AS (SELECT doc_id, p, lag(p) OVER w AS before FROM r WHERE k > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
v AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM v),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS gone, max(b) AS stop,
             string_agg(substr(x, 2 * last::BIGINT + 1, 2 * (a - last)::BIGINT), '' ORDER BY a) AS kept
      FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE kept || substr(x, 2 * stop::BIGINT + 1) END)) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)
"""
OP13_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w = 1 AS kept,
       sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_spotsigs, op3_histogram_shard, op4_decontaminate, op5_suffix_dedup,
                            op6_license_scan, op7_simhash, op8_quality, op9_byte_bpe, op10_bit_planes, op11_merkle_manifest, op12_spelling_variants,
                            op13_stream_dedup, pipeline)}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL, "op4_decontaminate": decontaminate.oracle_sql(), "op5_suffix_dedup": OP5_SQL,
    "op6_license_scan": license_scan.oracle_sql(), "op11_merkle_manifest": merkle.oracle_sql(),
    "op12_spelling_variants": spelling.oracle_sql(), "op13_stream_dedup": OP13_SQL}
