"""The registered queries of the operators, each over the whole table it is meant for, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    centroids,
    language_id,
    packing,
    pii,
    quality,
    secret_scan,
    simhash,
    spelling,
    substrings,
    token_count,
    token_files,
    topk,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode(_read(spark, sf_dir, "documents"), *where, with_decoded=True)
    return tokens.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.held_out(documents).where("not held_out").drop("held_out"))
    marked = language_id.held_out(documents.select("doc_id", "text"))
    return language_id.predict(marked, model, ("doc_id", "held_out"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_read(spark, sf_dir, "documents"), flaw_every=199))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.read(token_files.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


def _centroids_sql(clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The rounds one after the other, all distances of a round in one join."""
    whole = "sum(CAST((x.v - c.v) * (x.v - c.v) AS BIGINT))"
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dims}),
long AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS d, unnest(v) AS v FROM kept),
c0 AS MATERIALIZED (SELECT id, unnest(range({dims})) AS d, unnest(v) AS v FROM (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS id, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) <= {clusters}))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM (
  SELECT vec_id, id, CAST({whole} AS BIGINT) AS distance FROM long x JOIN c{r} c USING (d) GROUP BY vec_id, id) GROUP BY vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT id, d, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM c{r} LEFT JOIN (
  SELECT id, d, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM long JOIN a{r} USING (vec_id) GROUP BY id, d) USING (id, d))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(id AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY id) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT id, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY id)
  USING (id)"""


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_topk": op3_topk,
    "op4_languages": op4_languages,
    "op5_secrets": op5_secrets,
    "op6_substrings": op6_substrings,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_spelling": op11_spelling,
    "op12_token_files": op12_token_files,
    "op13_centroids": op13_centroids,
}
SQL: dict[str, str] = {"op13_centroids": _centroids_sql()}
