"""Registered queries of the corpus operators and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm import alignment, bpe, licenses, secrets, tokenstore
from genolith.llm.common import shared_path, table
from genolith.llm.embeddings import near_vectors
from genolith.llm.html import extract
from genolith.llm.lines import dedup_lines
from genolith.llm.mixing import mix
from genolith.llm.neardup import near_duplicates
from genolith.llm.negatives import hard_negatives
from genolith.llm.quality import quality
from genolith.llm.urls import ORACLE as URL_SQL
from genolith.llm.urls import RULES, rule_table, url_filter


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed; they are never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    tokenstore.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    out = tokenstore.read_tokens(spark, path)
    return out.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return docs


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, moved = F.col("embedding"), F.col("vec_id") % 7 == 0
    rows = table(spark, sf_dir, "embeddings").where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = rows.select("vec_id", F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("vec"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


HARD_NEGATIVES_SQL = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as vec
    from embeddings
    where label is not null and vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0
),
scored as (
    select a.vec_id as anchor_id, a.label as own, b.vec_id as other, b.label, cast(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])) as bigint) as score
    from rows a join rows b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.vec) = len(b.vec)
),
positives as (select anchor_id, other as positive_id, score as positive_score from scored where label = own qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as integer) as rank, s.other as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> s.own and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_url_filter": op2_url_filter, "op3_licenses": op3_licenses, "op4_html": op4_html, "op5_embeddings": op5_embeddings, "op6_line_dedup": op6_line_dedup, "op7_mixing": op7_mixing, "op8_token_store": op8_token_store, "op9_minhash": op9_minhash, "op10_bpe": op10_bpe, "op11_secrets": op11_secrets, "op12_alignment": op12_alignment, "op13_hard_negatives": op13_hard_negatives}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": URL_SQL, "op3_licenses": licenses.oracle(), "op13_hard_negatives": HARD_NEGATIVES_SQL}
