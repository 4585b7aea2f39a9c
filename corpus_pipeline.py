"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, BPE encoding.

All stages take documents with any further columns, whatever their names, and hand them on (the last returns digests only); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm import bpe
from genolith.llm.common import stored, table
from genolith.llm.lines import dedup_lines
from genolith.llm.mixing import mix
from genolith.llm.neardup import near_duplicates
from genolith.llm.quality import quality
from genolith.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null, empty or blank text has too few words and goes; null keys are judged like others but never trusted; repeated rows get equal verdicts and stay repeated. Without
    labels only the base rules decide.
    """
    return quality(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeated runs of lines; those of which nothing but blanks is left go.

    Null and empty texts have nothing to remove and stay. Rows with equal key and text are one document: they lose the same lines. Null keys come last, equal keys are ordered by the text's hash.
    """
    out = dedup_lines(docs)
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that near-dedup keeps: one document of each group of near-duplicates, the one with the smallest key.

    Of rows that repeat a key each has its own verdict, found by the text's hash; identical rows stay together. Null keys, null texts and texts without words are in no group and stay.
    """
    verdict = near_duplicates(docs.select("doc_id", "text"), tie="_tie")
    gone = stored(verdict.where("not kept").select(F.col("doc_id").alias("_gone"), "_tie").distinct())  # null keys are kept, hashes are never null
    few = gone.count() <= 1_000_000  # 16 bytes each; more are matched by a shuffled join
    same = (F.col("doc_id") == F.col("_gone")) & (F.xxhash64("text") == F.col("_tie"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by calibrated probabilities.

    Rows without words go; null sources and languages count as "". Equal key and text give equal answers.
    """
    return mix(docs).where("kept").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of token ids of each document and digests of them and of the decoded text, one row for each row; a null text has no ids."""
    out = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mix_stage),
    ("bpe", bpe_stage),
]
#: BPE ids can't be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
