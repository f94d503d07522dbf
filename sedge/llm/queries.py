"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.common import Scratch, table
from sedge.llm.decontaminate import FIND_SQL, find_items
from sedge.llm.embedding_dedup import LINK_SQL, link_vectors
from sedge.llm.line_dedup import DEDUP_SQL, dedup_lines
from sedge.llm.mixing import MIX_SQL, mix
from sedge.llm.ngram_join import JOIN_SQL, Rule, join_documents
from sedge.llm.pii import find_pii
from sedge.llm.quality import score_quality
from sedge.llm.token_counts import count_tokens
from sedge.llm.token_files import digests, read_tokens, write_tokens
from sedge.llm.toxicity import score_toxicity


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, threshold=(80, 100))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return digests(read_tokens(spark, path))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_words=50)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"), Rule(k=3, num=90, den=100))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_decontaminate, op3_token_files, op4_line_dedup, op5_quality, op6_toxicity, op7_mixing, op8_pii, op9_ngram_join, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": LINK_SQL, "op2_decontaminate": FIND_SQL, "op4_line_dedup": DEDUP_SQL, "op7_mixing": MIX_SQL, "op9_ngram_join": JOIN_SQL}
