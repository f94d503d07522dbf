"""The corpus pipeline: each stage's output is written as Parquet and reread as the next stage's documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sedge.llm.common import Scratch, collect_executors, table
from sedge.llm.decontaminate import drop_contaminated
from sedge.llm.mixing import emitted, mix
from sedge.llm.ngram_join import Rule, keep_one
from sedge.llm.quality import keep_good
from sedge.llm.queries import tokenizer_path
from sedge.llm.token_files import digests, read_tokens, write_tokens


#: Pre-tokens in a generation of a worker's cache: fewer than a job of its own takes, as executors still hold what the
#: stages before needed.
TOKEN_CACHE = 200_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among docs."""
    return keep_good(docs, table(spark, sf_dir, "labels"), cut=0.3)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more): the one with the smallest id."""
    return keep_one(docs, Rule(k=5, num=80, den=100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (80 % of its five-word shingles)."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), k=5, threshold=(80, 100))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as its source's rate and its own draw say."""
    return emitted(mix(docs), docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the token files."""
    path = Scratch(spark).path("tokens")
    write_tokens(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=1, cache=TOKEN_CACHE)
    collect_executors(spark)
    return digests(read_tokens(spark, path))


def fresh(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, begun when executors have given back what the stages before needed."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_executors(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [
    ("quality classifier", fresh(quality_classifier)),
    ("n-gram Jaccard join", fresh(ngram_jaccard_join)),
    ("benchmark decontamination", fresh(benchmark_decontamination)),
    ("mixing sources to target weights", fresh(mixing)),
    ("token-ID output", fresh(token_output)),
]

#: A trained model, a similarity join and a tokenizer are no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if n == len(STAGES) - 1 else scratch.save(out, f"stage{n}")
    return docs
