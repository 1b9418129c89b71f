"""A training-corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm import line_dedup, mixing, packing, quality, simhash, token_counts
from tarnwick.llm.common import documents
from tarnwick.session import delete, new_path, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_stage(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut from the texts; documents with nothing left go."""
    return line_dedup.line_dedup_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles alike by 0.8) the document with the least id stays."""
    return simhash.near_copies_stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources has them: not at all, once or twice."""
    return mixing.mix_stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches, by the tokens of the vocabulary file."""
    import public_tokenizers

    return packing.pack(token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")), length="n_tokens")


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("simhash near-dedup", near_dedup), ("source mixing", mix_sources), ("packing", pack)]

#: Components and the choice of bucket bounds are iterative; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is written, then its own intermediate tables and its input go."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
