"""A training corpus from raw documents, in stages that each read what the one before has written.

Quality classifier, exact and near deduplication, mixing by language, packing into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.common import bounded_batches, read
from skyloom.llm.exact_dedup import exact_survivors
from skyloom.llm.mixing import mixed
from skyloom.llm.packing import pack
from skyloom.llm.quality import accepted
from skyloom.llm.queries import LANGUAGE_WEIGHTS, tokenizer_path
from skyloom.llm.simhash import one_of_each
from skyloom.session import remove_scratch, scratch_mark, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    bounded_batches(spark)
    return exact_survivors(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash the one with the smallest id stays."""
    bounded_batches(spark)
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that languages have their shares of tokens; none is drawn twice.

    Half of the tokens are kept at least: a language too scarce for its share of that is taken whole.
    """
    return mixed(docs, read(spark, sf_dir, "labels"), LANGUAGE_WEIGHTS, least_share=0.5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    bounded_batches(spark)
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", packed)]

ORACLE_SQL = None  # fingerprints, classifier and tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage stored for itself is deleted as soon as its result is written."""
    docs, mark = read(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        remove_scratch(spark, mark, [path])
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
