"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. Stages are written
as Parquet and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from whyframe.llm.common import stage, table
from whyframe.llm.decontamination import decontaminate
from whyframe.llm.line_dedup import drop_repeated_lines
from whyframe.llm.ngram_join import keep_one_of_each_group
from whyframe.llm.packing import pack_documents
from whyframe.llm.toxicity import drop_toxic, fit_chain, label_categories


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return drop_toxic(docs, fit_chain(docs, table(spark, sf_dir, "labels"), label_categories(), "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the first occurrence stays; documents that this leaves without any text go."""
    return drop_repeated_lines(docs, length_col="n_chars", drop_emptied=True)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the smallest id stays."""
    return keep_one_of_each_group(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs


#: Trained classifiers and tokenisers can't be said in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
