"""The corpus pipeline: five operators in a row, each on all that its predecessor kept.

The stages after line dedup see the lines that it left. Near duplicates are judged before benchmark hits, so one document of
a group is enough to scan; the last stage turns what is left into token ids.

Defined cases: null and empty texts and texts under ten words go with the quality rules; equal rows are copies of one document; a null
source is a host; columns beside the documents' own are carried to the last stage, whatever their names; without documents every
stage gives no rows, and without benchmark items none goes for them. Tables between the stages are deleted once the next is written, but for
the one that the result reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stavelake.llm import bpe, decontamination, line_dedup, near_dedup, quality_rules
from stavelake.llm.common import Scratch, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rejected documents go; boilerplate lines leave the others."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the earliest of equal or nearly equal lines stays."""
    return line_dedup.without_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near duplicates stays."""
    return near_dedup.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents with a benchmark window go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of every text, with digests of the ids and of the text decoded from them."""
    return bpe.tokenized(docs, *bpe.public_vocabulary(), with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmark), ("byte bpe", tokens)]

#: Components of a similarity graph and token merges have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-2]:
            docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        docs = written(STAGES[-2][1](spark, docs, sf_dir), STAGES[-2][0].replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
