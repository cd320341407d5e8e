"""From raw documents to token ids: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaitspark.llm.bpe_automaton import bpe_stage
from gaitspark.llm.common import table
from gaitspark.llm.decontamination import decontamination_stage
from gaitspark.llm.line_dedup import line_stage
from gaitspark.llm.ngram_join import jaccard_stage
from gaitspark.llm.quality_rules import quality_stage
from gaitspark.session import materialize

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", bpe_stage),
]

#: SQL can't express BPE; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that pass all stages; each stage works on the table that the one before it left.

    Null and empty texts fail the quality rules and go. Rows with a null id are documents of their own, in no group of
    copies; rows that repeat an id and a text stay together. Columns that aren't read are carried to the last stage,
    whatever their names; an empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
