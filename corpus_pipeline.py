"""From raw documents to a mixed corpus: each stage reads what its predecessor wrote.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voxelry.llm import decontamination, language_id, line_dedup, mixing, ngram_join
from voxelry.llm.common import written
from voxelry.llm.queries import LINES, NGRAM_JOIN


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no letters)."""
    return language_id.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them."""
    return line_dedup.line_dedup(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each remaining document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

def _on(table: str, sql: str) -> str:
    return re.sub(r"\bdocuments\b", table, sql)


#: Each stage's SQL on the rows of the stage before; for tables with languages to learn and distinct doc_ids.
ORACLE_SQL = rf"""
WITH d1 AS MATERIALIZED (SELECT doc_id, text, source FROM documents WHERE regexp_matches(coalesce(text, ''), '\p{{L}}')),
d2 AS MATERIALIZED (SELECT doc_id, coalesce(kept, '') AS text, source FROM d1 JOIN ({_on("d1", LINES)} SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS kept FROM r GROUP BY doc_id) USING (doc_id)),
d3 AS MATERIALIZED (SELECT * FROM d2 WHERE doc_id IN (SELECT doc_id FROM ({_on("d2", NGRAM_JOIN)}) WHERE class_id = doc_id)),
d4 AS MATERIALIZED (SELECT * FROM d3 WHERE doc_id NOT IN (SELECT doc_id FROM ({_on("d3", decontamination.ORACLE)}) WHERE contaminated))
SELECT * FROM ({_on("d4", mixing.ORACLE)})
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
