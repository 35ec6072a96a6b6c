"""A training corpus in five stages: quality rules, line dedup, near duplicates, decontamination, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns documents with the same
columns; the last returns doc_id, n_tokens and ids. Between stages the documents are written to the shared
folder and read again, so a lost executor costs the tasks it ran and no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohort_spark.llm import bpe, decontamination, line_dedup, ngram_join, quality_rules
from cohort_spark.llm.common import cut, read

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard", ngram_join.stage),
    ("decontamination", decontamination.stage),
    ("bpe", bpe.stage),
]

#: SQL can express neither string tiling nor byte pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. An empty table gives an empty result with the same columns."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
