"""The corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.pipeline_stages import drop_near_copies, drop_repeated_lines, drop_toxic, pack
from millrace.llm.shared import documents, stage

STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("packing", pack)]

#: SQL has no tokenizers and no iterated fingerprint links; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
