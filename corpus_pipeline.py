"""The corpus pipeline: each stage is written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scriptoria.llm import bin_slack, common, decontaminate, language, line_chunks, near_dup

STAGES = [
    ("language", language.stage),
    ("line_dedup", line_chunks.stage),
    ("near_dedup", near_dup.stage),
    ("decontaminate", decontaminate.stage),
    ("pack", bin_slack.stage),
]

#: SQL can express neither the network, nor chunk boundaries, nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, function) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
