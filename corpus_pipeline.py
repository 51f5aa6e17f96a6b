"""The training-data pipeline: identify languages, drop near duplicates, mask personal data, mix the sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next one's docs. All
but the last return the columns of `documents`.

Defined results, stage by stage as the operators' own: a null or empty text is rejected by the first stage (it has no language);
rows without an id are documents like others, rows equal in id and text one document; a tie in a group of near duplicates goes
to the smallest id; very long texts are worked on whole, in one row; extra columns, whatever their names, are carried along up
to packing, which reads doc_id and text alone; an empty table gives empty tables all the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import common, jaccard, langid, mixing, packing, pii

STAGES = [
    ("language_id", langid.stage),
    ("near_duplicates", jaccard.stage),
    ("personal_data", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Language models, and tokenizers that SQL engines lack, are part of it. Each stage's operator is tested against brute force by
#: itself, and the pipeline against its stages one after the other.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each stage's rows are written to the shared checkpoint folder and read again. A stage's rows
    are removed when the next one's are written; the last stage reads its input before it returns, and leaves only its own."""
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        before = None
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                common.remove_folder(spark, before)
            before = f"{folder}/{name}"
        return common.cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        common.remove_folder(spark, folder)
