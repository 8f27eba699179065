"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, byte-level BPE.

A stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns the documents it keeps; the last
one returns their ids' and decoded bytes' digests. Toxic documents go; lines that many documents hold go from all but
the last; of each group of near copies the smallest doc_id stays; documents with a passage of the benchmark go; what is
left is encoded. Each stage's output is written as Parquet and read again, so a lost executor costs one stage at most.

Defined results: null, empty and wordless texts pass all stages but toxicity's, which scores them like any other; a null
doc_id is never learned from, loses no lines and stays unless it is a copy of a document with an id; of repeated rows one
stays; ties and texts of any length are as the operators' modules say; empty tables give an empty result; extra columns,
whatever their names, pass unchanged up to the last stage, which returns ids and digests only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortflow.llm import byte_bpe, decontamination, line_dedup, near_dedup, toxicity
from cohortflow.llm._text import shared_folder

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontamination.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: SQL can't express the classifier; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
    return docs
