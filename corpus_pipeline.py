"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglathe.llm.common import discard, materialise, table, written
from loglathe.llm.decontaminate import drop_leaks
from loglathe.llm.langid import keep_identified
from loglathe.llm.lines import dedup_stage
from loglathe.llm.minhash import drop_near_duplicates
from loglathe.llm.packing import pack_stage

STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", dedup_stage),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack_stage),
]

#: A trained model, signatures and a tokenizer take part: no SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``. A stage's scratch tables and its predecessor's result go when its own result is written."""
    docs, before = table(spark, sf_dir, "documents"), set(written())
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, [path for path in written()[:-1] if path not in before])
    return docs
