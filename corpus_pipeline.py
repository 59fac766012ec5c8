"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of documents; the
last returns the packed pieces. Null texts count as empty; rows with a null id pass the near-duplicate stage, as they cannot be
linked. Columns beside doc_id and text are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import decontaminate, near_dedup, packing, secret_scan, toxicity
from placeloom.llm.common import stored, table


#: The likeness from which documents are near-duplicates here (op10 has its own), and the collections for which the expected
#: recall of a link at exactly that likeness is above 99.9 %.
PERCENT, PIPELINE_COLLECTIONS = 80, 20


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones among docs."""
    return toxicity.ordinary(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Of rows equal in id and text, one; rows that share
    an id but not a text are documents of their own."""
    return near_dedup.survivors(docs, PERCENT, PIPELINE_COLLECTIONS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mark; n_chars follows the text."""
    found = secret_scan.scan(docs, keep_rest=True)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.when(F.size("spans") > 0, secret_scan.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    cols = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"_rest{i}") for i, c in enumerate(rest)}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return found.select(*[cols[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the models nor the tokenizer; tests/llm compares the near-duplicate stage with brute force and checks planted
#: rows in the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
