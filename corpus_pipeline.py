"""A corpus pipeline: five stages over ``documents``, each an operator of the llm subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. ``run`` writes each stage's rows as Parquet and reads them
again, so a stage's lineage ends at files that every executor can read. The files lie in
the folder that ``spark.checkpoint.dir`` names, and stay there for whoever restarts a stage;
what a stage has shuffled is gone when it is written.

In every stage columns may have any names and hold nulls; null and empty texts and null
ids are rows like others; empty tables give no rows. What ties, repeated rows and repeated
ids do is told by each stage's operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm.components import freeing, shared_folder
from factorloom.llm.decontamination import decontaminate
from factorloom.llm.jaccard_groups import keep_one
from factorloom.llm.packing import pack_documents
from factorloom.llm.secret_scan import redact
from factorloom.llm.toxicity import drop_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; without labels, all."""
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id: five-word shingles, a similarity of 0.8. Documents without words are in no group."""
    return keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; each row is judged by its own text."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; a row without one is left as it is."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; a null text is packed as an empty one."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", packing)]

#: trained scores and subword ids are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other."""
    folder = shared_folder(spark)
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/corpus-pipeline-{uuid.uuid4().hex}/{k}-{name}"
        with freeing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
