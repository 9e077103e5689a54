"""From documents to packed token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in
the shared folder and reads it again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm import decontaminate, minhash, mixing, packing, quality
from inkstone.llm.common import free, settle, table


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    It learns from the labels of its input outside fold 1 of 3, which stays held out.  Null,
    empty and very long texts are scored whole like any other; repeated rows and null ids
    are judged row by row; without labels every row stays; an empty table stays empty; all
    columns come through whatever their names.
    """
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; 5-word shingles, similarity 0.8.

    Rows with a null id and texts without words (null, empty) stay; of rows that share an id
    all stay or none; very long texts count whole; an empty table stays empty; all columns
    come through whatever their names.
    """
    found = minhash.near_duplicates(docs, k=5)
    key = free(docs.columns, "gone")
    gone = settle(found.where("not kept and id is not null").select(F.col("id").alias(key)).distinct())
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, of items of three words or more.

    Rows with a null id or text stay; of rows that share an id all stay or none; every word
    of a very long text is compared; with an empty benchmark every row stays; an empty table
    stays empty; all columns come through whatever their names.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens have the target shares of sources, languages and topics.

    Null sources and languages are values of their own; texts without words add no tokens
    and go; repeated rows with one id share a decision if their cells do; every word of a
    very long text counts; an empty table stays empty; all columns come through whatever
    their names.
    """
    return mixing.sample(docs)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids.

    Null texts have no segment, empty ones only their end mark; repeated rows and null ids
    are packed as they come; very long texts are cut into pieces without loss; an empty
    table gives an empty result; other columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither a fitted classifier nor packing by best fit; tests compare with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
