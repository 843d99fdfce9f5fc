"""A corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
keep the columns of ``documents``; where a stage changes a text, ``n_chars``
follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import bpe, toxicity
from pulsegrid.llm.common import crc_bucket, stored
from pulsegrid.llm.decontaminate import remove_contamination
from pulsegrid.llm.line_dedup import remove_repeated_chunks
from pulsegrid.llm.queries import VOCABULARY
from pulsegrid.llm.simhash import drop_near_duplicates
from pulsegrid.session import apply_sql_defaults


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below a half."""
    apply_sql_defaults(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels, lambda c: crc_bucket(c, 5) != 0)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; chunks of lines that an earlier one has are cut out."""
    apply_sql_defaults(spark)
    return _recounted(remove_repeated_chunks(docs).select(*docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every SimHash component."""
    apply_sql_defaults(spark)
    return drop_near_duplicates(docs, shingle=3, max_distance=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages of the benchmark are cut out."""
    apply_sql_defaults(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recounted(remove_contamination(docs, benchmark).select(*docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: number and digest of its ids, digest of their text."""
    apply_sql_defaults(spark)
    return bpe.digests(docs, VOCABULARY, ["doc_id"])


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines),
          ("simhash near-dedup", dedup_documents),
          ("benchmark decontamination", decontaminate),
          ("bpe encoding and decoding", tokenize)]

#: The stages learn, hash and tokenize; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_sql_defaults(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
