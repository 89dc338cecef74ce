"""The training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes a
stage's result as Parquet into the folder that driver and executors share and reads
it again for the next one.  All stages but the last keep the columns of documents, whatever
others there are; an empty table stays empty in every stage:

1. toxicity            documents with a score of 0.7 or more go (operator 8)
2. near_duplicates     one document of each group stays (operator 4)
3. decontamination     documents that hold a benchmark item go (operator 6)
4. personal_data       findings in the text become <KIND> (operator 7)
5. byte_level_bpe      token ids of each text, and the hash of what they decode to (operator 5)
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termspark.llm import bpe, pii, toxicity
from termspark.llm.common import table
from termspark.llm.decontaminate import decontaminate
from termspark.llm.near_dup import keep_one
from termspark.session import checkpoint_dir

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Rows of an Arrow batch: whole texts pass the workers, so Spark's 10,000 would be large.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows of an Arrow batch, for this and later queries of it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 by a model fitted on the labelled ones among them.  A null or
    empty text has the score of a text without cues; repeated rows are judged alike."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id (of
    repeated rows one, of rows without ids any).  Documents without words all stay."""
    small_batches(spark)
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; those without text stay, and repeated rows stay
    or go together."""
    small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows the new text.  All rows stay, and a
    null text stays null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document row; a null or empty text
    has no tokens."""
    small_batches(spark)
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.round_trip(docs, path, public_tokenizers.PATTERN), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("byte_level_bpe", tokenize),
]

#: A conditional random field and SuperMinHash have no SQL; tests/llm holds brute force instead.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows.

    Between stages documents lie in the folder that the session names in
    ``spark.checkpoint.dir``; without one this raises an error.  A stage's table goes when
    the next one is written; the last one stays, for the result's rows are read from it when
    they are asked for."""
    shared = checkpoint_dir(spark)
    if not shared:
        raise ValueError("the session names no shared folder (spark.checkpoint.dir)")
    folder = f"{shared.rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                _remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
