"""Sinks (K1-K3) and stored tables."""
from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder beside the part files; Spark's readers pass over names with an underscore.
MANIFEST = "_manifest"


def write_sorted(df: DataFrame, path: str, order: list[Column], fmt: str = "parquet", sep: str = "\t", manifest: str | None = None) -> None:
    """K1 / K2: globally sorted output: a range-partitioned sort into part files whose
    concatenation is in order (no task ever holds more than its range).

    ``manifest`` names the key column that the table is sorted by and that tab-separated
    files begin with: a table (file, low, high, n) of the keys in each part file is written
    beside them, for ``readers.lookup``."""
    w = df.orderBy(*order).write.mode("overwrite")
    if fmt == "tsv":
        w.options(sep=sep, header="false", quote="").csv(path)
    else:
        w.format(fmt).save(path)
    if manifest:
        spark = df.sparkSession
        rows = spark.read.text(path).select(F.substring_index("value", sep, 1).alias("key"), "_metadata.file_path") if fmt == "tsv" \
            else spark.read.format(fmt).load(path).select(F.col(manifest).alias("key"), "_metadata.file_path")
        rows.groupBy(F.col("file_path").alias("file")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")) \
            .write.mode("overwrite").parquet(f"{path.rstrip('/')}/{MANIFEST}")


def write_lines(df: DataFrame, path: str, partitions: int | None = None, encoding: str = "UTF-8") -> None:
    """K3: one text line per row, optionally repartitioned to ``partitions``
    files (the original used 128).  In another charset than UTF-8 a character that the
    charset lacks becomes ``?``."""
    out = df.repartition(partitions) if partitions else df
    if encoding.upper().replace("-", "") != "UTF8":
        codec = codecs.lookup(encoding).name

        def encode(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([None if x is None else x.encode(codec, "replace") for x in b.column(0).to_pylist()], pa.binary())], ["line"])

        out = out.mapInArrow(encode, "line binary").select(F.col("line").cast("string").alias("value"))
    out.write.mode("overwrite").text(path)


def store_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    """A table in a folder that driver and executors share, in ``buckets`` hash buckets of
    ``key``, sorted within each: joins and aggregations by the key then read it where it
    lies, without an exchange.  Registered as ``name`` in the session's catalog."""
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
