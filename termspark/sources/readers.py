"""Scans (S1-S7).  All are splittable Spark file sources with explicit schemas (no
inference); nothing is read on the driver and no session setting is changed."""
from __future__ import annotations

import codecs
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termspark.sources.sinks import MANIFEST


def read_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Text lines as ``line STRING``; every line stays, blank ones too.

    Files are cut into splits at line ends on the raw bytes, which is safe for GBK (no
    trail byte is a line end), from any store that Spark reads.  Lines in another
    charset than UTF-8 are decoded batch by batch in the workers, so no session setting is
    needed; what is malformed becomes U+FFFD.
    """
    raw = spark.read.text(paths)
    if encoding.upper().replace("-", "") == "UTF8":
        return raw.select(F.col("value").alias("line"))
    codec = codecs.lookup(encoding).name

    def decode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.decode(codec, "replace") for x in b.column(0).to_pylist()], pa.string())], ["line"])

    return raw.select(F.col("value").cast("binary").alias("line")).mapInArrow(decode, "line string")


def read_word_list(spark: SparkSession, paths: str | Sequence[str], ordered: bool = False) -> DataFrame:
    """S3: concatenated files, blank lines dropped, distinct; entries are not trimmed.

    ``ordered`` adds ``ord``, the place of an entry's first occurrence in the order
    of the files' names and lines (files up to one split; ascending within each).
    """
    from termspark.operators.labels import word_list
    raw = spark.read.text(paths)
    if ordered:
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("line"))
        raw = raw.select("value", place.alias("ord"))
    return word_list(raw, "value")


def _fields(sep: str) -> Column:
    """Fields as Java's split gives them: empty ones at the end are dropped, a line
    without any character is one empty field."""
    value, literal = F.col("value"), re.escape(sep)
    cut = F.regexp_replace(value, f"(?:{literal})+\\z", "")
    return F.when(value == "", F.array(F.lit(""))).when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, literal, -1))


def read_exact_fields(spark: SparkSession, path: str | Sequence[str], names: Sequence[str], types: Sequence[str] | None = None,
                      sep: str = "\t", header: bool = False) -> DataFrame:
    """Lines with exactly ``len(names)`` fields, typed by ``types``; all other
    lines are dropped before anything is cast, and a field that does not parse as its
    type fails the query.  ``header`` drops the first line of each file that has this
    number of fields."""
    rows = spark.read.text(path)
    cols = [_fields(sep).alias("_f")]
    if header:
        cols += [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                 F.monotonically_increasing_id().alias("_line")]
    # a generator's output: the field count is tested before any cast
    x = rows.select(F.inline(F.array(F.struct(*cols)))) if not header else rows.select(*cols)
    x = x.where(F.size("_f") == len(names))
    if header:
        first = x.groupBy("_file").agg(F.min(F.struct("_block", "_line")).alias("_head"))
        x = x.join(first, "_file").where(F.struct("_block", "_line") != F.col("_head"))
    types = types or ["string"] * len(names)
    fields = [F.get("_f", F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate(zip(names, types))]
    return x.select(*fields)


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, header: bool = False) -> DataFrame:
    """Positional TSV with an explicit schema; lines with another number of
    fields are dropped (S6: the header row is skipped, booleans are ``true`` / ``false``)."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return read_exact_fields(spark, path, [f.name for f in fields], [f.dataType.simpleString() for f in fields], header=header)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``term, score, pred`` comma-separated; lines with another number of fields are
    dropped."""
    return read_exact_fields(spark, path, ["term", "score", "pred"], ["string", "double", "double"], sep=",")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, low, high, n) of each part file that :func:`sinks.write_sorted` left with a manifest."""
    return spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}")


def lookup(spark: SparkSession, path: str, schema: str, keys: Sequence[str] = (), between: tuple[str, str] | None = None) -> DataFrame:
    """Rows of a sorted, tab-separated table whose first column is one of ``keys`` or lies
    ``between`` two values (both included): only the part files whose key range may hold
    one are opened.  The driver sees the manifest's rows of these files alone."""
    field = T.StructType.fromDDL(schema).fields[0].name
    keys = list(dict.fromkeys(keys))
    low, high = between or (None, None)
    holds, wanted = F.lit(False), F.lit(False)
    if keys:
        holds = holds | F.exists(F.array(*map(F.lit, keys)), lambda k: (k >= F.col("low")) & (k <= F.col("high")))
        wanted = wanted | F.col(field).isin(keys)
    if between:
        holds = holds | ((F.col("low") <= high) & (F.col("high") >= low))
        wanted = wanted | F.col(field).between(low, high)
    files = [r["file"] for r in read_manifest(spark, path).where(holds).select("file").orderBy("file").collect()]
    return read_tsv(spark, files, schema).where(wanted) if files else spark.createDataFrame([], schema)


def stored(spark: SparkSession, name: str) -> DataFrame:
    """A table of :func:`sinks.store_bucketed`."""
    return spark.table(name)
