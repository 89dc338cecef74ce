"""Mapping of the pipeline onto the driver's test tables.

The original pipeline mines Chinese text; the test tables hold Latin-script
prose (en/fr/de/es).  The script class, stop list, POS lexicon and rule
lists below are *parameters* of the operators chosen for these tables; they
are shared verbatim by the Spark queries and the DuckDB oracle SQL.

Corpora: background A = ``documents`` with ``lang <> 'en'``; combined
B = all ``documents``.  A line is one ``\\n``-separated piece of ``text``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import not_blank
from termspark.operators import tokenize as tk

SCRIPT_CLASS = tk.LATIN_SCRIPT_CLASS
TOKEN_PATTERN = tk.LATIN_TOKEN_PATTERN

# Parameters for the test tables (invented; not the original's lists).
STOP_WORDS = [
    "the", "a", "an", "is", "was", "are", "le", "la", "les", "un", "une",
    "der", "die", "das", "den", "ein", "eine", "el", "los", "las", "una",
]
POS_LEXICON = {
    "c": ["and", "or", "but", "et", "ou", "mais", "und", "oder", "aber", "y", "o", "pero"],
    "p": ["of", "in", "to", "for", "with", "on", "at", "by", "from", "as", "de", "du", "des",
          "à", "en", "dans", "sur", "pour", "avec", "par", "au", "aux", "von", "mit", "zu",
          "für", "auf", "im", "con", "por", "para", "del"],
    "r": ["it", "he", "she", "they", "we", "this", "that", "il", "elle", "nous", "qui", "que",
          "er", "sie", "es", "wir", "ich", "él", "ella"],
    "u": ["not", "ne", "pas", "nicht", "no"],
    "v": ["has", "have", "had", "were", "be", "est", "sont", "ist", "sind", "war", "son"],
    "f": ["up", "down", "over", "under", "sous", "unter", "über", "sobre"],
    "nr": ["anna", "marie", "hans", "juan"],
}
DEFAULT_POS = "n"
NONSCRIPT_POS = "w"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, n, na): every distinct non-blank line of B with how often it occurs in B and
    in A.  Every statistic over lines starts from this table: text is processed once
    for each distinct line, and the exchange of the aggregation deals the lines out
    over the cluster, however few splits the scan had."""
    docs = table(spark, sf_dir, "documents").select("text", (F.col("lang") != "en").alias("a"))
    lines = docs.select("a", F.explode(F.split("text", "\n")).alias("line")).where(not_blank("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("na"))


def corpus_lines(spark: SparkSession, sf_dir: str, corpus: str = "B") -> DataFrame:
    """Distinct non-blank lines of a corpus with their number of occurrences ``n``."""
    lines = line_counts(spark, sf_dir)
    if corpus == "A":
        return lines.where("na > 0").select("line", F.col("na").alias("n"))
    if corpus != "B":
        raise ValueError(corpus)
    return lines.select("line", "n")


def distinct_lines(spark: SparkSession, sf_dir: str, corpus: str = "B") -> DataFrame:
    """The deduplicated lines the statistics jobs read."""
    return corpus_lines(spark, sf_dir, corpus).select("line")


def tokens_of(df: DataFrame, line_col: str = "line", out: str = "tokens") -> DataFrame:
    """P3 for the test tables: lower-case, regex tokens."""
    return df.withColumn(out, tk.tokenize(F.lower(F.col(line_col)), "regex", TOKEN_PATTERN))


def segmented_lines(spark: SparkSession, sf_dir: str, corpus: str = "B") -> DataFrame:
    """Each distinct line with its token array and number of occurrences ``n``."""
    return tokens_of(corpus_lines(spark, sf_dir, corpus))


def tagged(df: DataFrame, tokens_col: str = "tokens", out: str = "pos") -> DataFrame:
    return df.withColumn(out, tk.pos_tags(tokens_col, POS_LEXICON, DEFAULT_POS, NONSCRIPT_POS,
                                          SCRIPT_CLASS))


def lexicon(spark: SparkSession) -> DataFrame:
    """POS_LEXICON as a table (word, pos, ord): the first listed tag has the least ord."""
    rows = [(w, p, i) for i, (p, words) in enumerate(POS_LEXICON.items()) for w in words]
    return spark.createDataFrame(rows, "word string, pos string, ord int")


def segments(spark: SparkSession, sf_dir: str, corpus: str = "B") -> DataFrame:
    """P2+P3+P4: one row per sentence segment of the distinct lines (``seg``
    array<string>) with ``in_a``: the line belongs to A as well."""
    return segments_of(flagged_lines(spark, sf_dir, corpus), ["in_a"])


def flagged_lines(spark: SparkSession, sf_dir: str, corpus: str = "B") -> DataFrame:
    """The distinct lines of a corpus with ``in_a``: the line belongs to A as well."""
    lines = line_counts(spark, sf_dir).select("line", (F.col("na") > 0).alias("in_a"))
    return lines.where("in_a") if corpus == "A" else lines


def segment_strings(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """P3+P4 of distinct lines: one row per segment, its tokens joined to one string (``seg``),
    with the columns ``keep``.  Tokens are of the script class, so none holds a joiner."""
    return tk.segment_rows(lines, F.lower(F.col("line")), SCRIPT_CLASS, cut_words(), "seg", K.GRAM_JOINER, keep)


def cut_words() -> list[str]:
    return tk.cut_words(POS_LEXICON, STOP_WORDS, K.CUT_POS_PREFIXES)


#: Share of the documents that common tokens are looked for in.
TOKEN_SAMPLE = 0.01


def common_tokens(spark: SparkSession, sf_dir: str) -> list[str]:
    """Tokens with more places than a partition would have on average, as a sample of documents says;
    there are fewer of them than partitions.  They only say how rows are dealt out: no result depends on them."""
    words = table(spark, sf_dir, "documents").select("text").sample(TOKEN_SAMPLE, seed=1).where("text is not null") \
        .select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{SCRIPT_CLASS}]+"), F.lit(0))).alias("t"))
    counts = words.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(~F.col("t").isin(cut_words()))
    share = F.col("n") * int(spark.conf.get("spark.sql.shuffle.partitions")) / F.sum("n").over(Window.partitionBy())
    return [r["t"] for r in counts.withColumn("_share", share).where("_share > 1").select("t").collect()]


def segments_of(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """P3+P4 of distinct lines: one row per segment (``seg``), with the columns ``keep``."""
    return segment_strings(lines, keep).withColumn("seg", F.split("seg", K.GRAM_JOINER, -1))


def stop_segments(spark: SparkSession, sf_dir: str, corpus: str = "B") -> DataFrame:
    """P5: cut on stop words only."""
    t = tokens_of(distinct_lines(spark, sf_dir, corpus))
    s = tk.add_segments(t, "tokens", None, "segments", STOP_WORDS, (), None)
    return tk.explode_segments(s, "segments", "seg")
