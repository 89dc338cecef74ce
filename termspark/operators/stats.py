"""Corpus statistics.

All counts are BIGINT and all aggregations are plain ``groupBy``s, so Spark
pre-aggregates map-side (partial HashAggregate) before the shuffle; a hot
term costs one row per map task, not one row per occurrence.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.functions.text import col, java_trim
from termspark.operators import tokenize as tk
from termspark.operators.ngrams import adjacent_bigrams


def _chars(c):
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def count_terms(terms: DataFrame, term_col: str = "term", out: str = "freq", weight: str | None = None) -> DataFrame:
    """Rows of each term, or the sum of ``weight`` over them."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return terms.groupBy(term_col).agg(n.alias(out))


def _terms(df: DataFrame, arrays, weight: str | None) -> DataFrame:
    """One row per array element that is not null.  From an outer explode Spark infers no
    filter, which would carry a second copy of the array's expression below it."""
    cols = [weight] if weight else []
    return df.select(*cols, F.explode_outer(arrays).alias("term")).where("term is not null")


def term_freq(df: DataFrame, tokens_col: str = "tokens", weight: str | None = None) -> DataFrame:
    """A1: occurrences of every token, most frequent first.  With ``weight`` a row
    of ``df`` stands for that many equal lines."""
    return count_terms(_terms(df, col(tokens_col), weight), weight=weight).orderBy(F.desc("freq"), "term")


def char_freq(df: DataFrame, tokens_col: str = "tokens", weight: str | None = None) -> DataFrame:
    """A2: occurrences of every character of every token."""
    t = _terms(df, F.flatten(F.transform(tokens_col, _chars)), weight)
    return count_terms(t, weight=weight).orderBy(F.desc("freq"), "term")


WORD, CHAR, LINES = "word", "char", "lines"
_MARK = {WORD: "w", CHAR: "c"}


def _marked(unit: str):
    return lambda x: F.concat(F.lit(_MARK[unit]), x)


def _per_line(tokens, unit: str):
    """The distinct words or characters of a line; none of a null."""
    terms = tokens if unit == WORD else F.flatten(F.transform(tokens, _chars))
    return F.coalesce(F.array_distinct(terms), F.array().cast("array<string>"))


def _line_counts(df: DataFrame, terms, weight: str | None) -> DataFrame:
    """(term, df): in how many lines each of a line's ``terms`` is; the null term counts the lines."""
    null = F.array(F.lit(None).cast("string"))
    rows = df.select(*([weight] if weight else []), F.explode_outer(F.concat(null, terms)).alias("term"))
    return rows.groupBy("term").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("df"))


def document_freq(df: DataFrame, tokens_col: str = "tokens", weight: str | None = None,
                  units: tuple[str, ...] = (WORD, CHAR)) -> DataFrame:
    """(unit, term, df) of words and characters in ONE pass over the lines, with the
    number of lines as the row (``lines``, '', N).  The key of the aggregation is one string,
    the term behind a letter for its unit."""
    t = col(tokens_col)
    marked = F.concat(*[F.transform(_per_line(t, u), _marked(u)) for u in units])
    unit = F.when(F.col("term").isNull(), LINES).otherwise(F.when(F.left("term", F.lit(1)) == _MARK[WORD], WORD).otherwise(CHAR))
    return _line_counts(df, marked, weight).select(unit.alias("unit"), F.coalesce(F.expr("substring(term, 2)"), F.lit("")).alias("term"), "df")


#: Lines whose characters are looked at together.
CHAR_LINES = 4096


def _char_lines(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points other than the space, and in how many lines (weighted by ``n``) each is."""
    found = np.zeros(256, np.int64)
    for i in range(0, len(at) - 1, CHAR_LINES):
        here = at[i:i + CHAR_LINES + 1]
        met = np.zeros((len(here) - 1, 256), bool)  # bytes of a line; those of wide characters are not read
        met.reshape(-1)[np.repeat(np.arange(0, 256 * len(met), 256), np.diff(here)) + data[here[0]:here[-1]]] = True
        found += np.where(met, n[i:i + CHAR_LINES, None], 0).sum(0)
    found[ord(" ")] = 0
    points = np.flatnonzero(found[:128])
    wide, code = tk.wide_chars(data)
    pair = np.unique((np.searchsorted(at, wide, "right") - 1) * 0x110000 + code)
    more, place = np.unique(pair % 0x110000, return_inverse=True)
    return np.r_[points, more], np.r_[found[points], np.bincount(place, weights=n[pair // 0x110000], minlength=len(more)).astype(np.int64)]


def line_document_freq(lines: DataFrame, line_col: str, weight: str, script_class: str) -> DataFrame:
    """:func:`document_freq` of the tokens ``[script]+|[^script ]+`` of lines that are strings: a task
    adds up the lines of a chunk, so that a row is shuffled for each term and chunk and not for
    each token."""
    def run(batches):
        for t in tk.chunks(batches):
            n = t.column(1).to_numpy()
            data, at = tk.line_bytes(t.column(0).combine_chunks())
            start, end, _, line = tk.token_places(data, at, tk.char_kinds(script_class))
            words = tk.pieces(data, start, end).dictionary_encode()
            names, code = words.dictionary, words.indices.to_numpy().astype(np.int64)
            pair = np.sort(line * max(len(names), 1) + code)
            pair = pair[np.r_[True, np.diff(pair) != 0]] if len(pair) else pair
            df = np.bincount(pair % max(len(names), 1), weights=n[pair // max(len(names), 1)], minlength=len(names)).astype(np.int64)
            points, char_df = _char_lines(data, at, n)
            terms = [*names.to_pylist(), *map(chr, points.tolist()), ""]
            unit = pa.array([WORD, CHAR, LINES]).take(pa.array(np.repeat([0, 1, 2], [len(names), len(points), 1])))
            yield pa.RecordBatch.from_arrays([unit, pa.array(terms, pa.string()), pa.array(np.r_[df, char_df, n.sum()], pa.int64())], ["unit", "term", "df"])

    part = lines.select(line_col, F.col(weight).cast("long").alias(weight)).mapInArrow(run, "unit string, term string, df long")
    return part.groupBy("unit", "term").agg(F.sum("df").alias("df"))


def idf_from(freq: DataFrame, unit: str) -> DataFrame:
    """A3 / A4 from :func:`document_freq`: ``ln(N / df)``."""
    n = freq.where(F.col("unit") == LINES).select(F.col("df").alias("_n"))
    # N is one row: a scalar subquery, no job before the query runs
    return freq.where(F.col("unit") == unit).select(
        "term", F.log(n.scalar().cast("double") / F.col("df")).alias("idf"))


def idf(df: DataFrame, tokens_col: str = "tokens", unit: str = WORD, weight: str | None = None) -> DataFrame:
    """A3 / A4: ``ln(N / df)`` where df counts lines containing the term
    (per-line distinct) and N counts every line; lowest idf first.

    One aggregation by the term alone."""
    if unit not in (WORD, CHAR):
        raise ValueError(unit)
    freq = _terms(df, _per_line(col(tokens_col), unit), weight).groupBy("term").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("df"))
    # one row; the lines it counts are the exchange that the terms are read from, not a second pass
    lines = df.agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n")).scalar()
    return freq.select("term", F.log(lines.cast("double") / F.col("df")).alias("idf")).orderBy("idf", "term")


def bigram_freq(df: DataFrame, tokens_col: str = "tokens", weight: str | None = None) -> DataFrame:
    """A5: adjacent-token bigrams (no separator), most frequent first."""
    return count_terms(_terms(df, adjacent_bigrams(tokens_col), weight), weight=weight).orderBy(F.desc("freq"), "term")


def nonscript_chars(lines: DataFrame, line_col: str, script_class: str) -> DataFrame:
    """Distinct characters outside the script over trimmed lines."""
    ch = lines.select(F.explode(_chars(java_trim(line_col))).alias("ch"))
    return ch.where(~F.col("ch").rlike(rf"^[{script_class}]\z")).distinct()


def nonscript_char_rank(freq_table: DataFrame, script_class: str, gram_col: str = "gram",
                        freq_col: str = "freq") -> DataFrame:
    """Length-1 entries of a frequency table outside the script, most
    frequent first."""
    return (freq_table.where((F.length(gram_col) == 1) & ~F.col(gram_col).rlike(rf"^[{script_class}]\z"))
            .select(gram_col, freq_col).orderBy(F.desc(freq_col), gram_col))


def all_script_lines(lines: DataFrame, line_col: str, script_class: str) -> DataFrame:
    """Distinct trimmed lines made only of script characters (empty
    lines pass)."""
    t = lines.select(java_trim(line_col).alias("line"))
    return t.where(F.col("line").rlike(rf"^[{script_class}]*\z")).distinct()


def duplicate_audit(lines: DataFrame, line_col: str = "line", weight: str | None = None) -> DataFrame:
    """Total vs distinct trimmed lines, one row."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    t = lines.groupBy(java_trim(line_col).alias("l")).agg(n.alias("n"))
    return t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"), F.count(F.lit(1)).alias("distinct_lines"))


def hot_words(words: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Occurrences of every token over a word list (hot words)."""
    return count_terms(words.select(F.explode(tokens_col).alias("term")), out="hot")


def hot_chars(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Occurrences of every character over a word list (hot chars)."""
    return count_terms(words.select(F.explode(_chars(word_col)).alias("term")), out="hot")
