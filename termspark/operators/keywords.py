"""Keyword-field mining and tagged-line extraction."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import (col, contains_any, ends_with_any, first_marker_index,
                                      regex_escape_class, sql_str)
from termspark.operators import tokenize as tk

#: Keys up to this many travel to the tasks as one automaton; more are looked up in the index.
BROADCAST_KEYS = 200_000
#: Lines that a task turns into strings at a time, and pieces that it holds before it lets them go.
HELD_LINES, HELD_PIECES = 500, 200_000


def extract_tagged(df: DataFrame, line_col: str = "line", open_tag: str = K.CONTENT_OPEN,
                   close_tag: str = K.CONTENT_CLOSE, out: str = "line") -> DataFrame:
    """Keep lines starting with ``open_tag``; delete both tag literals."""
    c = F.col(line_col)
    stripped = F.replace(F.replace(c, F.lit(open_tag), F.lit("")), F.lit(close_tag), F.lit(""))
    return df.where(c.startswith(open_tag)).select(stripped.alias(out))


def _drop_last_if(c, suffixes: Sequence[str]):
    return F.when(ends_with_any(c, suffixes), F.expr("substring(_kw, 1, length(_kw) - 1)")).otherwise(c)


def _java_split(ch: str):
    """Split at one character; empty pieces at the end are dropped, '' is one piece."""
    sep = "[" + regex_escape_class(ch) + "]"

    def split(s):
        cut = F.regexp_replace(s, sep + r"+\z", "")
        return F.when(s == "", F.array(F.lit(""))).when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, sep, -1))
    return split


def parse_keyword_fields(df: DataFrame, line_col: str = "line",
                         labels: Sequence[str] = K.KEYWORD_LABELS,
                         end_markers: Sequence[str] = K.KEYWORD_END_MARKERS,
                         trailing_drop: Sequence[str] = K.KEYWORD_TRAILING_DROP,
                         split_chars: Sequence[str] = K.KEYWORD_SPLIT_CHARS,
                         tail_drop: Sequence[str] = K.KEYWORD_TAIL_DROP,
                         paren: Sequence[str] = K.KEYWORD_PAREN,
                         remove: str = K.KEYWORD_REMOVE,
                         exclude: Sequence[str] = K.KEYWORD_EXCLUDE,
                         max_len: int = K.KEYWORD_MAX_LEN) -> DataFrame:
    """P20: one row per keyword parsed from labelled lines.

    Lines containing any label -> labels normalised to the first -> text
    after it -> cut at the first end marker -> one trailing ``;`` dropped ->
    split on one separator character after the other -> one trailing tail char
    dropped -> cut at the first parenthesis -> ``remove`` deleted -> dropped if it
    contains an excluded string or is longer than ``max_len``.  Splitting is Java's:
    empty pieces at the end of a split go, others stay and are keywords too; a text
    without any character is one empty piece.
    """
    canon = labels[0]
    c = F.col(line_col)
    x = df.where(contains_any(c, labels))
    norm = c
    for lab in labels[1:]:
        norm = F.replace(norm, F.lit(lab), F.lit(canon))
    x = x.select(norm.alias("_n"))
    x = x.select(F.expr(f"substring(_n, instr(_n, {sql_str(canon)}) + {len(canon)})").alias("_kw"))
    fi = first_marker_index(F.col("_kw"), end_markers)
    x = x.select(F.when(fi >= 0, F.substring(F.col("_kw"), F.lit(1), fi)).otherwise(F.col("_kw")).alias("_kw"))
    x = x.select(_drop_last_if(F.col("_kw"), trailing_drop).alias("_kw"))
    pieces = F.array("_kw")
    for ch in split_chars:
        pieces = F.flatten(F.transform(pieces, _java_split(ch)))
    x = x.select(F.inline(F.array(F.struct(pieces.alias("_a"))))).select(F.explode("_a").alias("_kw"))
    x = x.select(_drop_last_if(F.col("_kw"), tail_drop).alias("_kw"))
    pi = first_marker_index(F.col("_kw"), paren)
    x = x.select(F.when(pi >= 0, F.substring(F.col("_kw"), F.lit(1), pi)).otherwise(F.col("_kw")).alias("_kw"))
    x = x.select(F.replace(F.col("_kw"), F.lit(remove), F.lit("")).alias("keyword"))
    return x.where(~contains_any(F.col("keyword"), exclude) & (F.length("keyword") <= max_len))


def keyword_freq(keywords: DataFrame) -> DataFrame:
    """Occurrences per keyword."""
    return keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("freq"))


def keywords_by_length(keywords: DataFrame) -> DataFrame:
    """Distinct keywords ordered by length (ties by keyword)."""
    return keywords.select("keyword").distinct().orderBy(F.length("keyword"), "keyword")


def list_hits(keywords: DataFrame, *lists: DataFrame) -> DataFrame:
    """Distinct keywords present in every given word list (chained
    left-semi joins)."""
    x = keywords.select("keyword").distinct()
    for lst in lists:
        x = x.join(lst.select(F.col("word").alias("keyword")), "keyword", "left_semi")
    return x


def kwic_pieces(lines: DataFrame, line_col: str, key: str, script_class: str,
                stop_chars: str = K.STOP_CHARS, sep: str = ",", exclude: str | None = None,
                variants: tuple[str, str] = ("", "")) -> DataFrame:
    """Distinct lines containing ``key``, cleaned (width and ``variants``, a pair
    of strings whose characters stand for each other; stop chars, emoji, non-script ->
    ``sep``), split, pieces containing ``key`` (optionally not containing the longer
    phrase ``exclude``)."""
    x = lines.where(F.col(line_col).contains(key)).select(line_col).distinct()
    p = _pieces(x, line_col, script_class, stop_chars, sep, variants).where(F.col("piece").contains(key))
    if exclude:
        p = p.where(~F.col("piece").contains(exclude))
    return p


def _cleaned(plain, script_class: str, stop_chars: str, sep: str):
    """P21's cuts: an array of the pieces of a text whose characters have been mapped."""
    from termspark.functions.text import mask_chars, replace_emoji, replace_non_script
    cleaned = replace_non_script(replace_emoji(mask_chars(plain, stop_chars, sep), sep), sep, script_class)
    return F.split(cleaned, "[" + regex_escape_class(sep) + "]")


def _plain(line_col: str, variants: tuple[str, str]):
    from termspark.functions.text import half_width, map_chars
    return map_chars(half_width(col(line_col)), *variants)


def _pieces(lines: DataFrame, line_col: str, script_class: str, stop_chars: str, sep: str, variants: tuple[str, str], *keep: str) -> DataFrame:
    """``keep`` and the pieces of each line after cleaning."""
    return lines.select(*keep, F.explode(_cleaned(_plain(line_col, variants), script_class, stop_chars, sep)).alias("piece"))


def kwic_many(index: DataFrame, lines: DataFrame, keys: DataFrame, script_class: str, id_col: str = "id", line_col: str = "line",
              key_col: str = "key", stop_chars: str = K.STOP_CHARS, sep: str = ",", variants: tuple[str, str] = ("", ""),
              counted: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """P21 for a table of keys: (key, piece), what :func:`kwic_pieces` gives for each of them;
    ``counted``: each of these rows once, with its number ``n``.  ``index`` is the token index
    of ``lines``, distinct lines with an id.

    Up to ``broadcast_keys`` keys are one automaton in each task, which reads a line once for
    all of them; more are looked up in the index.  The result is the same."""
    words = keys.select(F.col(key_col).alias("key")).where("key is not null and key <> ''").distinct()
    few = [r["key"] for r in words.limit(broadcast_keys + 1).collect()]
    if len(few) <= broadcast_keys:
        found = _kwic_counts(lines, few, script_class, line_col, stop_chars, sep, variants)
        return found if counted else found.select("key", "piece", F.explode(F.expr("sequence(1, n)")).alias("_i")).drop("_i")
    from termspark.operators.index import find_keys
    found = find_keys(index, lines, keys, id_col, line_col, key_col)
    each = _pieces(found, "line", script_class, stop_chars, sep, variants, "key").where(F.col("piece").contains(F.col("key")))
    return each.groupBy("key", "piece").agg(F.count("*").alias("n")) if counted else each


def _kwic_counts(lines: DataFrame, keys: list[str], script_class: str, line_col: str, stop_chars: str, sep: str, variants: tuple[str, str]) -> DataFrame:
    """(key, piece, n): each piece with the keys in it that its line has as well, and in how many places it is.

    A line is cut once and each of its pieces searched once for all keys.  A piece of a line that
    the mapping of characters leaves as it is is a part of that line; other lines are searched
    themselves.  Only pieces that hold a key are shuffled, with all of their keys in one row."""
    sent = lines.sparkSession.sparkContext.broadcast(sorted(keys))
    # generator barrier: characters are mapped once
    plain = lines.select(F.inline(F.array(F.struct(F.col(line_col).alias("line"), _plain(line_col, variants).alias("_p")))))
    cut = plain.select(_cleaned(F.col("_p"), script_class, stop_chars, sep).alias("pieces"), F.when(F.col("_p") != F.col("line"), F.col("line")).alias("line"))

    def find(batches):
        import ahocorasick

        words, held = ahocorasick.Automaton(), Counter()
        for i, w in enumerate(sent.value):
            words.add_word(w, i)
        words.make_automaton()

        def out():
            pieces, keys = zip(*held) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(keys, pa.list_(pa.int32())), pa.array(held.values(), pa.int64())], ["piece", "keys", "n"])

        for b in (b.slice(i, HELD_LINES) for b in batches for i in range(0, b.num_rows, HELD_LINES)):
            if not sent.value:
                continue
            for pieces, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                there = None if line is None else {i for _, i in words.iter(line)}
                for p in pieces or ():
                    here = {i for _, i in words.iter(p)}
                    if there is not None:
                        here &= there
                    if here:
                        held[p, tuple(sorted(here))] += 1
            if len(held) >= HELD_PIECES:
                yield out()
                held.clear()
        yield out()
        held.clear()
        tk.give_back()

    def merge(batches):
        names = pa.array(sent.value, pa.string())
        for t in _whole_runs(tk.chunks(batches), "piece"):
            piece, keys = t.column("piece").combine_chunks(), t.column("keys").combine_chunks()
            new = np.r_[True, pc.not_equal(piece[1:], piece[:-1]).to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(t)), keys.value_lengths().to_numpy(zero_copy_only=False))
            pair, inverse = np.unique((np.cumsum(new) - 1)[row] * len(names) + keys.flatten().to_numpy(), return_inverse=True)
            n = np.bincount(inverse, weights=t.column("n").to_numpy()[row]).astype(np.int64)
            at = pa.array(np.searchsorted(pair, np.arange(new.sum() + 1) * len(names)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, x) for x in (names.take(pa.array(pair % len(names))), pa.array(n))]
            yield pa.RecordBatch.from_arrays([piece.filter(pa.array(new)), *lists], ["piece", "keys", "n"])

    found = cut.mapInArrow(find, "piece string, keys array<int>, n long").repartition("piece").sortWithinPartitions("piece")
    return found.mapInArrow(merge, "piece string, keys array<string>, n array<long>").selectExpr("piece", "inline(arrays_zip(keys, n)) as (key, n)").select("key", "piece", "n")


def _whole_runs(tables: Iterable[pa.Table], column: str) -> Iterator[pa.Table]:
    """Tables of rows sorted by a column, cut so that none of its values is in two of them."""
    held = None
    for t in tables:
        t = t if held is None else pa.concat_tables([held, t])
        values = t.column(column).combine_chunks()
        other = np.flatnonzero(pc.not_equal(values, values[-1]).to_numpy(zero_copy_only=False)) if len(t) else []
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield t.slice(0, last).combine_chunks()
        held = t.slice(last)
    if held is not None and len(held):
        yield held.combine_chunks()


def grep_tokens(lines: DataFrame, line_col: str, key: str, tokenize_fn,
                stop_chars: str = K.STOP_CHARS, sep: str = ",", alnum: bool = True,
                variants: tuple[str, str] = ("", "")) -> DataFrame:
    """Lines containing ``key`` -> width and ``variants`` -> stop chars and regex
    classes -> sep -> split -> pieces containing ``key`` -> tokens (space-joined)."""
    from termspark.functions.text import clean_classes, half_width, map_chars, mask_chars
    x = lines.where(F.col(line_col).contains(key))
    plain = map_chars(half_width(col(line_col)), *variants)
    cleaned = clean_classes(mask_chars(plain, stop_chars, sep), sep, alnum=alnum)
    p = x.select(F.explode(F.split(cleaned, "[" + regex_escape_class(sep) + "]")).alias("piece"))
    p = p.where(F.col("piece").contains(key))
    return p.select(F.array_join(tokenize_fn(F.col("piece")), " ").alias("tokens"))


def stop_edge_filter(terms: DataFrame, stop_words: Sequence[str], term_col: str = "term") -> DataFrame:
    """F8: drop terms that start or end with any stop word (string edges)."""
    arr = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    t = F.col(term_col)
    bad = F.exists(arr, lambda s: t.startswith(s) | t.endswith(s))
    return terms.where(~bad)
