"""Inverted index: many keys looked up in lines at once.

A key occurs in a line only where its words, cut at single spaces, do: a key of one word
inside a token, one of several words as the end of a token, whole tokens, and the
beginning of a token.  So the longest word of each key meets the vocabulary, which is
small beside the text, by an equi-join with pieces of its tokens, and through the index the
lines; only these lines are searched for the key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_index(lines: DataFrame, id_col: str = "id", line_col: str = "line") -> DataFrame:
    """(token, id): the distinct tokens of each line, cut at single spaces."""
    return lines.select(F.explode_outer(F.array_distinct(F.split(line_col, " "))).alias("token"), F.col(id_col).alias("id")).where("token is not null")


def _anchors(keys: DataFrame, key_col: str) -> DataFrame:
    """(key, part, kind): the longest word of each key, whole tokens before others, and how a
    token has to hold it."""
    words = keys.select(F.col(key_col).alias("key")).where("key is not null and key <> ''").distinct()
    each = words.select("key", F.size(F.split("key", " ")).alias("m"), F.posexplode(F.split("key", " ")).alias("i", "part"))
    kind = F.when(F.col("m") == 1, "in").when(F.col("i") == 0, "end").when(F.col("i") == F.col("m") - 1, "begin").otherwise("whole")
    best = F.max(F.struct((F.length("part") + F.when(kind == "whole", 2).otherwise(0)).alias("n"), "part", kind.alias("kind"))).alias("x")
    return each.groupBy("key").agg(best).select("key", "x.part", "x.kind")


_PIECES = {"in": "array_distinct(transform(sequence(1, length(token) - _n + 1), i -> substring(token, i, _n)))", "end": "array(right(token, _n))",
           "begin": "array(left(token, _n))", "whole": "array(token)"}


def find_keys(index: DataFrame, lines: DataFrame, keys: DataFrame, id_col: str = "id", line_col: str = "line", key_col: str = "key") -> DataFrame:
    """(key, id, line): the lines that contain each distinct, non-empty key as a string;
    ``index`` is the :func:`token_index` of ``lines``."""
    anchors, tokens, held = _anchors(keys, key_col), index.select("token").distinct(), None
    for kind, pieces in _PIECES.items():
        mine = anchors.where(F.col("kind") == kind).select("key", "part")
        lengths = mine.agg(F.collect_set(F.length("part")).alias("l")).scalar()  # as many as there are lengths
        each = tokens.withColumn("_n", F.explode(lengths))
        each = each.where("_n = length(token)" if kind == "whole" else "_n <= length(token)")
        each = each.select("token", F.explode(F.expr(f"case when _n = 0 then array('') else {pieces} end")).alias("part"))
        met = mine.join(each, "part").select("key", "token")
        held = met if held is None else held.union(met)
    # dealt out by line once: neither the distinct pairs nor the join with the text shuffle them again
    near = held.join(index, "token").select("key", "id").repartition("id").distinct()
    text = lines.select(F.col(id_col).alias("id"), F.col(line_col).alias("line"))
    return near.join(text, "id").where(F.col("line").contains(F.col("key"))).select("key", "id", "line")
