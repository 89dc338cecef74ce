"""Label-list hygiene.

Word lists are DataFrames with a ``word`` column.  Nothing is rewritten in
place: every function returns new tables.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import not_blank


def word_list(df: DataFrame, col: str = "value") -> DataFrame:
    """S3: non-blank entries (nothing but characters up to U+0020 is blank), distinct;
    entries are not trimmed.  With an ``ord`` column (place in the files) each entry
    keeps its first place."""
    words = df.select(F.col(col).alias("word"), *(["ord"] if "ord" in df.columns else [])).where(not_blank("word"))
    if "ord" in df.columns:
        return words.groupBy("word").agg(F.min("ord").alias("ord"))
    return words.distinct()


def consolidate(lists: Sequence[DataFrame]) -> DataFrame:
    """Distinct union of several word lists."""
    out = lists[0].select("word")
    for lst in lists[1:]:
        out = out.unionByName(lst.select("word"))
    return out.distinct()


def bag_union(*lists: DataFrame) -> DataFrame:
    """UNION ALL (duplicates kept)."""
    out = lists[0]
    for lst in lists[1:]:
        out = out.unionByName(lst)
    return out


def bag_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset intersection of two word lists."""
    return a.select("word").intersectAll(b.select("word"))


def list_difference(a: DataFrame, b: DataFrame, key: str = "word") -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``."""
    return a.join(b.select(F.col("word").alias(key)), key, "left_anti")


def minus_lists(candidates: DataFrame, lists: Sequence[DataFrame], key: str = "term") -> DataFrame:
    """J10 over several lists: the distinct entries of ``candidates`` that none of the
    lists holds, sorted."""
    known = bag_union(*[x.select("word") for x in lists])
    return list_difference(candidates.select(key).distinct(), known, key).orderBy(key)


def resolve_conflicts(pos_lists: Mapping[str, DataFrame], neg_lists: Mapping[str, DataFrame],
                      true_pos: DataFrame) -> DataFrame:
    """``inter = pos ∩ neg``; ``true_neg = inter − true_pos``; every
    negative list loses the true positives, every positive list loses the
    true negatives.  Returns ``(list, word)`` rows of the new lists."""
    pos = consolidate(list(pos_lists.values()))
    neg = consolidate(list(neg_lists.values()))
    inter = pos.join(neg, "word", "left_semi")
    true_neg = list_difference(inter, true_pos)
    out = None
    for name, lst in neg_lists.items():
        t = word_list(lst, "word") if "word" in lst.columns else lst
        t = list_difference(t, true_pos).select(F.lit(name).alias("list"), "word")
        out = t if out is None else out.unionByName(t)
    for name, lst in pos_lists.items():
        t = word_list(lst, "word") if "word" in lst.columns else lst
        t = list_difference(t, true_neg).select(F.lit(name).alias("list"), "word")
        out = t if out is None else out.unionByName(t)
    return out


def rescue_nouns(neg_tagged: DataFrame, predictions: DataFrame,
                 noun_prefix: str = K.RESCUE_POS_PREFIX, noun_exact: str = K.RESCUE_POS_EXACT,
                 min_score: float = K.RESCUE_MIN_SCORE) -> DataFrame:
    """Negatives whose last token's POS starts with ``n`` (or equals
    ``vn``) that have a prediction with ``score > -10000``, best ``pred``
    first.  ``neg_tagged`` has ``word`` and ``pos`` (array)."""
    last = F.element_at(F.col("pos"), -1)
    nouns = neg_tagged.where(last.startswith(noun_prefix) | (last == noun_exact))
    p = predictions.select(F.col("term").alias("word"), "score", "pred")
    return (nouns.select("word").join(p, "word", "inner").where(F.col("score") > min_score)
            .select(F.col("word").alias("term"), "score", "pred").orderBy(F.desc("pred"), "term"))
