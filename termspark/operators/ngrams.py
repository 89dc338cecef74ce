"""N-gram generation.

Each segment is first exploded into small context windows (at most
``max_len + 2`` tokens: previous token, up to ``max_len`` gram tokens, next
token) and only then into grams, so no generated row carries the whole
segment — memory stays linear in the segment length even for segments of
thousands of tokens.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import col, sql_str


def ngrams_with_context(df: DataFrame, seg_col: str = "seg", max_len: int = K.MAX_GRAM_LEN,
                        joiner: str = K.GRAM_JOINER, boundary: str = K.BOUNDARY, keep: Sequence[str] = ()) -> DataFrame:
    """For every start and every length 1..max_len, the gram (tokens
    joined by ``joiner``), its token count ``k``, and the previous / next
    token (``boundary`` at a segment edge); ``keep`` columns come along."""
    b = sql_str(boundary)
    # generator barrier: the padded array is computed once per segment
    padded = df.select(F.inline(F.array(F.struct(*[F.col(c) for c in keep],
        F.expr(f"concat(array({b}), {seg_col}, array({b}))").alias("_p")))))
    win = padded.select(*keep, F.explode(F.expr(
        f"transform(sequence(1, size(_p) - 2), i -> slice(_p, i, least({max_len + 2}, size(_p) - i + 1)))"
    )).alias("_w"))
    g = win.select(*keep, "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 2)).alias("k"))
    return g.select(
        F.array_join(F.slice("_w", 2, F.col("k")), joiner).alias("gram"),
        F.col("k").cast("bigint").alias("k"),
        F.col("_w").getItem(0).alias("prev"),
        F.expr("_w[k + 1]").alias("next"), *keep,
    )


def adjacent_bigrams(tokens) -> Column:
    """Token i and i+1 concatenated with no separator (none for lines
    with fewer than two tokens)."""
    t = col(tokens)
    n = F.size(t) - 1
    pairs = F.arrays_zip(F.slice(t, 1, n).alias("a"), F.slice(t, 2, n).alias("b"))
    return F.when(F.size(t) > 1, F.transform(pairs, lambda z: F.concat(z["a"], z["b"]))
                  ).otherwise(F.array().cast("array<string>"))


def char_pieces(c, script_class: str, stop_chars: str, sep: str = " ") -> Column:
    """N3 input: mask stop chars and punctuation/space classes with ``sep``,
    split, keep non-empty pieces made only of script characters."""
    from termspark.functions.text import clean_classes, mask_chars
    cleaned = clean_classes(mask_chars(col(c), stop_chars, sep), sep, alnum=False)
    pieces = F.split(cleaned, sep)
    return F.filter(pieces, lambda p: (F.trim(p) != "") & p.rlike(rf"^[{script_class}]+\z"))


def char_ngrams_with_next(df: DataFrame, piece_col: str = "piece", max_len: int = 4,
                          boundary: str = K.BOUNDARY, keep: Sequence[str] = ()) -> DataFrame:
    """For a piece, every substring of length 1..max_len-1 with its
    next character and its previous character (``boundary`` at the edges).

    The original miner writes, for each start, the padded substring of
    ``max_len`` characters and counts every proper prefix of it together with
    the character that follows; the left variant does the same on the
    reversed piece, which is the same as taking the previous character here.
    """
    b = sql_str(boundary)
    chars = df.select(F.inline(F.array(F.struct(*[F.col(c) for c in keep],
        F.expr(f"concat(array({b}), filter(split({piece_col}, ''), x -> x != ''), array({b}))").alias("_p")))))
    win = chars.select(*keep, F.explode(F.expr(
        f"transform(sequence(1, size(_p) - 2), i -> slice(_p, i, least({max_len + 1}, size(_p) - i + 1)))"
    )).alias("_w"))
    # a window [prev, c1 .. c_(L-2), next-ish]; grams of length 1..min(max_len-1, L-2)
    g = win.select(*keep, "_w", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_len - 1), F.size("_w") - 2))).alias("k"))
    return g.select(
        F.array_join(F.slice("_w", 2, F.col("k")), "").alias("gram"),
        F.col("_w").getItem(0).alias("prev"),
        F.expr("_w[k + 1]").alias("next"), *keep,
    )
