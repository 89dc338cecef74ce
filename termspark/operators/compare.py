"""Corpus diff: new and risen terms.

Inputs are scored tables ``(gram, freq, entropy, pmi)`` of the combined
corpus B and the background corpus A.  The joins are key equi-joins on
``gram`` (AQE picks broadcast or shuffle).  No function starts a job: counts that a
filter needs are scalar subqueries.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspark.functions import constants as K
from termspark.functions.text import is_reduplication, length_factor


def triple_floor(df: DataFrame, min_freq: int = K.DIFF_MIN_FREQ,
                 min_entropy: float = K.DIFF_MIN_ENTROPY, min_pmi: float = K.DIFF_MIN_PMI) -> DataFrame:
    """F1: ``freq >= 5 and entropy >= 2 and pmi >= 1.5``."""
    return df.where((F.col("freq") >= min_freq) & (F.col("entropy") >= min_entropy)
                    & (F.col("pmi") >= min_pmi))


def new_terms(b: DataFrame, a: DataFrame) -> DataFrame:
    """Rows of B whose gram does not occur in A."""
    return b.join(a.select("gram"), "gram", "left_anti")


def risen_terms(b: DataFrame, a: DataFrame, factor: int = K.RISE_FACTOR) -> DataFrame:
    """Grams in both with ``a.freq * factor < b.freq`` and a larger
    entropy or PMI in B; A's values come along as ``a_*`` columns."""
    aa = a.select("gram", F.col("freq").alias("a_freq"), F.col("entropy").alias("a_entropy"),
                  F.col("pmi").alias("a_pmi"))
    j = b.join(aa, "gram", "inner")
    cond = ((F.col("a_freq").cast("bigint") * F.lit(factor) < F.col("freq"))
            & ((F.col("a_entropy") < F.col("entropy")) | (F.col("a_pmi") < F.col("pmi"))))
    return j.where(cond)


def top_k_grams(a: DataFrame, k: Column | int) -> DataFrame:
    """O3: the first ``k`` grams of A by frequency (ties by gram).

    A histogram of the frequencies gives the frequency at which the k-th gram lies;
    everything above it is in, and only the grams at exactly that frequency are
    ranked, in groups by their first characters.  ``k`` may be a scalar subquery.
    """
    k = F.lit(k) if isinstance(k, int) else k
    x = a.select("gram", "freq")
    hist = x.groupBy("freq").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)  # a row a frequency
    cut = hist.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))) \
        .where((F.col("_above") < k)).select("freq", "_above", (F.col("_above") + F.col("_n") > k).alias("_split"), (k - F.col("_above")).alias("_room"))
    got = x.join(cut, "freq")
    tie = got.where("_split").withColumn("_p", F.substring("gram", 1, 3))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a group
    groups = tie.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    ranked = tie.join(groups, "_p").withColumn("_r", F.col("_off") + F.row_number().over(Window.partitionBy("_p").orderBy("gram")))
    return got.where("not _split").select("gram").union(ranked.where(F.col("_r") <= F.col("_room")).select("gram"))


def head_word_split(risen: DataFrame, a: DataFrame, n_filtered_b: Column | int,
                    divisor: int = K.TOP_FRACTION_DIVISOR,
                    protected: str = K.PROTECTED_SUBSTRING) -> tuple[DataFrame, DataFrame]:
    """Split risen terms into (kept, excluded): excluded = gram among A's
    top ``n_filtered_b // divisor`` by frequency and not containing the
    protected substring.  ``n_filtered_b`` may be a scalar subquery."""
    n = F.lit(n_filtered_b) if isinstance(n_filtered_b, int) else n_filtered_b
    top = top_k_grams(a, F.floor(n / divisor)).withColumn("_top", F.lit(True))
    x = risen.join(top, "gram", "left")
    hit = F.coalesce(F.col("_top"), F.lit(False)) & ~F.col("gram").contains(protected)
    return x.where(~hit).drop("_top"), x.where(hit).drop("_top")


def candidate_score(df: DataFrame) -> DataFrame:
    """O1: ``sqrt(freq) * entropy * pmi * length_factor(gram)``; the gram
    still has its separators, so they count towards the length."""
    s = F.sqrt(F.col("freq").cast("double")) * F.col("entropy") * F.col("pmi") * length_factor("gram")
    return df.withColumn("score", s)


def reduplication_filter(df: DataFrame, col: str = "term", joiner: str = K.GRAM_JOINER) -> DataFrame:
    """drop terms that are one character repeated, separators aside."""
    return df.where(~is_reduplication(F.replace(F.col(col), F.lit(joiner), F.lit(""))))


def diff_candidates(b_scored: DataFrame, a_scored: DataFrame, joiner: str = K.GRAM_JOINER,
                    surface_joiner: str = "", divisor: int = K.TOP_FRACTION_DIVISOR,
                    protected: str = K.PROTECTED_SUBSTRING, dedup: str | None = None, **floor) -> dict[str, DataFrame]:
    """The corpus-diff job.

    Returns ``new`` (J4), ``risen`` (J5 after J6), ``bg_top`` (the J6
    exclusions), ``candidates`` (term, score) and ``features`` (term, freq,
    entropy, pmi) — the last two are the bag union of new and risen terms,
    scored, reduplications removed, separators replaced by
    ``surface_joiner`` (the original removes them).  Grams that share a surface form
    stay several rows, as in the original; ``dedup='max'`` keeps the one with the best
    score.
    """
    b = triple_floor(b_scored, **floor)
    n_b = b.agg(F.count(F.lit(1)).alias("n")).scalar()
    new = candidate_score(new_terms(b, a_scored))
    risen, bg_top = head_word_split(risen_terms(b, a_scored), a_scored, n_b, divisor, protected)
    cols = ["gram", "freq", "entropy", "pmi"]
    allc = candidate_score(new.select(*cols).unionByName(risen.select(*cols)))
    allc = allc.withColumn("term", F.replace(F.col("gram"), F.lit(joiner), F.lit(surface_joiner)))
    allc = reduplication_filter(allc, "gram", joiner)
    if dedup == "max":
        best = F.max_by(F.struct("freq", "entropy", "pmi", "score"), F.struct("score", "gram")).alias("_b")
        allc = allc.groupBy("term").agg(best).select("term", "_b.*")
    elif dedup is not None:
        raise ValueError(dedup)
    return {
        "new": new,
        "risen": risen,
        "bg_top": bg_top,
        "candidates": allc.select("term", "score"),
        "features": allc.select("term", "freq", "entropy", "pmi"),
    }
